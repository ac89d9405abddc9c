"""Machine, signal and reason dimensions.

Join sides are left to the optimizer's size statistics (adaptive execution broadcasts a side only
after measuring it), so a catalog that outgrows memory silently becomes a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules


def machine_master(unit: DataFrame, device: DataFrame, monitor_unit: DataFrame) -> DataFrame:
    dev = device.select(F.col("uid").alias("device_uid"), "collector_type_name")
    mon = monitor_unit.select(F.col("id").alias("monitor_unit_id"), F.col("unit_uid"))
    return (
        unit.withColumnRenamed("uid", "unit_uid")
        .join(dev, "device_uid", "left")
        .join(mon, "unit_uid", "left")
        .select(
            "unit_uid", "name", rules.vendor("collector_type_name").alias("vendor"), "collector_type_name",
            "is_enabled", "monitor_unit_id", F.col("monitor_unit_id").isNotNull().alias("has_telemetry"),
        )
    )


def reason_lookup(mes_reading_def: DataFrame) -> DataFrame:
    """One text per signal uid; of several spellings the smallest is kept so the choice is stable."""
    return mes_reading_def.groupBy(F.col("uid").alias("reading_def_uid")).agg(
        F.min("display_text").alias("display_text")
    )


def signal_map(
    monitor_reading_def: DataFrame, monitor_unit: DataFrame, master: DataFrame, mes_reading_def: DataFrame
) -> DataFrame:
    """Catalog entries with machine, vendor, canonical role and the matching production-side entry."""
    optional = [c for c in ("signal_type", "signal_category") if c in mes_reading_def.columns]
    packed = F.struct(
        F.col("display_text").alias("mes_display_text"),
        *[F.col(c).alias(f"mes_{c}") for c in optional],
        F.col("exclude_from_oee").alias("mes_exclude_from_oee"),
    )
    mes = mes_reading_def.groupBy(F.col("uid").alias("readingdef_uid")).agg(F.min(packed).alias("mes"))
    units = monitor_unit.select(F.col("id").alias("unit_id"), "unit_uid")
    owners = master.select("unit_uid", F.col("name").alias("machine"), "vendor")
    joined = (
        monitor_reading_def.join(units, "unit_id", "left")
        .join(owners, "unit_uid", "left")
        .join(mes, "readingdef_uid", "left")
    )
    role = rules.signal_role("readingdef_name")
    passthrough = [
        c for c in ("external_signal_type", "external_signal_category", "si_unit") if c in monitor_reading_def.columns
    ]
    return joined.select(
        "readingdef_uid", "machine", "vendor", "readingdef_name", role.alias("canonical_role"),
        role.isin(*rules.EVIDENCE_ROLES).alias("is_evidence_signal"), *passthrough,
        *[F.col(f"mes.mes_{c}").alias(f"mes_{c}") for c in optional],
        F.col("mes.mes_display_text").alias("mes_display_text"),
        F.col("mes.mes_exclude_from_oee").alias("mes_exclude_from_oee"),
        F.col("mes.mes_display_text").isNotNull().alias("matched_mes"), "unit_uid", "unit_id",
    )


def role_uid_map(signals: DataFrame, roles=rules.FEATURE_ROLES) -> DataFrame:
    packed = F.struct("machine", "vendor", "canonical_role")
    return (
        signals.where(F.col("canonical_role").isin(*roles))
        .groupBy("readingdef_uid").agg(F.min(packed).alias("x"))
        .select("readingdef_uid", "x.*")
    )


def machine_instance(mes_reading_def: DataFrame, master: DataFrame) -> DataFrame:
    """Most frequent instance per machine (ties: smallest) with the smallest unit uid."""
    owners = master.select("unit_uid", F.col("name").alias("machine"))
    counted = (
        mes_reading_def.where(F.col("instance_id").isNotNull())
        .groupBy("unit_uid", "instance_id").agg(F.count(F.lit(1)).alias("n"))
        .join(owners, "unit_uid")
        .groupBy("machine", "instance_id").agg(F.sum("n").alias("n"), F.min("unit_uid").alias("unit_uid"))
    )
    best = F.min(F.struct(-F.col("n"), F.col("instance_id")))
    return counted.groupBy("machine").agg(best.alias("b"), F.min("unit_uid").alias("unit_uid")).select(
        "machine", F.col("b.instance_id").alias("instance_id"), "unit_uid"
    )


def catalog_coverage(left: DataFrame, left_uid: str, right: DataFrame, right_uid: str) -> DataFrame:
    """How far two catalogs share uids: both, only one side, share of the right side."""
    a = left.where(F.col(left_uid).isNotNull()).groupBy(F.col(left_uid).alias("uid")).agg(F.lit(1).alias("l"))
    b = right.where(F.col(right_uid).isNotNull()).groupBy(F.col(right_uid).alias("uid")).agg(F.lit(1).alias("r"))
    both = F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull())
    right_n = F.count("r")
    return a.join(b, "uid", "full").agg(
        F.count("l").alias("left_uids"), right_n.alias("right_uids"), both.alias("both_uids"),
        F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"),
        (both * 100.0 / F.greatest(right_n, F.lit(1))).alias("pct_of_right"),
    )
