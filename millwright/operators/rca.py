"""Alarm cascades, alarm-to-stop correlation, root-cause cards and cross-machine recurrence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.timex import MS_PER_HOUR, US_PER_HOUR, US_PER_MIN, US_PER_S, at, floor_us, half_even, half_up, hours, us
from .events import overlapping, padded, standing
from .scan import asof, attach, sweep

GENERIC = "UNPLANNED_RUNSTOP"
RECURRING = ("CONNECTIVITY", "AIR_PRESSURE", "EMERGENCY_STOP", "UNPLANNED_RUNSTOP")


def alarm_to_stop(alerts: DataFrame, stops: DataFrame, max_lag_min: int = 10) -> DataFrame:
    """For each alarm the nearest unplanned stop at or after it, within the lag (inclusive).

    Machines without any unplanned stop give no rows.
    """
    up = stops.where(F.col("category") == GENERIC).select("machine", us("start").alias("__s"), "label")
    left = alerts.select("machine", F.col("start").alias("alarm_start"), F.col("category").alias("alarm_category"))
    left = left.join(up.groupBy("machine").agg(F.lit(1).alias("x")), "machine", "left_semi")
    hit = asof(
        left, up, ["machine"], us("alarm_start"), F.col("__s"), ["label"], direction="forward",
        tolerance_us=max_lag_min * US_PER_MIN,
    )
    return hit.select(
        *left.columns, at("hit.t").alias("stop_start"), F.col("hit.label").alias("stop_reason"),
        ((F.col("hit.t") - us("alarm_start")) / float(US_PER_S)).alias("lag_seconds"),
        F.col("hit").isNotNull().alias("matched"),
    )


def cascades(alerts: DataFrame, tol_s: int = 2, min_size: int = 2) -> DataFrame:
    """Alarms raised in the same fixed time bucket, ordered from the most upstream category.

    Repeated alarms are folded to one entry with its count before the bucket is assembled, so the
    nested chain is as long as the number of different alarm texts, however many rows a bucket holds.
    """
    b = floor_us(us("start"), tol_s * US_PER_S)
    folded = (
        alerts.groupBy("machine", b.alias("b"), "category", "label")
        .agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("meta.index")).alias("indices"))
    )
    item = F.struct(rules.causal_rank("category").alias("rank"), "label", "category", "n", "indices")
    g = folded.groupBy("machine", "b").agg(
        F.sum("n").alias("n_alarms"), F.array_sort(F.collect_list(item)).alias("chain")
    )
    return g.where(F.col("n_alarms") >= min_size).select(
        "machine", at("b").alias("bucket_start"), "n_alarms", F.col("chain")[0]["label"].alias("root_alarm"),
        F.col("chain")[0]["category"].alias("root_category"), "chain",
    )


def chain_text(chain: Column) -> Column:
    """`A -> B x2 -> C` for a folded chain."""
    one = F.transform(
        chain, lambda x: F.when(x["n"] > 1, F.concat(x["label"], F.lit(" x"), x["n"].cast("string"))).otherwise(x["label"])
    )
    return F.array_join(one, " -> ")


def hypotheses(category: Column, drift: Column) -> Column:
    """Ranked templates of the category followed by the generic ones; drift adds 0.1, at most 1."""

    def ranked(cat: str) -> Column:
        rows = [(c, *t) for c in dict.fromkeys([cat, GENERIC]) for t in rules.HYPOTHESES.get(c, [])]
        rows.sort(key=lambda r: -r[2])
        return F.array(*[
            F.struct(
                F.lit(cause).alias("cause"),
                F.when(drift, F.lit(min(1.0, like + 0.1))).otherwise(F.lit(like)).alias("likelihood"),
                F.lit(why).alias("rationale"), F.lit(act).alias("recommended_action"), F.lit(c).alias("category"),
            )
            for c, cause, like, why, act in rows
        ])

    out = None
    for cat in rules.HYPOTHESES:
        if cat != GENERIC:
            out = F.when(category == cat, ranked(cat)) if out is None else out.when(category == cat, ranked(cat))
    return out.otherwise(ranked(GENERIC))


def cards(
    windows: DataFrame, stream: DataFrame, alerts: DataFrame, stops: DataFrame, key: str = "id",
    pre_min: int = 15, post_min: int = 5,
) -> DataFrame:
    """One root-cause card per incident window, for any number of windows in one job.

    `windows` has key, machine, w_start, w_end. The lag is the smallest of all matched alarms of the
    machine, as an indicator of how its alarms relate to stops.
    """
    w = windows.select(key, "machine", "w_start", "w_end")
    ev = stream.select("machine", "source", "category", "label", "start", "end", "duration_ms", "meta")
    hit = overlapping(w, ev, key, pre_min, post_min)

    def of(src: str, x: Column) -> Column:
        return F.when(F.col("source") == src, x)

    generic = (F.col("source") == "stoppage") & (F.col("category") == GENERIC)
    asked = {
        "n_alarms": ("count", of("alert", F.lit(1))), "n_stops": ("count", of("stoppage", F.lit(1))),
        "n_offline": ("count", of("offline", F.lit(1))), "n_drift": ("count", of("ad_window", F.lit(1))),
        "alarm": ("min", of("alert", F.struct("start", "label", "category"))),
        "ad": ("min", of("ad_window", F.struct("start", F.to_json("meta.top_roles").alias("roles")))),
        "linked_ms": ("sum", F.when(generic, F.col("duration_ms").cast("double"))),
    }
    fold = {"count": F.count, "min": F.min, "sum": F.sum}
    paired = hit.groupBy(key).agg(*[fold[how](x).alias(f"p_{name}") for name, (how, x) in asked.items()])
    # what stands open from before is met by one running aggregate for each fact
    bounds = padded(w, pre_min, post_min)
    before = sweep(
        bounds.select(key, "machine", "w0"), ["machine"], F.col("w0"),
        [(standing(bounds, ev).where("__open"), F.col("e0"), asked)], feed_first=False,
    )
    facts = before.join(paired, key, "left")
    for name, (how, _) in asked.items():
        own, old = F.col(f"p_{name}"), F.col(name)
        facts = facts.withColumn(name, F.least(own, old) if how == "min" else F.coalesce(own + old, own, old))
    facts = facts.select(key, *asked)
    lags = alarm_to_stop(alerts, stops).where("matched").groupBy("machine").agg(F.min("lag_seconds").alias("min_lag"))
    casc = cascades(alerts).select(
        "machine", us("bucket_start").alias("__b"), F.col("n_alarms").alias("size"), "root_alarm", "root_category",
        chain_text(F.col("chain")).alias("chain_text"),
    )
    lo, hi = us("w_start") - pre_min * US_PER_MIN, us("w_end") + post_min * US_PER_MIN
    located = asof(
        w, casc, ["machine"], lo, F.col("__b"), ["size", "root_alarm", "root_category", "chain_text"],
        direction="forward", out="casc",
    )
    located = located.withColumn("casc", F.when(F.col("casc.t") <= hi, F.col("casc")))
    j = located.join(facts, key, "left").join(lags, "machine", "left")
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_alarms", "n_stops", "n_offline", "n_drift")}
    has_alarm, drift = n["n_alarms"] > 0, n["n_drift"] > 0
    conn = (n["n_offline"] > 0) & ~has_alarm
    casc_ok = F.col("casc").isNotNull()
    j = (
        j.withColumn("has_alarm", has_alarm).withColumn("has_drift", drift).withColumn("is_connectivity", conn)
        .withColumn("lag_seconds", F.when(has_alarm, F.col("min_lag")))
    )
    pattern = rules.causal_pattern(F.col("has_alarm"), F.col("lag_seconds"), F.col("has_drift"), F.col("is_connectivity"))
    primary = (
        F.when(casc_ok, F.col("casc.root_category")).when(F.col("has_alarm"), F.col("alarm.category"))
        .when(F.col("is_connectivity"), "CONNECTIVITY").when(F.col("has_drift"), "ANOMALY").otherwise(GENERIC)
    )
    trigger = (
        F.when(casc_ok, F.concat(F.lit("Alarm cascade root: "), F.col("casc.root_alarm")))
        .when(F.col("has_alarm"), F.concat(F.lit("Alarm: "), F.col("alarm.label")))
        .when(F.col("is_connectivity"), "System Offline").when(F.col("has_drift"), "Telemetry anomaly (AD)")
        .otherwise("Unplanned stop")
    )
    head = (
        F.when(casc_ok, F.concat(
            F.lit("Alarm cascade ("), F.col("casc.size").cast("string"), F.lit("): "), F.col("casc.chain_text"),
            F.lit(" | root="), F.col("casc.root_alarm")))
        .when(F.col("has_alarm"), F.concat(F.lit("Alarm: "), F.col("alarm.label")))
        .when(F.col("is_connectivity"), "Collector offline window (no machine telemetry present)")
        .when(F.col("has_drift"), F.concat(
            F.lit("AD telemetry anomaly; deviating: "), F.coalesce(F.col("ad.roles"), F.lit("None"))))
    )
    lag_line = F.concat(
        F.lit("Nearest alarm->stop lag: "), half_even("lag_seconds", 0).cast("bigint").cast("string"), F.lit("s")
    )
    drift_line = F.when(casc_ok & F.col("has_drift"), "Telemetry drift preceded the alarm (predictive signal)")
    evidence = F.filter(F.array(head, lag_line, drift_line), lambda x: x.isNotNull())
    out = j.select(
        key, "machine", at(lo).alias("window_start"), at(hi).alias("window_end"), trigger.alias("trigger"),
        pattern.alias("pattern"), primary.alias("primary_category"), evidence.alias("evidence"),
        "casc", "lag_seconds", half_even(F.coalesce(F.col("linked_ms"), F.lit(0.0)) / MS_PER_HOUR, 2).alias("linked_hours"),
        "is_connectivity",
    )
    out = out.withColumn("hypotheses", hypotheses(F.col("primary_category"), F.col("pattern") == "DRIFT_ALARM_STOP"))
    return out.withColumn("recommended_action", F.col("hypotheses")[0]["recommended_action"])


def whatif_hint(card: DataFrame, key: str = "id", recovery_fraction: float | None = None) -> DataFrame:
    """Recoverable downtime of a card; a connectivity fault recovers nothing."""
    cat = F.when(F.col("casc").isNotNull(), F.col("casc.root_category")).otherwise(F.col("hypotheses")[0]["category"])
    share = F.lit(recovery_fraction) if recovery_fraction is not None else rules.recovery_share(cat)
    conn = F.col("is_connectivity")
    return card.select(
        key, "machine", F.when(conn, "CONNECTIVITY").otherwise(cat).alias("category"),
        F.when(conn, 0.0).otherwise(F.col("linked_hours") * MS_PER_HOUR * share).alias("recoverable_ms"),
        F.when(conn, "none").otherwise("W1").alias("target_scenario"),
    )


def recurrence(
    stream: DataFrame, bucket_s: int = 3600, min_machines: int = 2, categories: Sequence[str] = RECURRING
) -> DataFrame:
    """Same category on several machines in one time bucket; folded per machine before the bucket."""
    b = floor_us(us("start"), bucket_s * US_PER_S)
    per_machine = (
        stream.where(F.col("category").isin(*categories))
        .groupBy(b.alias("b"), "category", "machine").agg(F.sum(hours("duration_ms")).alias("h"))
    )
    g = per_machine.groupBy("b", "category").agg(
        F.array_sort(F.collect_list("machine")).alias("machines"), F.count("machine").alias("n_machines"),
        F.coalesce(F.sum("h"), F.lit(0.0)).alias("total_hours"),
    )
    score = half_up(F.col("n_machines") * F.greatest(F.col("total_hours"), F.lit(0.01)), 2)
    return g.where(F.col("n_machines") >= min_machines).select(
        at("b").alias("bucket_start"), "category", "machines", "n_machines", "total_hours",
        score.alias("systemic_score"), rules.facility_cause("category").alias("facility_root"),
    )


def category_rank(rec: DataFrame, category: str = "CONNECTIVITY") -> DataFrame:
    """0-based position of the best bucket of a category in the whole ranking, without sorting it.

    The position is the number of buckets ahead of it; ties go to the earlier bucket, then the name.
    """
    key = F.struct((-F.col("systemic_score")).alias("s"), F.col("bucket_start").alias("b"), F.col("category").alias("c"))
    best = rec.where(F.col("category") == category).agg(F.min(key).alias("best"))
    rows = attach(rec, best)
    return rows.agg(
        F.count(F.lit(1)).alias("systemic_buckets"), F.count_if(key < F.col("best")).alias("rank"),
    )


def fanout_audit(status: DataFrame, instances: DataFrame) -> DataFrame:
    """How many outage windows are only one instance row replicated to its members."""
    off = status.where(~F.col("is_online") & F.col("started_on").isNotNull())
    members = instances.groupBy("instance_id").agg(F.count_distinct("machine").alias("members"))
    w = off.select("instance_id", "started_on", "ended_on").dropDuplicates().join(members, "instance_id")
    return w.agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(F.col("members") > 1).alias("replicated"),
        F.avg((F.col("members") > 1).cast("double")).alias("share"), F.max("members").alias("widest"),
    )


def telemetry_overlay(
    windows: DataFrame, readings: DataFrame, key: str, roles: Sequence[str] = rules.OVERLAY_ROLES,
    pre_min: int = 15, post_min: int = 5,
) -> DataFrame:
    """Readings of the chosen roles inside each padded window; windows meet readings by hour bin."""
    lo, hi = us("w_start") - pre_min * US_PER_MIN, us("w_end") + post_min * US_PER_MIN
    w = windows.select(key, "machine", lo.alias("w0"), hi.alias("w1"))
    w = w.withColumn("bin", F.explode(F.sequence(F.floor(F.col("w0") / US_PER_HOUR), F.floor(F.col("w1") / US_PER_HOUR))))
    r = readings.where(F.col("role").isin(*roles)).withColumn("t", us("time"))
    r = r.withColumn("bin", F.floor(F.col("t") / US_PER_HOUR))
    return w.join(r, ["machine", "bin"]).where("t >= w0 AND t <= w1").select(key, "machine", "role", "time", "value")
