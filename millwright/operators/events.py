"""One event schema for alarms, stoppages, outages and anomaly windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.timex import MS_PER_HOUR, US_PER_MIN, us
from .scan import attach, sweep

TOP_ROLES_DDL = "array<struct<role:string,dev_score:double,direction:string>>"
META = {
    "index": "int", "is_array": "boolean", "reading_def_uid": "string", "clipped": "boolean",
    "instance_id": "string", "systemic": "boolean", "top_roles": TOP_ROLES_DDL,
}
EVENT_COLS = [
    "machine", "unit_uid", "source", "category", "label", "start", "end", "duration_ms",
    "is_planned", "excludes_oee", "severity", "meta",
]


def _opt(df: DataFrame, name: str, dtype: str) -> Column:
    return F.col(name).cast(dtype) if name in df.columns else F.lit(None).cast(dtype)


def _meta(**given: Column) -> Column:
    return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in META.items()])


def resolve(slices: DataFrame, master: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """Attach the machine name, and the reason text where rows carry a reading_def_uid."""
    owners = master.select("unit_uid", F.col("name").alias("machine"))
    out = slices.drop("machine").join(owners, "unit_uid", "left")
    if reasons is not None and "display_text" not in slices.columns:
        out = out.join(reasons, "reading_def_uid", "left")
    return out


def alert_events(alerts: DataFrame) -> DataFrame:
    meta = _meta(
        index=_opt(alerts, "index", "int"), reading_def_uid=_opt(alerts, "reading_def_uid", "string"),
        is_array=F.coalesce(_opt(alerts, "is_array", "boolean"), F.lit(False)),
    )
    return alerts.where(F.col("started_on").isNotNull()).select(
        "machine", "unit_uid", F.lit("alert").alias("source"), rules.alarm_category("value").alias("category"),
        F.trim("value").alias("label"), F.col("started_on").alias("start"),
        _opt(alerts, "ended_on", "timestamp").alias("end"),
        F.col("duration_milliseconds").try_cast("double").alias("duration_ms"), F.lit(False).alias("is_planned"),
        F.lit(False).alias("excludes_oee"), F.lit(0.9).alias("severity"), meta.alias("meta"),
    )


def stoppage_events(stops: DataFrame, clip_hours: float = 24.0) -> DataFrame:
    cap = clip_hours * MS_PER_HOUR
    dur = F.col("duration_milliseconds").try_cast("double")
    cat = rules.stop_category("display_text", "is_planned")
    excl = F.coalesce(_opt(stops, "exclude_from_oee", "boolean"), F.lit(False)) | (cat == "CONNECTIVITY")
    severity = F.when(cat == "UNPLANNED_RUNSTOP", 0.7).when(cat == "CONNECTIVITY", 0.4).otherwise(0.2)
    meta = _meta(
        clipped=F.coalesce(dur > cap, F.lit(False)), reading_def_uid=_opt(stops, "reading_def_uid", "string")
    )
    return stops.where(F.col("started_on").isNotNull()).select(
        "machine", "unit_uid", F.lit("stoppage").alias("source"), cat.alias("category"),
        F.col("display_text").alias("label"), F.col("started_on").alias("start"), F.col("ended_on").alias("end"),
        F.when(dur.isNotNull(), F.least(dur, F.lit(cap))).alias("duration_ms"), "is_planned",
        excl.alias("excludes_oee"), severity.alias("severity"), meta.alias("meta"),
    )


def offline_events(status: DataFrame, instances: DataFrame) -> DataFrame:
    """Each instance outage becomes one event per member machine; more than one member is systemic."""
    members = instances.groupBy("instance_id").agg(F.count(F.lit(1)).alias("members"))
    off = status.where(~F.col("is_online") & F.col("started_on").isNotNull())
    joined = off.join(instances, "instance_id").join(members, "instance_id")
    return joined.select(
        "machine", "unit_uid", F.lit("offline").alias("source"), F.lit("CONNECTIVITY").alias("category"),
        F.lit("System Offline").alias("label"), F.col("started_on").alias("start"), F.col("ended_on").alias("end"),
        F.col("duration_milliseconds").try_cast("double").alias("duration_ms"), F.lit(False).alias("is_planned"),
        F.lit(True).alias("excludes_oee"), F.lit(0.4).alias("severity"),
        _meta(instance_id=F.col("instance_id"), systemic=F.col("members") > 1).alias("meta"),
    )


def adwindow_events(windows: DataFrame) -> DataFrame:
    ms = (us("window_end") - us("window_start")) / 1000.0
    roles = F.col("top_roles") if "top_roles" in windows.columns else F.lit(None)
    return windows.where(F.col("window_start").isNotNull()).select(
        "machine", F.lit(None).cast("string").alias("unit_uid"), F.lit("ad_window").alias("source"),
        F.lit("ANOMALY").alias("category"), F.lit("telemetry anomaly").alias("label"),
        F.col("window_start").alias("start"), F.col("window_end").alias("end"), ms.alias("duration_ms"),
        F.lit(False).alias("is_planned"), F.lit(True).alias("excludes_oee"),
        (F.col("peak_score") / 100.0).alias("severity"), _meta(top_roles=roles).alias("meta"),
    )


def event_stream(*parts: DataFrame) -> DataFrame:
    """Union of the given event frames in the common schema; order on output if it must be sorted."""
    out = parts[0].select(*EVENT_COLS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*EVENT_COLS))
    return out


def unplanned(stops: DataFrame, min_minutes: float = 0.0) -> DataFrame:
    """Unplanned run stops of at least the given length, with a non-negative `minutes` column."""
    ev = stops.where(F.col("category") == "UNPLANNED_RUNSTOP")
    mins = F.when(F.col("duration_ms").isNotNull(), F.greatest(F.col("duration_ms") / 6e4, F.lit(0.0)))
    out = ev.select("machine", "start", "label", "duration_ms", mins.alias("minutes"))
    return out.where(F.col("minutes") >= min_minutes) if min_minutes > 0 else out


LEVELS = 27
"""Power-of-two levels of hours that hold every length between two timestamps."""


def padded(windows: DataFrame, pre_min: int = 15, post_min: int = 5) -> DataFrame:
    """Windows with the padded bounds w0 and w1 in microseconds."""
    return windows.withColumn("w0", us("w_start") - pre_min * US_PER_MIN).withColumn("w1", us("w_end") + post_min * US_PER_MIN)


def standing(windows: DataFrame, events: DataFrame) -> DataFrame:
    """Events with e0, e1 and `__open`: without an end, or with one that no padded window starts after.

    Such an event touches every window that starts after it, so it is counted, not paired.
    """
    last = windows.agg(F.max("w0").alias("__last"))
    e = attach(events.withColumn("e0", us("start")).withColumn("e1", us("end")), last)
    return e.withColumn("__open", F.col("e1").isNull() | F.coalesce(F.col("e1") >= F.col("__last"), F.lit(False))).drop("__last")


def overlapping(
    windows: DataFrame, events: DataFrame, key: str, pre_min: int = 15, post_min: int = 5
) -> DataFrame:
    """Events touching each padded window [start - pre, end + post] of the same machine, but for standing ones.

    Paired are events that start inside the window and closed ones that run at its start. Earlier events
    that stand open (see `standing`) touch all later windows of their machine; `open_before` and
    `standing` tell them without a pair each. Closed events sit in at most two bins of the power-of-two
    level that fits their length, and every window probes one bin of each level.
    """
    w = padded(windows, pre_min, post_min)
    e = standing(w, events)

    hour = 3600 * 1_000_000
    # (a) events that start inside the window: hour bins of the start
    wa = w.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("w0") / hour), F.floor(F.col("w1") / hour))))
    ea = e.withColumn("__bin", F.floor(F.col("e0") / hour))
    inside = wa.join(ea, ["machine", "__bin"]).where("e0 >= w0 AND e0 <= w1")

    # (b) closed events already running at w0: dyadic levels of the event length
    length_h = F.greatest(F.ceil((F.col("e1") - F.col("e0")) / hour), F.lit(1))
    level = F.ceil(F.log2(length_h.cast("double"))).cast("int")
    width = F.pow(F.lit(2.0), level) * hour
    first, last = F.floor(F.col("e0") / width), F.floor(F.col("e1") / width)
    eb = (
        e.where("NOT __open AND e1 >= e0").withColumn("__lvl", level)
        .withColumn("__bin", F.explode(F.sequence(first, last)))
    )
    wb = w.withColumn("__lvl", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    wb = wb.withColumn("__bin", F.floor(F.col("w0") / (F.pow(F.lit(2.0), F.col("__lvl")) * hour)))
    running = wb.join(eb, ["machine", "__lvl", "__bin"]).where("e0 < w0 AND e1 >= w0")
    cols = [key, "machine", "w0", "w1", *[c for c in events.columns if c not in (key, "machine")]]
    return inside.select(*cols).unionByName(running.select(*cols))


def open_before(
    windows: DataFrame, events: DataFrame, key: str, pre_min: int = 15, post_min: int = 5, *, slice_s: int | None = None
) -> DataFrame:
    """(key, machine, source, category, n_open): standing events that began before each padded window.

    A running count over time per machine, source and category; categories without any are left out.
    """
    w = padded(windows, pre_min, post_min)
    e = standing(w, events).where("__open")
    by = ["machine", "source", "category"]
    asked = w.select(key, "machine", "w0").join(e.select(*by).distinct(), "machine")
    out = sweep(asked, by, F.col("w0"), [(e, F.col("e0"), {"n_open": ("count", F.col("e0"))})], feed_first=False, slice_s=slice_s)
    return out.where("n_open > 0").select(key, *by, "n_open")
