"""Irregular telemetry to a regular feature grid, one row per machine and non-empty bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timex import US_PER_S, at, floor_us, us
from .scan import sweep

COUNTERS = ("run_time", "production_count")
PER_SIGNAL = (*COUNTERS, "axis_position")
FEATURES = [
    "run_time_delta", "production_count_delta", "cycle_time_mean", "cycle_time_std", "axis_move_total",
    "axis_move_max", "run_state_duty", "machine_mode_last", "machine_mode_changes",
]
IDLE_DUTY = 0.05


def _bucket_stats(readings: DataFrame, width: int) -> DataFrame:
    """First level: one row per machine, role, bucket and sub-key.

    The sub-key is the signal for counters and axes, the mode value for machine_mode and empty
    otherwise, so distinct counts and standard deviations come out of plain hash aggregation with
    map-side combine; a hot bucket is folded before it is shuffled.
    """
    role = F.col("role")
    sub = F.when(role.isin(*PER_SIGNAL), F.col("readingdef_uid")).when(
        role == "machine_mode", F.col("value").cast("string")
    )
    v = F.col("value")
    return (
        readings.withColumn("b", floor_us(us("time"), width)).withColumn("sub", sub)
        .groupBy("machine", "role", "sub", "b")
        .agg(
            F.count(F.lit(1)).alias("n"), F.max(v).alias("mx"), F.min(v).alias("mn"), F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"), F.avg(F.when(v > 0, 1.0).otherwise(0.0)).alias("duty"),
            F.max(us("time")).alias("t_last"),
        )
    )


def _with_previous(stats: DataFrame, width: int) -> DataFrame:
    """Give each counter bucket the maximum of the immediately preceding bucket, if that one has data.

    Every counter row is sent to its own bucket and, as `prev`, to the next one; both meet in one
    aggregation, which needs neither a window over a signal's history nor a self join.
    """
    own = F.struct(
        F.col("b"), F.lit(True).alias("own"), F.col("mx").alias("cur"), F.lit(None).cast("double").alias("prev")
    )
    nxt = F.struct(
        (F.col("b") + width).alias("b"), F.lit(False).alias("own"), F.lit(None).cast("double").alias("cur"),
        F.col("mx").alias("prev"),
    )
    copies = F.when(F.col("role").isin(*COUNTERS), F.array(own, nxt)).otherwise(F.array(own))
    sent = stats.withColumn("c", F.explode(copies))
    keep = [F.max(F.when(F.col("c.own"), F.col(x))).alias(x) for x in ("n", "mx", "mn", "mean", "std", "duty", "t_last")]
    return (
        sent.select("machine", "role", "sub", F.col("c.b").alias("b"), "c", "n", "mx", "mn", "mean", "std", "duty", "t_last")
        .groupBy("machine", "role", "sub", "b")
        .agg(*keep, F.max("c.cur").alias("cur"), F.max("c.prev").alias("prev"))
    )


def bucket_features(readings: DataFrame, freq_s: int = 60) -> DataFrame:
    """Per-bucket features before the 0-versus-NULL span rule; counter sums are NULL where nothing adds."""
    width = freq_s * US_PER_S
    rows = _with_previous(_bucket_stats(readings, width), width)
    role = F.col("role")

    def of(name: str, c: Column) -> Column:
        return F.when(role == name, c)

    delta = F.greatest(F.col("cur") - F.col("prev"), F.lit(0.0))
    delta = F.when(F.col("cur").isNotNull() & F.col("prev").isNotNull(), delta)
    spread = F.col("mx") - F.col("mn")
    mode = F.when((role == "machine_mode") & F.col("sub").isNotNull() & F.col("n").isNotNull(),
                  F.struct(F.col("t_last"), F.col("mx")))
    return (
        rows.groupBy("machine", "b").agg(
            F.sum(of("run_time", delta)).alias("run_time_delta"),
            F.sum(of("production_count", delta)).alias("production_count_delta"),
            F.max(of("cycle_time", F.col("mean"))).alias("cycle_time_mean"),
            F.max(of("cycle_time", F.col("std"))).alias("cycle_time_std"),
            F.sum(of("axis_position", spread)).alias("axis_move_total"),
            F.max(of("axis_position", spread)).alias("axis_move_max"),
            F.max(of("run_state", F.col("duty"))).alias("run_state_duty"),
            F.max(mode).alias("mode"), F.count(mode).cast("double").alias("machine_mode_changes"),
            F.sum("n").alias("n_samples"),
        )
        .where(F.col("n_samples") > 0)
        .select("*", F.col("mode.mx").alias("machine_mode_last")).drop("mode")
    )


def signal_spans(readings: DataFrame, freq_s: int = 60) -> DataFrame:
    """First and last bucket of every signal (of the role as a whole for machine_mode)."""
    width = freq_s * US_PER_S
    sub = F.when(F.col("role").isin(*PER_SIGNAL), F.col("readingdef_uid"))
    b = floor_us(us("time"), width)
    return (
        readings.where(F.col("role").isin(*PER_SIGNAL, "machine_mode"))
        .groupBy("machine", "role", sub.alias("sub")).agg(F.min(b).alias("lo"), F.max(b).alias("hi"))
    )


def offline_intervals(status: DataFrame, instances: DataFrame) -> DataFrame:
    """Outages of a machine's own instance as [lo, hi] in microseconds."""
    off = status.where(~F.col("is_online") & F.col("started_on").isNotNull())
    return off.join(instances.select("machine", "instance_id"), "instance_id").select(
        "machine", us("started_on").alias("lo"), us(F.coalesce("ended_on", "started_on")).alias("hi")
    )


def feature_grid(
    readings: DataFrame, outages: DataFrame | None = None, freq_s: int = 60, slice_s: int | None = None
) -> DataFrame:
    """The assembled grid with idle and offline flags.

    `readings` carries machine, role, readingdef_uid, time, value. Inside a signal's first..last span
    an empty sum is 0, outside every span it is NULL; spans and outages are resolved in one sweep.
    """
    feats = bucket_features(readings, freq_s)
    spans = signal_spans(readings, freq_s)
    lo, hi = F.col("lo"), F.col("hi")
    roles = {"run_time": "s_run", "production_count": "s_prod", "axis_position": "s_axis", "machine_mode": "s_mode"}
    ends = {name: ("max", F.when(F.col("role") == r, hi)) for r, name in roles.items()}
    feeds = [(spans, lo, ends)]
    if outages is not None:
        feeds.append((outages, lo, {"s_off": ("max", hi)}))
    swept = sweep(feats, ["machine"], F.col("b"), feeds, slice_s=slice_s)

    def inside(name: str) -> Column:
        return F.coalesce(F.col(name) >= F.col("b"), F.lit(False))

    def spanned(col: str, name: str) -> Column:
        return F.when(inside(name), F.coalesce(F.col(col), F.lit(0.0))).alias(col)

    offline = inside("s_off") if outages is not None else F.lit(False)
    return swept.select(
        "machine", at("b").alias("ts"), spanned("run_time_delta", "s_run"),
        spanned("production_count_delta", "s_prod"), "cycle_time_mean", "cycle_time_std",
        spanned("axis_move_total", "s_axis"), "axis_move_max", "run_state_duty", "machine_mode_last",
        spanned("machine_mode_changes", "s_mode"), "n_samples",
        (F.coalesce(F.col("run_state_duty"), F.lit(0.0)) < IDLE_DUTY).alias("is_idle"), offline.alias("is_offline"),
    )


def feature_columns(grid: DataFrame, exclude=("machine", "ts", "n_samples", "is_idle", "is_offline")) -> list[str]:
    """Columns holding at least one value, found in one pass (schema discovery, one row to the driver)."""
    cand = [c for c in grid.columns if c not in exclude]
    counts = grid.agg(*[F.count(c).alias(c) for c in cand]).first()
    return [c for c in cand if counts[c] > 0]


def column_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null count per column in long form."""
    wide = df.agg(*[F.count(c).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return wide.select(F.expr(f"stack({len(columns)}, {pairs}) AS (feature, n)"))
