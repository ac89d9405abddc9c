"""Merging flagged rows into windows and episodes, thinning series, linking windows to labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timex import US_PER_HOUR, US_PER_MIN, US_PER_S, at, floor_div, floor_us, half_even, us
from .levelsets import level_runs
from .scan import asof, islands, row_index, running, slice_seconds


def extract_windows(
    scores: DataFrame, *, thresh: float = 90.0, merge_gap_min: float = 10, min_len: int = 1, carry: str = "top_roles"
) -> DataFrame:
    """Merge buckets scoring at least `thresh` whose gaps are at most `merge_gap_min` minutes.

    Offline buckets are ignored; `carry` is taken from the highest-scoring bucket that has it.
    """
    hot = scores.where(F.col("score") >= thresh)
    if "is_offline" in scores.columns:
        hot = hot.where(~F.coalesce(F.col("is_offline"), F.lit(False)))
    rows = islands(hot, ["machine"], "ts", int(merge_gap_min * US_PER_MIN))
    aggs = [
        F.min("ts").alias("window_start"), F.max("ts").alias("window_end"), F.max("score").alias("peak_score"),
        F.count(F.lit(1)).alias("n_buckets"),
    ]
    if "score_ae" in scores.columns:
        ae, base = F.count("score_ae") > 0, F.count("score_baseline") > 0
        aggs.append(F.when(ae & base, "both").when(ae, "ae").otherwise("baseline").alias("detector"))
    if carry in scores.columns:
        best = F.max(F.when(F.col(carry).isNotNull(), F.struct(F.col("score"), F.col(carry))))
        aggs.append(best[carry].alias(carry))
    return rows.groupBy("machine", "island").agg(*aggs).where(F.col("n_buckets") >= min_len).drop("island")


def link_labels(windows: DataFrame, labels: DataFrame, horizon_min: int = 360) -> DataFrame:
    """First labelled event starting in [window_end, window_end + horizon], lead measured from window_start."""
    lab = labels.select("machine", us("started_on").alias("__at"), "label_text")
    hit = asof(
        windows, lab, ["machine"], us("window_end"), F.col("__at"), ["label_text"], direction="forward",
        tolerance_us=horizon_min * US_PER_MIN, out="__lab",
    )
    lead = (F.col("__lab.t") - us("window_start")) / float(US_PER_MIN)
    return hit.select(
        *windows.columns, F.col("__lab.label_text").alias("nearest_label"), half_even(lead, 1).alias("lead_time_min")
    )


def risk_episodes(
    scored: DataFrame, thresholds: float | Sequence[float], *, merge_gap_min: int = 20, min_buckets: int = 3,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Episodes of risk at or above a threshold, for one or many thresholds in one job (see `levelsets`).

    Positions, labels and risk are accumulated once over all rows of a machine, so the size, mean and
    hit of an episode (which include the rows below the threshold inside it) are differences of
    accumulations at its first and last row; no row is joined back. Risk sums are exact decimals.
    """
    many = [float(thresholds)] if isinstance(thresholds, (int, float)) else sorted({float(x) for x in thresholds})
    width = slice_seconds(scored, None) * US_PER_S
    rows = scored.select("machine", "ts", "risk", "y", *[c for c in ties if c not in ("machine", "ts", "risk", "y")])
    rows = rows.withColumn("__slice", floor_div(us("ts"), width)).withColumn("__r", F.col("risk").cast("decimal(18,12)"))
    order = [F.col("ts").asc(), *[F.col(c).asc() for c in ties]]
    acc = running(
        rows, ["machine"], order, "__slice",
        {"rn": ("count", F.lit(1)), "cy": ("sum", F.col("y").cast("bigint")), "cr": ("sum", F.col("__r"))},
    )
    g = level_runs(
        acc, ["machine"], "ts", "rn", "risk", many, merge_gap_min * US_PER_MIN,
        {"start": F.col("ts"), "a": F.col("rn"), "y0": F.col("cy") - F.col("y"), "r0": F.col("cr") - F.col("__r")},
        {"end": F.col("ts"), "b": F.col("rn"), "y1": F.col("cy"), "r1": F.col("cr")},
    )
    n = F.col("b") - F.col("a") + 1
    return g.where(n >= min_buckets).select(
        "threshold", "machine", "start", "end", F.col("peak").alias("peak_risk"),
        ((F.col("r1") - F.col("r0")).cast("double") / n).alias("mean_risk"), n.alias("n_buckets"),
        (F.col("y1") > F.col("y0")).alias("hit"),
    )


def downsample_max(df: DataFrame, value: str, seconds: int) -> DataFrame:
    return df.groupBy("machine", at(floor_us(us("ts"), seconds * US_PER_S)).alias("ts")).agg(F.max(value).alias(value))


def systematic_sample(df: DataFrame, by: Sequence[str], ts: str, ties: Sequence[str], target: int) -> DataFrame:
    """Every n-th row of each group so that about `target` rows remain."""
    rows = row_index(df, by, ts, ties=ties, overall={"__n": ("count", F.lit(1))})
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / target))
    return rows.where(F.pmod(F.col("rn") - 1, step) == 0).drop("__n", "rn")


def score_coverage(scores: DataFrame, score: str = "score", thresh: float = 90.0) -> DataFrame:
    aggs = [
        F.count(F.lit(1)).alias("buckets"),
        F.avg(F.when(F.col(score) >= thresh, 100.0).otherwise(0.0)).alias("flagged_pct"),
    ]
    if "is_offline" in scores.columns:
        aggs.append(F.avg(F.when(F.col("is_offline"), 100.0).otherwise(0.0)).alias("offline_pct"))
    return scores.groupBy("machine").agg(*aggs)


def hour_of(ts: str):
    return at(floor_us(us(ts), US_PER_HOUR))
