"""Exact ranking metrics as distributed aggregations over distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timex import value_slice
from .scan import running


def _folded(rows: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """One row per distinct score with its positives, rows and the totals of its group."""
    v = rows.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("p"), F.count(F.lit(1)).alias("n")
    )
    tot = v.groupBy(*by).agg(F.sum("p").alias("pos"), F.sum("n").alias("tot"))
    return v.join(tot, by).withColumn("__slice", value_slice(F.col("score"), 1024))


def pr_points(rows: DataFrame, by: list[str], score: str = "risk", label: str = "y") -> DataFrame:
    """Precision and recall at every distinct score (predict positive at or above it)."""
    v = _folded(rows, by, score, label)
    cum = running(v, by, [F.col("score").desc()], "__slice", {"tp": ("sum", F.col("p")), "flagged": ("sum", F.col("n"))}, reverse=True)
    prec = F.col("tp") / F.col("flagged")
    rec = F.when(F.col("pos") > 0, F.col("tp") / F.col("pos"))
    return cum.select(*by, "score", "tp", "flagged", "p", "pos", "tot", prec.alias("precision"), rec.alias("recall"))


def average_precision(points: DataFrame, by: list[str]) -> DataFrame:
    """Sum of recall steps times precision; the step at a score is its own positives."""
    return points.groupBy(*by).agg(
        F.when(F.max("pos") > 0, F.sum(F.col("p") / F.col("pos") * F.col("precision"))).alias("pr_auc")
    )


def roc_auc(rows: DataFrame, by: list[str], score: str = "risk", label: str = "y") -> DataFrame:
    """Rank-sum statistic with tie-averaged ranks; NULL when only one class is present."""
    v = _folded(rows, by, score, label)
    cum = running(v, by, [F.col("score").asc()], "__slice", {"cum": ("sum", F.col("n"))})
    avg_rank = F.col("cum") - F.col("n") + (F.col("n") + 1) / 2.0
    pos, neg = F.max("pos"), F.max("tot") - F.max("pos")
    u = F.sum(avg_rank * F.col("p")) - pos * (pos + 1) / 2.0
    return cum.groupBy(*by).agg(F.when((pos > 0) & (neg > 0), u / (pos * neg)).alias("roc_auc"))


def f1_of(tp: Column, flagged: Column, pos: Column) -> Column:
    """2PR/(P+R) written with counts, which has no division by zero inside."""
    return F.when((flagged + pos) > 0, 2.0 * tp / (flagged + pos)).otherwise(0.0)


def f1_thresholds(points: DataFrame, by: list[str]) -> DataFrame:
    """Score with the best F1, and the operating threshold one distinct score below it.

    The published operating point takes the curve position just before the maximum, which is the
    next lower distinct score; at the lowest score it stays. Ties of F1 go to the lowest score.
    """
    f1 = f1_of(F.col("tp"), F.col("flagged"), F.col("pos"))
    p = points.withColumn("f1", F.bround(f1, 12))
    best = p.groupBy(*by).agg(F.max(F.struct(F.col("f1"), (-F.col("score")).alias("neg"))).alias("b"))
    best = best.select(*by, F.col("b.f1").alias("best_f1"), (-F.col("b.neg")).alias("best_score"))
    below = p.join(best, by).groupBy(*by, "best_f1", "best_score").agg(
        F.max(F.when(F.col("score") < F.col("best_score"), F.col("score"))).alias("lower")
    )
    return below.select(*by, "best_f1", "best_score", F.coalesce("lower", "best_score").alias("threshold"))


def confusion(rows: DataFrame, by: list[str], thresholds: DataFrame | None = None, fixed: float = 0.5, score: str = "risk", label: str = "y") -> DataFrame:
    """Counts and rates at one threshold per group."""
    r = rows
    if thresholds is not None:
        r = r.join(thresholds.select(*by, "threshold"), by, "left")
        r = r.withColumn("threshold", F.coalesce("threshold", F.lit(fixed)))
    else:
        r = r.withColumn("threshold", F.lit(float(fixed)))
    hit, pos = F.col(score) >= F.col("threshold"), F.col(label) == 1
    g = r.groupBy(*by, "threshold").agg(
        F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"),
        F.count_if(hit & pos).alias("tp"), F.avg(F.col(label).cast("double")).alias("base_rate"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    zero = F.lit(0.0)
    return g.select(
        "*", F.coalesce(F.try_divide(tp, tp + fp), zero).alias("precision"),
        F.coalesce(F.try_divide(tp, tp + fn), zero).alias("recall"),
        F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), zero).alias("f1"),
    )


def report(rows: DataFrame, by: list[str], score: str = "risk", label: str = "y", fixed: float | None = None) -> DataFrame:
    """All metrics of each model (group): base rate, AP, AUC, lift and the operating point."""
    pts = pr_points(rows, by, score, label)
    ap, auc = average_precision(pts, by), roc_auc(rows, by, score, label)
    if fixed is None:
        # a constant score has no curve to choose from: the default threshold stays
        varied = pts.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.max("pos").alias("pp")).where("k > 1 AND pp > 0")
        th = f1_thresholds(pts, by).join(varied.select(*by), by, "left_semi")
        c = confusion(rows, by, th, 0.5, score, label)
    else:
        c = confusion(rows, by, None, fixed, score, label)
    lift = F.when(F.col("base_rate") > 0, F.col("pr_auc") / F.col("base_rate"))
    return c.join(ap, by).join(auc, by).withColumn("lift", lift)
