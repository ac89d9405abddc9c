"""Cross-machine detectors: synchronisation against permutation nulls, score coupling, data regimes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timex import US_PER_HOUR, US_PER_S, at, floor_us, half_up, us
from ..session import cut
from .bitmaps import bitmaps, overlaid
from .scan import attach, percentiles, running

REGIME_ROLES = ("cycle_time_mean", "run_state_duty", "run_time_delta", "axis_move_total", "production_count_delta")


def occupancy(stops: DataFrame, bucket_s: int = 3600, min_events: int = 1) -> DataFrame:
    """Sparse 0/1 matrix: distinct (machine, bucket index from the first bucket), plus the range length H."""
    b = floor_us(us("start"), bucket_s * US_PER_S)
    cells = stops.where(F.col("machine").isNotNull()).groupBy("machine", b.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    if min_events > 1:
        busy = cells.groupBy("machine").agg(F.sum("n").alias("t")).where(F.col("t") >= min_events)
        cells = cells.join(busy.select("machine"), "machine", "left_semi")
    rng = cells.agg(F.min("b").alias("b0"), F.max("b").alias("b1"))
    width = bucket_s * US_PER_S
    return attach(cells, rng).select(
        "machine", at("b").alias("bucket_start"), ((F.col("b") - F.col("b0")) / width).cast("bigint").alias("b_idx"),
        ((F.col("b1") - F.col("b0")) / width + 1).cast("bigint").alias("h"),
    )


def co_stops(occ: DataFrame) -> DataFrame:
    """Buckets in which at least two machines stopped."""
    return (
        occ.groupBy("b_idx", "bucket_start").agg(F.count(F.lit(1)).alias("machines")).where(F.col("machines") >= 2)
    )


def _shift(perm: Column, machine: Column, seed: int, modulus: Column) -> Column:
    """Reproducible pseudo-random shift of one machine in one permutation."""
    text = F.concat_ws("|", perm.cast("string"), machine, F.lit(str(seed)))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint"), modulus)


def null_counts(occ: DataFrame, n_perm: int, seed: int, per_day: int | None = None) -> DataFrame:
    """Co-stop buckets of every permutation; circular shifts by any bucket, or by whole days.

    Each machine's buckets are a bitmap that every permutation turns; tasks overlay their machines with saturating
    bit-sliced counters, and only these are shuffled, so no cell is copied per permutation.
    """
    h = F.col("h")
    modulus = h if per_day is None else F.greatest(F.lit(1).cast("bigint"), F.floor(h / per_day))
    step = 1 if per_day is None else per_day
    shifts = F.transform(F.sequence(F.lit(0), F.lit(n_perm - 1)), lambda p: _shift(p, F.col("machine"), seed, modulus) * step)
    maps = bitmaps(occ, "machine", "b_idx", "h").withColumn("shifts", shifts)
    return overlaid(maps, "h", "shifts").select(F.col("turn").alias("perm"), F.col("places").alias("co"))


def synchronization(
    stops: DataFrame, bucket_s: int = 3600, n_perm: int = 400, seed: int = 0, min_events: int = 1,
    nulls: Sequence[str] = ("free_shift", "daily_preserving"),
) -> DataFrame:
    """Observed co-stop buckets against each null: expectation, deviation, z and p."""
    occ = occupancy(stops, bucket_s, min_events)
    per_day = max(1, round(86400 / bucket_s))
    obs = co_stops(occ).agg(F.count(F.lit(1)).alias("observed"))
    size = occ.agg(F.max("h").alias("buckets"), F.count_distinct("machine").alias("machines"))
    out = None
    for name in nulls:
        nd = null_counts(occ, n_perm, seed, per_day if name == "daily_preserving" else None)
        s = attach(nd, obs).groupBy("observed").agg(
            F.avg("co").alias("expected"), F.stddev_pop("co").alias("sd0"),
            F.avg((F.col("co") >= F.col("observed")).cast("double")).alias("p"),
        )
        sd = F.col("sd0") + 1e-9
        s = s.select(
            F.lit(name).alias("null_model"), "observed", "expected", sd.alias("sd"),
            ((F.col("observed") - F.col("expected")) / sd).alias("z"), "p",
        )
        out = s if out is None else out.unionByName(s)
    return attach(out, size)


def hour_concentration(occ: DataFrame) -> DataFrame:
    """Share of co-stop buckets per hour of day with its rank; the top three hours add up to the headline share."""
    hod = co_stops(occ).groupBy(F.hour("bucket_start").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    tot = hod.agg(F.sum("n").alias("t"))
    # at most 24 rows from here on
    ranked = attach(hod, tot).withColumn(
        "rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("n").desc(), F.col("hour")))
    )
    return ranked.select("hour", "n", (F.col("n") / F.col("t")).alias("share"), F.col("rank").cast("bigint").alias("rank"),
                         (F.col("rank") <= 3).alias("busiest"))


def reason_granularity(stops: DataFrame, bucket_s: int = 3600) -> DataFrame:
    """How many reasons exist at all: with one, reason agreement across machines says nothing."""
    co = stops.groupBy(floor_us(us("start"), bucket_s * US_PER_S).alias("b")).agg(F.count_distinct("machine").alias("m"))
    a = stops.agg(F.count_distinct("label").alias("reasons"))
    b = co.agg(F.count_if(F.col("m") >= 2).alias("co_stop_buckets"))
    return attach(a, b).select("reasons", "co_stop_buckets", (F.col("reasons") <= 1).alias("vacuous"))


def hourly_scores(scores: DataFrame, mode: str = "running") -> DataFrame:
    """Mean score per machine and hour: all buckets, live ones, or live and running ones."""
    s = scores
    if mode in ("live", "running"):
        s = s.where(~F.coalesce(F.col("is_offline"), F.lit(False)))
    if mode == "running":
        s = s.where(~F.coalesce(F.col("is_idle"), F.lit(False)))
    h = floor_us(us("ts"), US_PER_HOUR)
    return s.groupBy("machine", h.alias("h")).agg(F.avg("score").alias("score")).where(F.col("score").isNotNull())


def first_differences(hourly: DataFrame) -> DataFrame:
    """Change against the previous hour present for any machine; missing on either side gives no row.

    Hours are numbered over the calendar of present hours, and each value is sent to its own index and
    to the next one, where both meet in one aggregation.
    """
    hours = hourly.groupBy("h").agg(F.lit(1).alias("x")).withColumn("__slice", floor_us(F.col("h"), 24 * US_PER_HOUR))
    idx = running(hours, [], [F.col("h").asc()], "__slice", {"i": ("count", F.lit(1))}).select("h", "i")
    v = hourly.join(idx, "h")
    sent = v.withColumn("c", F.explode(F.array(
        F.struct(F.col("i").alias("i"), F.col("score").alias("cur"), F.lit(None).cast("double").alias("prev")),
        F.struct((F.col("i") + 1).alias("i"), F.lit(None).cast("double").alias("cur"), F.col("score").alias("prev")),
    )))
    g = sent.groupBy("machine", F.col("c.i").alias("h")).agg(F.max("c.cur").alias("cur"), F.max("c.prev").alias("prev"))
    return g.where("cur IS NOT NULL AND prev IS NOT NULL").select("machine", "h", (F.col("cur") - F.col("prev")).alias("score"))


def pair_moments(hourly: DataFrame, hours_per_task: int = 168, machines_per_task: int = 512) -> DataFrame:
    """Additive moments of every machine pair, from dense blocks of one week of hours.

    The result itself has one row per pair; blocks turn the per-hour pairing into matrix products, so
    what is shuffled is one row per pair and block instead of one per pair and hour. Machines are dealt
    into groups, and a task takes two groups of one week: it holds at most about twice `machines_per_task`
    machines, however many there are, and each hourly value is sent once to every group's tasks.
    """
    block = F.floor(F.col("h") / hours_per_task)
    groups = max(1, -(-hourly.select("machine").distinct().count() // machines_per_task))
    own = F.pmod(F.xxhash64("machine"), F.lit(groups)).cast("int")

    def gram(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="h", columns="machine", values="score", aggfunc="mean").sort_index(axis=1)
        side = pdf.groupby("machine")["g"].first().reindex(wide.columns).to_numpy()
        x = wide.to_numpy(dtype=float)
        ok = ~np.isnan(x)
        z = np.where(ok, x, 0.0)
        k = ok.astype(float)
        n, sx, sxy, sxx = k.T @ k, z.T @ k, z.T @ z, (z * z).T @ k
        ia, ib = np.triu_indices(x.shape[1], 1)
        if key[1] != key[2]:  # pairs inside a group belong to that group's own task
            across = side[ia] != side[ib]
            ia, ib = ia[across], ib[across]
        names = wide.columns.to_numpy()
        out = pd.DataFrame({
            "a": names[ia], "b": names[ib], "n": n[ia, ib], "sa": sx[ia, ib], "sb": sx.T[ia, ib],
            "saa": sxx[ia, ib], "sbb": sxx.T[ia, ib], "sab": sxy[ia, ib],
        })
        return out[out["n"] > 0]

    rows = hourly.select("machine", "h", "score", block.cast("bigint").alias("blk"), own.alias("g"))
    dealt = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumns({"i": F.least("g", "o"), "j": F.greatest("g", "o")})
    parts = dealt.groupBy("blk", "i", "j").applyInPandas(
        gram, "a string, b string, n double, sa double, sb double, saa double, sbb double, sab double"
    )
    return parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])


def coupling_pairs(hourly: DataFrame, min_overlap: int = 50) -> DataFrame:
    """Pearson correlation of every machine pair with enough common hours (a < b)."""
    hour_index = hourly.select("machine", F.col("h"), "score")
    # centre per machine first: correlation is unchanged and the moments stay small
    means = hour_index.groupBy("machine").agg(F.avg("score").alias("mu"))
    centred = hour_index.join(means, "machine").select("machine", "h", (F.col("score") - F.col("mu")).alias("score"))
    m = pair_moments(centred).where(F.col("n") >= min_overlap)
    n = F.col("n")
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    va, vb = F.col("saa") - F.col("sa") ** 2 / n, F.col("sbb") - F.col("sb") ** 2 / n
    r = F.when((va > 1e-12) & (vb > 1e-12), cov / F.sqrt(va * vb))
    return m.select("a", "b", n.cast("bigint").alias("n"), r.alias("r")).where(F.col("r").isNotNull())


def by_hour_index(hourly: DataFrame) -> DataFrame:
    """Hours as whole numbers since the epoch, the unit `pair_moments` blocks on."""
    return hourly.withColumn("h", (F.col("h") / US_PER_HOUR).cast("bigint"))


def coupling(scores: DataFrame, modes: Sequence[str] = ("all", "live", "running"), min_overlap: int = 50) -> DataFrame:
    """Pairs for levels and first differences in each mode."""
    out = None
    for mode in modes:
        hs = hourly_scores(scores, mode)
        for kind, series in (("level", by_hour_index(hs)), ("diff", first_differences(hs))):
            p = coupling_pairs(series, min_overlap).select(F.lit(mode).alias("mode"), F.lit(kind).alias("kind"), "a", "b", "n", "r")
            out = p if out is None else out.unionByName(p)
    return out


def coupling_summary(pairs: DataFrame) -> DataFrame:
    """Median and maximum correlation and the two strongest pairs per mode and kind."""
    from .kpi import top_per_group

    keys = ["mode", "kind"]
    med = percentiles(pairs, keys, "r", {"median_r": 0.5, "p90_r": 0.9}, steps=256)
    mx = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.max("r").alias("max_r"))
    best = top_per_group(pairs, keys, [F.col("r").desc(), F.col("a"), F.col("b")], 2).groupBy(*keys).agg(
        F.max(F.when(F.col("position") == 1, F.concat_ws("~", "a", "b"))).alias("first_pair"),
        F.max(F.when(F.col("position") == 2, F.concat_ws("~", "a", "b"))).alias("second_pair"),
    )
    return mx.join(med, keys).join(best, keys)


def clusters(pairs: DataFrame, thr: float = 0.5) -> DataFrame:
    """Connected components of machines linked at r >= thr, as (machine, cluster = smallest member).

    Labels jump along two hops per round (own minimum, then the minimum of that label's own label), so
    rounds grow with the logarithm of a component's diameter; each round is cut by a checkpoint on
    shared storage, which also lets the loop survive a lost executor. It ends when no label moves.
    """
    e = pairs.where(F.col("r") >= thr).select("a", "b")
    edges = cut(e.union(e.select("b", "a")).toDF("src", "dst").distinct())
    labels = cut(edges.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("label")).withColumnRenamed("src", "node"))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        nxt = (
            labels.join(near, "node", "left").join(hop, "label", "left")
            .select("node", F.least("label", "near", "far").alias("new"), F.col("label").alias("old"))
        )
        nxt = cut(nxt)
        moved = nxt.where("new <> old").limit(1).count()
        labels = nxt.select("node", F.col("new").alias("label"))
        if not moved:
            break
    return labels.select(F.col("node").alias("machine"), F.col("label").alias("cluster"))


def availability(grid: DataFrame, master: DataFrame, roles: Sequence[str] = REGIME_ROLES) -> DataFrame:
    """Buckets, live buckets and non-empty counts per role; machines without rows join in as zeros."""
    g = grid.groupBy("machine").agg(
        F.count(F.lit(1)).alias("buckets"), F.count_if(~F.coalesce(F.col("is_offline"), F.lit(False))).alias("live_buckets"),
        *[F.count(c).alias(c) for c in roles],
    )
    names = master.select(F.col("name").alias("machine"))
    return names.join(g, "machine", "full").fillna(0, ["buckets", "live_buckets", *roles])


def regime_map(avail: DataFrame, roles: Sequence[str] = REGIME_ROLES, min_buckets: int = 500) -> DataFrame:
    """Machines with the same pattern of sufficiently present roles form one data regime."""
    present = F.filter(F.array(*[F.when(F.col(c) >= min_buckets, F.lit(c)) for c in roles]), lambda x: x.isNotNull())
    pattern = F.when(F.size(present) == 0, "(blind)").otherwise(F.array_join(present, ", "))
    return avail.select("machine", pattern.alias("regime")).groupBy("regime").agg(
        F.count(F.lit(1)).alias("n_machines"), F.array_sort(F.collect_list("machine")).alias("machines")
    )


def comparability(grid: DataFrame, roles: Sequence[str] = REGIME_ROLES) -> DataFrame:
    """Spread of positive per-machine medians of each role shared by at least two machines."""
    from .anomaly import melt

    med = percentiles(melt(grid, roles, ("machine",)), ["machine", "feature"], "value", {"m": 0.5}).where(F.col("m") > 0)
    g = med.groupBy(F.col("feature").alias("role")).agg(
        F.count(F.lit(1)).alias("machines"), F.min("m").alias("median_min"), F.max("m").alias("median_max")
    )
    return g.where(F.col("machines") >= 2).withColumn("spread_x", half_up(F.col("median_max") / F.col("median_min"), 1))


def heterogeneity(grid: DataFrame, column: str = "cycle_time_mean") -> DataFrame:
    """Count and 10 / 50 / 90 % points of one role per machine."""
    return percentiles(grid, ["machine"], column, {"p10": 0.1, "median": 0.5, "p90": 0.9}, count="n")


def coupling_survival(scores: DataFrame, min_overlap: int = 50) -> DataFrame:
    """Correlation quantiles before and after offline removal."""
    p = None
    for mode in ("all", "live"):
        x = coupling_pairs(by_hour_index(hourly_scores(scores, mode)), min_overlap).select(F.lit(mode).alias("mode"), "r")
        p = x if p is None else p.unionByName(x)
    q = percentiles(p, ["mode"], "r", {"median_r": 0.5, "p90_r": 0.9}, count="pairs", steps=256)
    return q.join(p.groupBy("mode").agg(F.max("r").alias("max_r")), "mode")
