"""Ordered-sequence primitives that never put one key's whole history into one task.

Every machine-level time-series operator (as-of joins, running totals, interval membership,
sessions, ranks, exact percentiles, rolling row frames) is expressed with the few functions here.

The idea is a two-level prefix scan. Rows are shuffled by (key, slice), where the slice is a
monotone coarsening of the order column: a window function runs inside each slice, one small
summary row per (key, slice) is scanned per key to obtain what flows in from earlier slices
(the carry), and the carry is joined back on (key, slice). A key that owns a third of the data
is therefore spread over as many tasks as it has slices, and no pair of rows is ever emitted.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.timex import US_PER_S, floor_div

_AGG = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
_CARRY = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.sum}
SLICE_CONF = "spark.millwright.slice.seconds"
DAY_S = 86_400


def slice_seconds(df: DataFrame, slice_s: int | None) -> int:
    """Width of a time slice; a session setting overrides the default of one day."""
    if slice_s is not None:
        return slice_s
    return int(df.sparkSession.conf.get(SLICE_CONF, str(DAY_S)))


def _by(keys: Sequence[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


_NO_SLICE = -(2**62)


def placed(
    df: DataFrame, keys: Sequence[str], slice_col: str, keep: Sequence[str] | None = None
) -> tuple[DataFrame, list[str], str]:
    """Shuffle rows by (key, slice) on columns that are never NULL, carrying `keep` (default: all but the slice).

    Returns the frame, the names standing for the key (a NULL key is a group of its own) and the slice.
    Because the join back needs no NOT NULL filter on them, both branches of a scan keep one exchange.
    """
    cols, names = [], []
    flags = F.lit(0)
    for i, k in enumerate(keys):
        dtype = df.schema[k].dataType
        blank = F.lit("1970-01-01" if isinstance(dtype, T.DateType) else 0).cast(dtype)
        cols.append(F.coalesce(F.col(k), blank).alias(f"__k{i}"))
        names.append(f"__k{i}")
        flags = flags + F.when(F.col(k).isNull(), 1 << i).otherwise(0)
    if keys:
        cols.append(flags.alias("__kn"))
        names.append("__kn")
    cols.append(F.coalesce(F.col(slice_col).cast("bigint"), F.lit(_NO_SLICE).cast("bigint")).alias("__sl"))
    carried = [c for c in df.columns if c != slice_col] if keep is None else list(keep)
    out = df.select(*[F.col(f"`{c}`") for c in carried], *cols)
    return out.repartition(*names, "__sl"), names, "__sl"


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    slice_col: str,
    aggs: Mapping[str, tuple[str, Column]],
    reverse: bool = False,
    inclusive: bool = True,
    overall: Mapping[str, tuple[str, Column]] | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add running aggregates per key; `slice_col` must be monotone in `order` and is not carried on.

    `order` already carries its directions; `reverse` says that slices are swept downwards.
    `overall` adds whole-key aggregates, taken from the same slice totals.
    The slice totals read the very shuffle the local window reads: the totals touch every column
    (a row hash), so column pruning leaves both branches the same exchange and Spark runs it once.
    """
    keys = list(keys)
    end = Window.currentRow if inclusive else -1
    names = [c for c in df.columns if c != slice_col] if keep is None else list(keep)
    rows, keys, slice_col = placed(df, keys, slice_col, names)
    local = (
        Window.partitionBy(*keys, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    )
    sweep_order = F.col(slice_col).desc() if reverse else F.col(slice_col).asc()
    carry_w = _by(keys).orderBy(sweep_order).rowsBetween(Window.unboundedPreceding, -1)

    touch = F.max(F.xxhash64(*[F.col(f"`{c}`") for c in names])).alias("__touch")
    whole = dict(overall or {})
    totals = rows.groupBy(*keys, slice_col).agg(
        *[_AGG[k](c).alias(f"__t_{o}") for o, (k, c) in {**aggs, **whole}.items()], touch
    )
    carry = totals.select(
        *keys, slice_col, "__touch",
        *[_CARRY[k](f"__t_{o}").over(carry_w).alias(f"__c_{o}") for o, (k, _) in aggs.items()],
        *[_CARRY[k](f"__t_{o}").over(_by(keys)).alias(o) for o, (k, _) in whole.items()],
    )
    out = rows.select("*", *[_AGG[k](c).over(local).alias(f"__l_{o}") for o, (k, c) in aggs.items()])
    carry = carry.where(F.col("__touch").isNotNull()).drop("__touch")
    out = out.join(carry, [*keys, slice_col], "left")
    cols = []
    for o, (k, _) in aggs.items():
        loc, car = F.col(f"__l_{o}"), F.col(f"__c_{o}")
        if k == "max":
            v = F.greatest(loc, car)
        elif k == "min":
            v = F.least(loc, car)
        else:
            v = F.coalesce(loc + car, loc, car)
            if k == "count":
                v = F.coalesce(v, F.lit(0).cast("bigint"))
        cols.append(v.alias(o))
    return out.select(*names, *cols, *whole)


def sweep(
    left: DataFrame,
    by: Sequence[str],
    t: Column,
    feeds: Sequence[tuple[DataFrame, Column, Mapping[str, tuple[str, Column]]]],
    *,
    reverse: bool = False,
    feed_first: bool = True,
    slice_s: int | None = None,
) -> DataFrame:
    """For every left row, aggregate the feed rows met so far in time order.

    A feed is (frame, time in microseconds, {output: ("sum" | "max" | "min" | "count", value)}).
    All feeds ride one shuffle with the left rows. `feed_first` decides equal instants.
    """
    by = list(by)
    width = slice_seconds(left, slice_s) * US_PER_S
    kinds = {n: k for _, _, vals in feeds for n, (k, _) in vals.items()}
    prepared = []
    types = {}
    for f, tt, vals in feeds:
        p = f.select(*by, tt.cast("bigint").alias("__t"), *[v.alias(f"__v_{n}") for n, (_, v) in vals.items()])
        p = p.where(F.col("__t").isNotNull())
        prepared.append(p)
        types.update({n: p.schema[f"__v_{n}"].dataType for n in vals})

    names = left.columns
    rows = left.select(
        *by, t.cast("bigint").alias("__t"), F.lit(1).alias("__s"),
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("__left"),
        *[F.lit(None).cast(dt).alias(f"__v_{n}") for n, dt in types.items()],
    )
    side = F.lit(0 if feed_first else 2).alias("__s")
    for p in prepared:
        rows = rows.unionByName(p.withColumn("__s", side), allowMissingColumns=True)
    rows = rows.withColumn("__slice", floor_div(F.col("__t"), width))
    order = [F.col("__t").desc() if reverse else F.col("__t").asc(), F.col("__s").asc()]
    aggs = {n: (k, F.col(f"__v_{n}")) for n, k in kinds.items()}
    keep = ["__t", "__s", "__left", *[f"__v_{n}" for n in kinds]]
    swept = running(rows, by, order, "__slice", aggs, reverse=reverse, keep=keep)
    known = F.col("__t").isNotNull()
    return swept.where(F.col("__s") == 1).select("__left.*", *[F.when(known, F.col(n)).alias(n) for n in kinds])


def asof(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_t: Column,
    right_t: Column,
    take: Sequence[str],
    *,
    direction: str = "backward",
    exact: bool = True,
    tolerance_us: int | None = None,
    slice_s: int | None = None,
    out: str = "hit",
) -> DataFrame:
    """As-of join: the struct (`t`, *take) of the nearest right row before or after each left row.

    Ties of the right instant are broken by the taken columns in order. `exact=False` is strict.
    """
    forward = direction == "forward"
    value = F.struct(right_t.cast("bigint").alias("t"), *[F.col(c) for c in take])
    res = sweep(
        left, by, left_t, [(right, right_t, {out: ("min" if forward else "max", value)})],
        reverse=forward, feed_first=exact, slice_s=slice_s,
    )
    if tolerance_us is not None:
        gap = F.abs(F.col(f"{out}.t") - left_t.cast("bigint"))
        res = res.withColumn(out, F.when(gap <= tolerance_us, F.col(out)))
    return res


def in_any_interval(
    points: DataFrame,
    intervals: DataFrame,
    by: Sequence[str],
    t: Column,
    start: Column,
    end: Column,
    *,
    slice_s: int | None = None,
    out: str = "inside",
) -> DataFrame:
    """Flag points covered by any closed interval [start, end]; a missing end is a point interval.

    A point is covered exactly when the latest end among intervals already started reaches it.
    """
    e = F.coalesce(end, start).cast("bigint")
    res = sweep(points, by, t, [(intervals, start, {"__reach": ("max", e)})], slice_s=slice_s)
    return res.withColumn(out, F.coalesce(F.col("__reach") >= t.cast("bigint"), F.lit(False))).drop("__reach")


def range_max(
    queries: DataFrame,
    series: DataFrame,
    by: Sequence[str],
    q: Column,
    t: Column,
    value: Column,
    span_us: int,
    *,
    strict: bool = True,
    slice_s: int | None = None,
    out: str = "peak",
) -> DataFrame:
    """Maximum of `value` over (q - span, q), or [q - span, q] when not strict, for every query row.

    Time is cut into blocks of one span; each window is the tail of one block and the head of the
    next, so two running maxima answer it without pairing rows.
    """
    by = list(by)
    sub = slice_s or max(1, span_us // US_PER_S // 4)
    s = (
        series.select(*by, t.cast("bigint").alias("__st"), value.alias("__sv"))
        .groupBy(*by, "__st").agg(F.max("__sv").alias("__sv"))
        .withColumn("__blk", floor_div(F.col("__st"), span_us))
    )
    feed = [(s, F.col("__st"), {"__head": ("max", F.col("__sv"))})]
    head = sweep(
        queries.withColumn("__blk", floor_div(q, span_us)), [*by, "__blk"], q, feed,
        feed_first=not strict, slice_s=sub,
    )
    lo = q - F.lit(span_us)
    both = sweep(
        head.withColumn("__blk", floor_div(lo, span_us)), [*by, "__blk"], lo,
        [(s, F.col("__st"), {"__tail": ("max", F.col("__sv"))})],
        reverse=True, feed_first=not strict, slice_s=sub,
    )
    return both.withColumn(out, F.greatest("__head", "__tail")).drop("__head", "__tail", "__blk")


def attach(rows: DataFrame, scalars: DataFrame) -> DataFrame:
    """Put one-row values next to every row.

    The values pass through a global aggregate, so exactly one row is broadcast whatever they came from.
    """
    one = scalars.agg(*[F.max(c).alias(c) for c in scalars.columns]).withColumn("__one", F.lit(1))
    return rows.withColumn("__one", F.lit(1)).join(F.broadcast(one), "__one").drop("__one")


def row_index(
    df: DataFrame, by: Sequence[str], t: str, *, ties: Sequence[str] = (), slice_s: int | None = None, out: str = "rn",
    overall: Mapping[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Dense 1-based position of each row in its key's time order."""
    width = slice_seconds(df, slice_s) * US_PER_S
    rows = df.withColumn("__slice", floor_div(F.unix_micros(t), width))
    order = [F.col(t).asc(), *[F.col(c).asc() for c in ties]]
    return running(rows, by, order, "__slice", {out: ("count", F.lit(1))}, overall=overall)


def row_blocks(df: DataFrame, rn: str, size: int, halo: int) -> DataFrame:
    """Cut a densely numbered sequence into blocks; the last `halo` rows are copied to the next block.

    `__own` is true on the row's own block only: row frames that reach back at most `halo` rows are
    exact inside a block, and the copies are filtered out afterwards.
    """
    if halo > size:
        raise ValueError("halo must not exceed the block size")
    b = floor_div(F.col(rn) - 1, size)
    tail = F.pmod(F.col(rn) - 1, F.lit(size)) >= F.lit(size - halo)
    copies = F.when(tail, F.array(b, b + 1)).otherwise(F.array(b))
    return df.select("*", F.explode(copies).alias("__b")).withColumn("__own", F.col("__b") == b)


def islands(
    df: DataFrame, by: Sequence[str], t: str, max_gap_us: int, *, slice_s: int | None = None, out: str = "island"
) -> DataFrame:
    """Number maximal runs whose consecutive gaps are at most `max_gap_us` (a gap of exactly that merges).

    Inside a slice only the first row does not know its predecessor; the slice table (first and last
    instant, breaks inside) tells whether it continues the run of the slice before.
    """
    by = list(by)
    width = slice_seconds(df, slice_s) * US_PER_S
    names = df.columns
    rows = df.withColumn("__us", F.unix_micros(t)).withColumn("__slice", floor_div(F.col("__us"), width))
    rows, keys, sl = placed(rows, by, "__slice")
    w = Window.partitionBy(*keys, sl).orderBy("__us")
    step = rows.withColumn("__brk", F.coalesce((F.col("__us") - F.lag("__us").over(w) > max_gap_us).cast("bigint"), F.lit(0)))
    local = step.withColumn("__loc", F.sum("__brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    slices = local.groupBy(*keys, sl).agg(
        F.min("__us").alias("__first"), F.max("__us").alias("__last"), F.max("__loc").alias("__n"),
        F.max(F.xxhash64(*[F.col(f"`{c}`") for c in local.columns])).alias("__touch"),
    )
    ws = _by(keys).orderBy(sl)
    fresh = F.coalesce((F.col("__first") - F.lag("__last").over(ws) > max_gap_us).cast("bigint"), F.lit(1))
    slices = slices.withColumn("__fresh", fresh)
    before = F.coalesce(F.sum(F.col("__n") + F.col("__fresh")).over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = slices.select(*keys, sl, (before + F.col("__fresh")).alias("__off"), "__touch")
    offset = offset.where(F.col("__touch").isNotNull()).drop("__touch")
    joined = local.join(offset, [*keys, sl], "left")
    return joined.select(*names, (F.col("__off") + F.col("__loc")).alias(out))


def value_slices(folded: DataFrame, by: Sequence[str], value: str, steps: int) -> DataFrame:
    """Add `__slice`, the range of its key that a value falls into, with bounds drawn from the data.

    The bounds are approximate quantiles of the distinct values, so each slice holds about a `steps`-th of them whether
    they are narrow, wide or skewed; they only divide the work, so the approximation changes no result.
    """
    cuts = F.percentile_approx(value, [i / steps for i in range(1, steps)], 20 * steps)
    bounds = folded.groupBy(*by).agg(cuts.alias("__cuts"))
    renamed = bounds.select(*[F.col(k).alias(f"__b_{k}") for k in by], "__cuts")
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"__b_{k}"))
    joined = folded.join(renamed, same).drop(*[f"__b_{k}" for k in by])
    place = F.size(F.filter("__cuts", lambda c: c < F.col(value)))
    return joined.withColumn("__slice", place.cast("bigint")).drop("__cuts")


def percentiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float], *, count: str | None = None,
    steps: int = 64,
) -> DataFrame:
    """Exact linear-interpolation percentiles per key, from value counts instead of one group's values.

    Equal values are folded before the shuffle; ranks come from a sliced running count.
    """
    by = list(by)
    if not by:
        one = percentiles(df.withColumn("__all", F.lit(0)), ["__all"], value, probs, count=count, steps=steps)
        return one.drop("__all")
    v = (
        df.where(F.col(value).isNotNull())
        .select(*by, F.col(value).cast("double").alias("__x"))
        .groupBy(*by, "__x").agg(F.count(F.lit(1)).alias("__n"))
    )
    v = value_slices(v, by, "__x", steps)
    ranked = running(
        v, by, [F.col("__x").asc()], "__slice", {"__cum": ("sum", F.col("__n"))}, overall={"__tot": ("sum", F.col("__n"))}
    )
    aggs, outs = [], []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("__tot") - 1)
        for tag, r in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("__cum") - F.col("__n") <= r) & (r < F.col("__cum"))
            aggs.append(F.max(F.when(hit, F.col("__x"))).alias(f"__{tag}_{name}"))
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        outs.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    agg = ranked.groupBy(*by, "__tot").agg(*aggs)
    extra = [F.col("__tot").alias(count)] if count else []
    return agg.select(*by, *outs, *extra)


def rank_share(
    df: DataFrame, by: Sequence[str], value: str, *, steps: int = 64, out: str = "pct"
) -> DataFrame:
    """Average-tie rank divided by the number of non-null values of the key, in (0, 1]."""
    by = list(by)
    if not by:
        return rank_share(df.withColumn("__all", F.lit(0)), ["__all"], value, steps=steps, out=out).drop("__all")
    v = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    )
    v = value_slices(v, by, value, steps)
    joined = running(
        v, by, [F.col(value).asc()], "__slice", {"__cum": ("sum", F.col("__n"))}, overall={"__tot": ("sum", F.col("__n"))}
    )
    share = (F.col("__cum") - F.col("__n") + (F.col("__n") + 1) / 2.0) / F.col("__tot")
    ranks = joined.select(*by, value, share.alias(out))
    return df.join(ranks, [*by, value], "left")


def ewma(
    df: DataFrame, by: Sequence[str], rn: str, value: str, alpha: float, *, block: int = 4096, out: str = "ewma"
) -> DataFrame:
    """Bias-corrected exponentially weighted mean over densely numbered rows; NULLs only decay.

    With q = 1 - alpha, weights q^(t-i) factor as q^t * q^-i, so a running sum inside a block plus the
    decayed block totals before it is the full recursion, without a user function. Blocks are cut short
    enough that the powers stay far from the limits of a double. Until a block's first value the mean is
    the one at the end of the last block that has any, however many blocks back that is.
    """
    if not 0.0 < alpha < 1.0:
        raise ValueError("alpha must lie between 0 and 1")
    by = list(by)
    q = 1.0 - alpha
    block = max(1, min(block, int(300 / -math.log(q))))
    reach = max(1, math.ceil(math.log(1e-20) / (block * math.log(q))))
    b = floor_div(F.col(rn) - 1, block)
    names = [c for c in df.columns if c != "__b"]
    rows, by, blk = placed(df.withColumn("__b", b), by, "__b")
    rows = rows.withColumn("__i", (F.col(rn) - 1 - F.col(blk) * block).cast("double"))
    x = F.col(value).cast("double")
    up = F.pow(F.lit(q), -F.col("__i"))
    local = Window.partitionBy(*by, blk).orderBy(rn).rowsBetween(Window.unboundedPreceding, 0)
    num, den = F.sum(x * up).over(local), F.sum(F.when(x.isNotNull(), up)).over(local)
    end = F.pow(F.lit(q), F.lit(float(block - 1)) - F.col("__i"))
    totals = rows.groupBy(*by, blk).agg(
        F.sum(x * end).alias("__n"), F.sum(F.when(x.isNotNull(), end)).alias("__d"),
        F.max(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])).alias("__touch"),
    )
    wb = _by(by).orderBy(blk)

    def decayed(c):
        """Total of up to `reach` blocks before this one, weighted to the last row of the block before."""
        terms = [F.when(F.lag(blk, k).over(wb) >= F.col(blk) - reach, F.lag(c, k).over(wb)
                        * F.pow(F.lit(q), ((F.col(blk) - F.lag(blk, k).over(wb) - 1) * block).cast("double"))) for k in range(1, reach + 1)]
        total = F.coalesce(terms[0], F.lit(0.0))
        for term in terms[1:]:
            total = total + F.coalesce(term, F.lit(0.0))
        return total

    carry = totals.select("*", decayed("__n").alias("__cn"), decayed("__d").alias("__cd"))
    whole = F.lit(q ** block)
    mean = (F.col("__n") + whole * F.col("__cn")) / (F.col("__d") + whole * F.col("__cd"))
    held = F.last(F.when(F.col("__d") > 0, mean), ignorenulls=True)
    carry = carry.withColumn("__held", held.over(wb.rowsBetween(Window.unboundedPreceding, -1)))
    carry = carry.where(F.col("__touch").isNotNull()).drop("__touch", "__n", "__d")
    res = rows.select("*", num.alias("__ln"), den.alias("__ld")).join(carry, [*by, blk], "left")
    n = F.col("__ln") + F.lit(q) * F.col("__cn")
    d = F.col("__ld") + F.lit(q) * F.col("__cd")
    return res.withColumn(out, F.when(F.col("__ld") > 0, n / d).otherwise(F.col("__held"))).select(*names, out)
