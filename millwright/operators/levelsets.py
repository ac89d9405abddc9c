"""Merge trees: the runs above every threshold at once, from one pass over the rows.

Rows stand in time order; at a threshold, the rows at or above it whose neighbours lie within a gap form a run. As the
threshold falls, runs are born at peaks, grow at their ends and merge. `merge_tree` lets rows in from the highest level down
and notes each shape of a run once, with the levels at which it stands; there are at most about two per row, however many
thresholds are asked. A slice sends on its shapes; those near its borders are stitched to the next slices' per level.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timex import US_PER_S, floor_div
from .scan import slice_seconds


def neighbours(level: np.ndarray) -> tuple[list[int], list[int]]:
    """For each row the nearest row on either side that is let in before it: higher, or of its level and earlier.

    A linked list loses the rows in the opposite order; what it holds around a row then is what is in before the row.
    """
    n = len(level)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    for i in np.lexsort((np.arange(n), -level))[::-1].tolist():
        a, b = left[i], right[i]
        if a >= 0:
            right[a] = b
        if b >= 0:
            left[b] = a
    return left, right


def merge_tree(at: np.ndarray, level: np.ndarray, height: np.ndarray, gap: int) -> list[tuple[int, int, int, int, int]]:
    """Shapes of runs (first row, last row, highest row, lowest level, highest level); level 0 is below all thresholds."""
    n = len(at)
    left, right = neighbours(level)
    times, levels, heights = at.tolist(), level.tolist(), height.tolist()
    parent, first, last, peak, since = list(range(n)), list(range(n)), list(range(n)), list(range(n)), levels[:]
    shapes = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in np.lexsort((np.arange(n), -level)).tolist():
        now, a, b = levels[i], left[i], right[i]
        if not now:
            break
        a = root(a) if a >= 0 and times[i] - times[a] <= gap else -1
        b = root(b) if b >= 0 and times[b] - times[i] <= gap else -1
        if a == b != -1:  # inside a run: its shape stays
            parent[i] = a
            continue
        for x in (a, b):
            if x >= 0:
                if since[x] > now:
                    shapes.append((first[x], last[x], peak[x], now + 1, since[x]))
                if heights[peak[x]] > heights[peak[i]]:
                    peak[i] = peak[x]
                parent[x] = i
        first[i], last[i] = first[a] if a >= 0 else i, last[b] if b >= 0 else i
    shapes += [(first[i], last[i], peak[i], 1, since[i]) for i in range(n) if levels[i] and parent[i] == i]
    return shapes


def level_runs(
    df: DataFrame, by: Sequence[str], t: str, order: str, value: str, thresholds: Sequence[float], max_gap_us: int,
    firsts: Mapping[str, Column], lasts: Mapping[str, Column], *, slice_s: int | None = None,
) -> DataFrame:
    """One row per threshold and run: `threshold`, the keys, `peak` and what its first and last row hold.

    `order` numbers the rows of a key in the order of `t`. Values of `firsts` must not fall and those of `lasts`
    not rise against it, so that a stitched run takes the least and the greatest. A null value is in no run.
    """
    levels = np.array(sorted(float(x) for x in thresholds))
    width = slice_seconds(df, slice_s) * US_PER_S
    rows = df.where(F.col(value) >= float(levels[0])).select(
        *by, F.unix_micros(t).alias("__us"), F.col(order).alias("__order"), F.col(value).alias("__value"),
        *[c.alias(f"__f_{n}") for n, c in firsts.items()], *[c.alias(f"__l_{n}") for n, c in lasts.items()],
    )
    rows = rows.withColumn("__slice", floor_div(F.col("__us"), width))
    shape = rows.select(
        *by, F.col("__us").alias("__from"), F.col("__us").alias("__to"), F.col("__value").alias("peak"), F.lit(0).alias("__low"),
        F.lit(0).alias("__high"), F.lit(False).alias("__open"),
        *[F.col(f"__f_{n}").alias(n) for n in firsts], *[F.col(f"__l_{n}").alias(n) for n in lasts],
    ).schema
    begins, ends = list(firsts), list(lasts)

    def tree(table: pa.Table) -> pa.Table:
        table = table.sort_by("__order")
        at, height = table["__us"].to_numpy(), table["__value"].cast(pa.float64()).to_numpy()
        height = np.where(np.isnan(height), np.inf, height)
        found = np.array(merge_tree(at, np.searchsorted(levels, height, side="right"), height, max_gap_us), np.int64)
        a, b, top, low, high = found.T
        day = table["__slice"][0].as_py() * width
        near = (at[a] - day <= max_gap_us) | (day + width - at[b] <= max_gap_us)
        columns = [table[c].take(pa.array(a)) for c in by]
        columns += [pa.array(at[a]), pa.array(at[b]), table["__value"].take(pa.array(top)), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(near)]
        columns += [table[f"__f_{n}"].take(pa.array(a)) for n in begins] + [table[f"__l_{n}"].take(pa.array(b)) for n in ends]
        return pa.Table.from_arrays(columns, names=shape.names)

    shapes = rows.groupBy(*by, "__slice").applyInArrow(tree, shape)
    shapes = shapes.withColumn("__level", F.explode(F.sequence("__low", "__high")))
    whole = shapes.where(~F.col("__open"))
    # borders: at most two open runs per key, slice and level; runs of one level are in order and apart
    w = Window.partitionBy(*by, "__level").orderBy("__from")
    fresh = F.coalesce((F.col("__from") - F.lag("__to").over(w) > max_gap_us).cast("bigint"), F.lit(1))
    pieces = shapes.where("__open").withColumn("__fresh", fresh)
    pieces = pieces.withColumn("__run", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stitched = pieces.groupBy(*by, "__level", "__run").agg(
        F.max("peak").alias("peak"), *[F.min(n).alias(n) for n in begins], *[F.max(n).alias(n) for n in ends]
    )
    names = [*by, "__level", "peak", *begins, *ends]
    runs = whole.select(*names).unionByName(stitched.select(*names))
    return runs.withColumn("threshold", F.lit(levels.tolist())[F.col("__level") - 1]).drop("__level")
