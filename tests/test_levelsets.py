"""Merge trees against runs found threshold by threshold."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwright.operators import levelsets

GAP = 20


def runs(rows, threshold, gap):
    """(first index, last index, peak) of the runs at one threshold; rows are (time, value) in order."""
    out = []
    for i, (t, v) in enumerate(rows):
        if v is None or v < threshold:
            continue
        if out and t - rows[out[-1][1]][0] <= gap:
            out[-1] = (out[-1][0], i, max(out[-1][2], v))
        else:
            out.append((i, i, v))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_tree_holds_the_runs_of_every_level(seed):
    rng = random.Random(seed)
    t, rows = 0, []
    for _ in range(rng.choice([1, 2, 40, 300])):
        t += rng.choice([0, 1, 5, 19, 20, 21, 60])
        rows.append((t, rng.choice([0.0, 0.2, 0.2, 0.5, 0.9, rng.random()])))
    levels = np.array(sorted({0.1, 0.2, 0.5, 0.95, *(rng.random() for _ in range(20))}))
    at, height = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    shapes = levelsets.merge_tree(at, np.searchsorted(levels, height, side="right"), height, GAP)
    assert len(shapes) <= 2 * len(rows)  # whatever the number of thresholds
    for k, x in enumerate(levels, 1):
        here = sorted((a, b, height[p]) for a, b, p, low, high in shapes if low <= k <= high)
        assert here == runs(rows, x, GAP)


@pytest.mark.parametrize("gap_min, slice_s", [(20, 3600), (90, 3600), (20, 86400), (0, 600)])
def test_runs_across_slices(spark, gap_min, slice_s):
    rng = random.Random(gap_min + slice_s)
    data, want = [], []
    levels = [0.0, 0.3, 0.5, 0.8, 0.99]
    for m in ("a", None, "c"):
        t, rows = 1_700_000_000, []
        for _ in range(150):
            t += 60 * rng.choice([0, 1, 5, 20, 21, 60, 200])
            rows.append((t, rng.choice([None, 0.0, rng.random(), rng.random(), 0.995])))
        data += [(m, t, n, v) for n, (t, v) in enumerate(rows)]
        want += [(x, m, a, b, p, rows[a][0], rows[b][0]) for x in levels for a, b, p in runs(rows, x, gap_min * 60)]
    df = spark.createDataFrame(data, "machine string, s long, rn long, risk double").withColumn("ts", F.timestamp_seconds("s")).repartition(4)
    got = levelsets.level_runs(
        df, ["machine"], "ts", "rn", "risk", levels, gap_min * 60_000_000, {"a": F.col("rn"), "s0": F.col("s")},
        {"b": F.col("rn"), "s1": F.col("s")}, slice_s=slice_s,
    ).select("threshold", "machine", "a", "b", "peak", "s0", "s1")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_no_rows(spark):
    df = spark.createDataFrame([], "machine string, ts timestamp, rn long, risk double")
    assert levelsets.level_runs(df, ["machine"], "ts", "rn", "risk", [0.5], 1, {"a": F.col("rn")}, {"b": F.col("rn")}).collect() == []
