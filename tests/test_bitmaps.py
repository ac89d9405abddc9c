"""Rotating bitmaps against a plain count of shifted places."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwright.operators import bitmaps


def brute(cells, shifts, size):
    out = []
    for turn in range(len(next(iter(shifts.values())))):
        hit = Counter((b + shifts[m][turn]) % size for m, b in cells)
        out.append(sum(1 for n in hit.values() if n >= 2))
    return out


@pytest.mark.parametrize("size", [1, 5, 63, 64, 65, 128, 200, 70_000])
def test_overlay_equals_counting(spark, size):
    rng = random.Random(size)
    machines = [f"m{i}" for i in range(7)]
    cells = {(m, rng.randrange(size)) for m in machines for _ in range(min(size, 300))} | {("m0", 0), ("m1", size - 1)}
    shifts = {m: [0, size - 1, *(rng.randrange(3 * size) for _ in range(9))] for m in machines}
    rows = spark.createDataFrame([(m, b, size) for m, b in cells] * 2, "machine string, b_idx long, h long").repartition(5)
    table = spark.createDataFrame(list(shifts.items()), "machine string, shifts array<long>")
    got = bitmaps.overlaid(bitmaps.bitmaps(rows, "machine", "b_idx", "h").join(table, "machine"), "h", "shifts").orderBy("turn").collect()
    assert [r["places"] for r in got] == brute(cells, shifts, size)


def test_turning_moves_every_place_once():
    rng = np.random.default_rng(1)
    size, words = 500, np.arange(8)
    bits = rng.integers(0, 2**63, 8).astype(np.uint64)
    bits[-1] &= np.uint64((1 << size - 7 * 64) - 1)
    places = {w * 64 + i for w, b in zip(words, bits, strict=True) for i in range(64) if int(b) >> i & 1}
    for shift in (0, 1, 63, 64, 437, 499):
        seen = []
        for target, value in bitmaps.turned(words, bits, np.array([shift]), size):
            seen += [t * 64 + i for t, v in zip(target[0], value[0], strict=True) for i in range(64) if int(v) >> i & 1]
        assert sorted(seen) == sorted((p + shift) % size for p in places)


def test_planes_are_done_in_parts(spark, monkeypatch):
    monkeypatch.setattr(bitmaps, "PLANE_BYTES", 1)
    rows = spark.createDataFrame([("a", 3, 40_000), ("b", 39_999, 40_000), ("a", 7, 40_000)], "machine string, b_idx long, h long")
    maps = bitmaps.bitmaps(rows, "machine", "b_idx", "h").withColumn(
        "shifts", F.when(F.col("machine") == "a", F.array(F.lit(0), F.lit(39_996))).otherwise(F.array(F.lit(4), F.lit(39_997))).cast("array<bigint>")
    )
    assert {r["turn"]: r["places"] for r in bitmaps.overlaid(maps, "h", "shifts").collect()} == {0: 1, 1: 0}
