"""Whitening against direct integer arithmetic and a plain eigen-decomposition."""

from __future__ import annotations

import math

import numpy as np
import pytest

from millwright.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("rows, low, high", [(1, 0, 5), (63, -9, 9), (64, 10**6 - 40, 10**6 + 40), (200, -(2**59), 2**59), (5, 7, 8)])
def test_scatter_is_exact(rows, low, high):
    x = np.random.default_rng(rows).integers(low, high, (rows, 6))
    sums, products = whitening.scatter(x)
    big = x.astype(object)
    assert sums.tolist() == big.sum(axis=0).tolist()
    assert products.tolist() == (big.T @ big).tolist()


def test_limbs_of_negative_sums():
    for v in (0, -1, 2**100 + 5, -(2**99) - 7):
        assert sum(x << 32 * k for k, x in enumerate(whitening.limbs(v))) == v


def test_equals_direct_computation(spark):
    rng = np.random.default_rng(3)
    data = (rng.normal(size=(500, 40)) @ rng.normal(size=(40, 40)) * 3).astype(np.float32)
    good = [(i, v.tolist()) for i, v in enumerate(data)]
    good += [(None, good[0][1]), (7, good[9][1]), (7, good[9][1])]  # null id, ids and rows that repeat
    odd = [(900, None), (901, [None] + [1.0] * 39), (902, [float("nan")] * 40), (903, [float("inf")] * 40), (904, [1.0]), (905, [])]
    got = whitening.whiten(frame(spark, good + odd)).collect()
    x = np.floor(np.array([v for _, v in good], np.float64) * 64).astype(int) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    assert len(got) == n * 32 and {r["n"] for r in got} == {n}
    centred = x - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    want = centred @ vectors / np.sqrt(values)
    rows = {}
    for r in got:
        rows.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    deviations = ((n * x - s) ** 2).sum(axis=1)
    sign = None
    for k, (i, _) in enumerate(good):
        mine = rows[i, int(deviations[k])]
        line = np.array([mine[c][0]["whitened"] for c in range(1, 33)])
        sign = np.sign(line * want[k]) if sign is None else sign
        assert np.allclose(line, want[k] * sign, atol=1e-8)
        assert np.allclose([mine[c][0]["explained"] for c in range(1, 33)], values / np.trace(centred.T @ centred / n), rtol=1e-9)
    assert {r["identity_error"] for r in got} and max(r["identity_error"] for r in got) < 1e-9


def test_far_entries_and_few_dimensions(spark):
    rows = [(1, [1e30, 0.5]), (2, [-3.0, 0.25]), (3, [0.0, -8.5]), (4, [2.0, 1.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r["n"] for r in got} == {4} and all(math.isfinite(r["whitened"]) for r in got)
    far = [r["deviation"] for r in got if r["vec_id"] == 1]
    assert far and set(far) == {None}


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [2.0]), (2, [2.0])], [(1, [])]):
        assert whitening.whiten(frame(spark, rows)).collect() == []
