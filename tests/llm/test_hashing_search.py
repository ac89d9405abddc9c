"""Multi-index hashing against brute force: lookups exactly, answers by recall."""

from __future__ import annotations

import numpy as np
import pytest

from millwright.llm import hashing_search as search

SCHEMA = "vec_id long, embedding array<float>, row int, code string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k, every):
    good = [(i, np.array(v, np.float64)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    table, out = np.array([v for _, v in good]), {}
    ids = np.array([np.inf if i is None else i for i, _ in good])
    for at, (i, v) in enumerate(good):
        if i is not None and i % every == 0:
            score = (table * v).sum(axis=1)
            score[at] = -np.inf
            order = np.lexsort((ids, -score))[: min(k, len(good) - 1)]
            out.setdefault(i, []).append([(good[o][0], score[o]) for o in order])
    return out


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: [x[1:] for x in sorted(v, key=lambda x: x[0])] for q, v in out.items()}


@pytest.mark.parametrize("bits, rows", [([8, 8, 8, 8], 400), ([64, 64, 64, 64], 300), ([16, 16, 16, 16], 3000)])
def test_lookup_finds_every_code_within_the_radius(bits, rows):
    rng = np.random.default_rng(rows)
    low = np.array([(1 << b) - 1 for b in bits], np.uint64)
    base = rng.integers(0, 2**63, (20, 4)).astype(np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (rows, 4, 3)).astype(np.uint64), axis=2)
    codes = (base[rng.integers(0, 20, rows)] ^ flips) & low
    index = search.Index(codes, bits)
    for radius in [0, 1, 2, 3, 4, 7, 9, 14, 30, 90, sum(bits)]:
        for q in codes[:15]:
            assert index.within(q, radius).tolist() == np.flatnonzero(search.distance(codes, q) <= radius).tolist()


def test_masks_are_enumerated_only_where_fewer():
    assert search.masks(64, 1, 1000).tolist() == [0, *(1 << b for b in range(64))]
    assert search.masks(64, 2, 2000) is None and len(search.masks(64, 2, 3000)) == 1 + 64 + 2016
    assert all(sum(search.shares(r)) == r - 3 for r in range(3, 256))


@pytest.mark.parametrize("kind", ["random", "clustered", "norms"])
def test_recall_and_scores(spark, kind):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(3000, 32))
    if kind == "clustered":
        data = data[rng.integers(0, 30, 3000)] + 0.2 * data
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    if kind == "norms":
        data *= rng.uniform(0.5, 2.0, (3000, 1))
    rows = [(i, v) for i, v in enumerate(data.astype(np.float32).tolist())]
    got, want = answers(search.nearest(frame(spark, rows), block=500, query_block=64)), brute(rows, 20, 20)
    assert got.keys() == want.keys()
    hits = 0
    for q, (near,) in want.items():
        assert len(got[q]) == 20 and got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
        exact = dict((i, float(np.float64(rows[q][1]) @ np.float64(rows[i][1]))) for i, _ in got[q])
        assert all(abs(exact[i] - s) < 1e-12 for i, s in got[q])
        hits += len({i for i, _ in near} & exact.keys())
    assert hits / (20 * len(want)) >= 0.95


def test_copies_ties_and_odd_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(60)] + [(100 + i, [float(i), 1.0]) for i in range(30)]  # most are one vector
    rows += [(None, [1.0, 2.0]), (20, [0.5, 0.5]), (400, None), (420, []), (440, [0.0, 0.0]), (460, [1.0, None]), (480, [float("nan"), 1.0]), (500, [1.0])]
    got = search.nearest(frame(spark, rows)).collect()
    want = brute([r for r in rows if r[1] != [1.0]], 20, 20)
    flat = sorted((q, k + 1, i, s) for q, lists in want.items() for near in lists for k, (i, s) in enumerate(near))
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == flat


def test_fewer_candidates_than_asked(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, -1.0])]
    got = answers(search.nearest(frame(spark, rows)))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [20, 3], 20: [0, 3]}
    for rows in ([], [(0, [1.0])], [(0, None)], [(1, [1.0]), (3, [2.0])]):
        assert search.nearest(frame(spark, rows)).collect() == []
