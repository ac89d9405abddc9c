"""Recovered differences against set differences; successors against a plain sort."""

import hashlib
import random

import numpy as np
import pytest

from millwright.llm import fingerprints as fp


def test_difference_equals_sets():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 5)))
    left, right = [], []
    for n in (0, 1, 3, 10, 200, 4000, 5, 5):
        x = [word() for _ in range(n)]
        y = [w if rng.random() > 0.1 else word() for w in x] + [word() for _ in range(rng.randint(0, 5))]
        left.append("\n".join(" ".join(x[i : i + 9]) for i in range(0, n, 9)))
        right.append("\n".join(" ".join(y[i : i + 9]) for i in range(0, len(y), 9)))
    left, right = [*left, "same same same"], [*right, "same same same"]
    a, b = fp.digests(left), fp.digests(right)
    only_a, only_b = fp.difference(*a, *b)
    for i in range(len(left)):
        x, y = (set(k[o[i] : o[i + 1]].tolist()) for k, o in (a, b))
        assert len(x) == np.diff(a[1])[i]
        assert (only_a[i], only_b[i]) == (len(x - y), len(y - x))
        assert fp.likeness(*a, *b)[i] == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)


@pytest.mark.parametrize("rows", [2, 1024])
def test_next_by_descending_id(spark, docs, rows):
    rng = random.Random(2)
    given = [(i, f"text of {i}") for i in rng.sample(range(10_000), 60)] + [(77_777, None), (-5, "")]
    got = {r.doc_id: (r.text, r.next) for r in fp.with_next(docs(given), "doc_id", "text", rows).collect()}
    order = sorted(given, reverse=True)
    assert got == {i: (t or "", order[(k + 1) % len(order)][1] or "") for k, (i, t) in enumerate(order)}


def test_contract(spark, docs):
    given = [(3, "alpha beta gamma delta\nepsilon zeta"), (2, "alpha beta gamma delta\nepsilon zeta"), (1, "ünïcode täxt"), (0, None)]
    got = {r.doc_id: r for r in fp.fingerprints(docs(given)).collect()}
    assert got[3].fingerprint == got[2].fingerprint and got[3].near_next == 1.0
    for i, t in given:
        t, n = t or "", dict(given)[(i - 1) % 4] or ""
        half = len(t) // 2
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1
    assert fp.fingerprints(docs(given[:1])).first().near_next == 1.0
    assert fp.fingerprints(docs(given).limit(0)).count() == 0
    assert fp.fingerprints(docs([(1, "a b"), (None, "c d"), (None, "c d"), (1, "a b")])).count() == 4
