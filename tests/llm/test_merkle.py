"""Merkle manifest against a brute-force tree, and the multiproof against per-leaf proofs."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from millwright.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, grp int"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x) -> str:
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(row, lower=False) -> str:
    text = row["text"]
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return h(field(row["doc_id"]), field(row["source"]), field(row["lang"]), field(row["n_chars"]), field(text))


def climb(digests: list[str]) -> tuple[str, list[list[tuple[int, list[str]]]]]:
    paths = [[] for _ in digests]
    at = list(range(len(digests)))
    while len(digests) > 1:
        for k, p in enumerate(paths):
            run = digests[at[k] // 8 * 8 : at[k] // 8 * 8 + 8]
            p.append((at[k] % 8, run[: at[k] % 8] + run[at[k] % 8 + 1 :]))
            at[k] //= 8
        digests = [h(*digests[i : i + 8]) for i in range(0, len(digests), 8)]
    return digests[0], paths


def brute(rows: list[dict]) -> list[tuple]:
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        mine = sorted(groups[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees.append((mine, *climb([leaf(r) for r in mine])))
    root, tops = climb([t[1] for t in trees])
    out = []
    for (mine, subroot, paths), top in zip(trees, tops, strict=True):
        for r, p in zip(mine, paths, strict=True):
            steps = [*p, *top]
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            now = leaf(r, changed)
            for at, rest in steps:
                now = h(*rest[:at], now, *rest[at:])
            out.append((r["doc_id"], leaf(r), subroot, root, h(*[x for _, rest in steps for x in rest]), now, now == root))
    return out


def rows_of(n: int, langs: list, seed: int = 1) -> list[dict]:
    rng = random.Random(seed)
    return [{
        "doc_id": rng.choice([None, i, i, i, i % 7 - 3]), "text": rng.choice([None, "", "Ab ÉC" * rng.randint(1, 5), "no capital"]),
        "lang": rng.choice(langs), "source": rng.choice([None, "Web", ""]), "n_chars": rng.choice([None, i]), "leaf": "x", "grp": 3,
    } for i in range(n)]


@pytest.mark.parametrize("n, levels, langs", [
    (0, 1, ["a"]), (1, 1, [None]), (1, 4, ["de"]), (9, 1, ["a"]), (300, 1, [None, "", "de", "é", "z", "zz"]),
    (700, 2, ["en"] * 9 + [None, "fr"]), (400, 1, [f"l{i}" for i in range(70)]),
])
def test_equals_brute_force(spark, n, levels, langs):
    rows = rows_of(n, langs)
    rows += rows[:3]  # whole rows repeat
    got = merkle.manifest(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA), levels=levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(rows) if rows else []))


def test_long_text(spark):
    row = {"doc_id": 8, "text": "Ä long Text " * 300_000, "lang": "en", "source": "s", "n_chars": 1, "leaf": "", "grp": 0}
    got = merkle.manifest(spark.createDataFrame([tuple(row.values())], SCHEMA))
    assert [tuple(x) for x in got.collect()] == brute([row])


@pytest.mark.parametrize("size", [1, 2, 8, 9, 65, 513, 600])
def test_multiproof_is_least_and_sufficient(size):
    rng = random.Random(size)
    digests = [h(str(i)) for i in range(size)]
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    root, paths = climb(digests)
    for count in {1, max(1, size // 3), size}:
        mine = rng.sample(range(size), count)
        asked = merkle.missing(mine, size)
        assert len(asked) == len(set(asked))
        derived = {(k, i // 8**k) for i in mine for k in range(len(levels))}
        needed = {(k, j) for i in mine for k in range(len(levels) - 1) for j in range(i // 8**k // 8 * 8, min(len(levels[k]), i // 8**k // 8 * 8 + 8))}
        assert set(asked) == needed - derived
        families = merkle.expand({i: digests[i].encode() for i in mine}, {(k, i): levels[k][i].encode() for k, i in asked}, size)
        for i in mine:
            steps = merkle.path(families, i)
            assert [(a, "".join(r)) for a, r in paths[i]] == [(a, r.decode()) for a, r in steps]
            assert merkle.fold(digests[i].encode(), steps).decode() == root
