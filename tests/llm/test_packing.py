"""Encoding against the library, best fit against a plain loop, bounds against exact packings of small inputs."""

import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from millwright.llm import packing
from millwright.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")
ODD = "abcXYZ éñßüÄÖ   \n\n\t\r\x1c\x1f\x85\xa0'sdtlm0123½²ªº!?$%&<|>_-—“”…中文かなбвгαβςσΣİ 　​́eİıſKÅ,."


def test_ids_equal_the_library():
    rng = random.Random(1)
    rows = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    rows += ["", "a <|endoftext|> b <|ENDOFTEXT|>", "word, word. words,, 'tis don't x's", "Q" * 5000]
    tokenizer = Tokenizer.from_file(PATH)
    for text, e in zip(rows, tokenizer.encode_batch(rows, add_special_tokens=False), strict=True):
        assert packing.encode(text, PATH) == np.array(e.ids, "<u4").tobytes(), text


def exact(sizes, capacity):
    """Least number of bins by search."""
    def go(rest, free):
        if not rest:
            return len(free)
        best, seen = 99, set()
        for i, f in enumerate(free):
            if f >= rest[0] and f not in seen:
                seen.add(f)
                best = min(best, go(rest[1:], [*free[:i], f - rest[0], *free[i + 1 :]]))
        return min(best, go(rest[1:], [*free, capacity - rest[0]]))

    return go(sorted(sizes, reverse=True), [])


def test_bounds_and_best_fit():
    rng = random.Random(2)
    for _ in range(150):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 8))]
        where, offset, bins = packing.best_fit_decreasing(np.array(sizes), 20)
        least = exact(sizes, 20)
        assert packing.lower_bound(np.bincount(sizes, minlength=21), 20) <= least <= bins
        for b in range(bins):
            spans = sorted((offset[i], offset[i] + sizes[i]) for i in range(len(sizes)) if where[i] == b)
            assert spans[0][0] == 0 and spans[-1][1] <= 20 and all(x[1] == y[0] for x, y in itertools.pairwise(spans))
    assert packing.lower_bound(np.bincount([11] * 6, minlength=21), 20) == 6  # volume alone says 4


def test_pack_of_documents(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 64)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["tree", "house", "x", "extraordinary", "12"]) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(900, None), (901, ""), (1, rows[1][1]), (1, rows[1][1]), (None, "no key"), (None, "no key")]
    got = packing.pack(packing.pieces(docs(rows), PATH, capacity=32), capacity=32).toPandas()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 32
    want = {}
    for i, t in rows:
        ids = packing.encode(t or "", PATH) + b"\0\0\0\0"
        for n, at in enumerate(range(0, len(ids), 128)):
            part = ids[at : at + 128]
            want.setdefault((i, n, at // 4, len(part) // 4, zlib.crc32(part)), []).append(1)
    have = {}
    for r in got.itertuples():
        key = (None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)
        have.setdefault(key, []).append(1)
    assert have == want
    least = packing.lower_bound(np.bincount(got["length"], minlength=33), 32)
    assert got["sequence_id"].nunique() <= 1.03 * least + 2


def test_empty(docs):
    cut = packing.pieces(docs([(1, "a")]).limit(0), PATH)
    assert packing.pack(cut).count() == 0
    assert [tuple(r)[:4] for r in packing.pack(packing.pieces(docs([(1, None)]), PATH)).collect()] == [(1, 0, 0, 1)]


@pytest.mark.parametrize("n", [2047, 2048, 2049])
def test_only_longer_documents_are_cut(docs, n):
    got = packing.pieces(docs([(1, "x " * (n - 1))]), PATH).collect()
    assert [r.length for r in got] == ([n] if n <= 2048 else [2048, n - 2048])
