"""Found items against a search of every substring within the edit budget."""

import random

import numpy as np
import pyarrow as pa

from millwright.llm import decontamination as dc
from millwright.llm.common import text_buffer


def fold(text):
    buf, offsets = dc.folded(*text_buffer(pa.array([text], pa.string())))
    return buf.tobytes()


def sellers(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
        row, best = new, min(best, new[-1])
    return best


def test_folding():
    buf, offsets = dc.folded(*text_buffer(pa.array(["  A-b,\nC! ", "", None, "!!", "x", " Ünï 7"], pa.string())))
    assert [buf[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])] == ["a b c", "", "", "", "x", "Ünï 7"]


def test_equals_brute_force(spark, docs):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(10 + i, prose(rng.randint(2, 40))) for i in range(12)] + [(90, None), (91, "a"), (92, ""), (93, "x" * 30)]
    rows = []
    for i in range(80):
        text = prose(rng.randint(0, 60))
        if i % 2:
            item = list(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, max(1, len(item) // 7))):
                p = rng.randrange(len(item))
                item[p : p + rng.randint(0, 1)] = rng.choice(["", "z", " "])
            text += "\n" + "".join(item).upper() + ", " + prose(rng.randint(0, 30))
        rows.append((i, text))
    rows += [(200, None), (201, ""), (202, items[0][1]), (203, "x" * 300)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: dict(zip(r.item_ids, r.edits)) for r in dc.contamination(docs([*rows, (None, items[0][1])]), bench).collect()}
    assert got.pop(None) == {}
    want = {}
    for i, t in rows:
        want[i] = {}
        for k, x in items:
            x = fold(x)
            if len(x) >= dc.Q:
                e = int(dc.budget(np.array([len(x)]), dc.Q, dc.RATE)[0])
                d = sellers(x, fold(t))
                if d <= e:
                    want[i][k] = d
    assert got == want
    assert sum(map(bool, want.values())) > 20


def test_several_blocks_and_empty_tables(spark, docs, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 2)
    items = [(i, f"question number {i} about the colour of the {i} sky") for i in range(5)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs([(1, items[3][1] + " and more"), (2, "nothing here"), (1, items[0][1])])
    got = sorted((r.doc_id, r.contaminated, 3 in r.item_ids) for r in dc.contamination(df, bench).collect())
    assert got == [(1, True, True), (1, True, True), (2, False, False)]
    assert dc.contamination(df.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in dc.contamination(df, bench.limit(0)).collect())
