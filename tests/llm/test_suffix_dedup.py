"""Removed bytes against a brute-force search of every string of the given length."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from millwright.llm import suffix_dedup


def brute(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is None:
            continue
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1) if i is not None else ():
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abéstn") for _ in range(rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(n)) for n in (5, 12, 20, 40, 90)]
    rows = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), " ".join(word() for _ in range(rng.randint(0, 25)))]
        rows.append((i * 7 % 120, " ".join(parts)))
    rows += [(500 + i, rows[3][1]) for i in range(5)] + [(600, rows[5][1] + "x"), (601, "x" + rows[5][1])]
    rows += [(700, None), (701, ""), (702, "short"), (703, "ab" * 60), (704, "ab" * 90), (705, shared[-1] * 3)]
    rows += [(20, rows[9][1] + " more"), (20, rows[10][1]), (None, rows[11][1])]  # repeated and missing ids
    return rows


@pytest.mark.parametrize(("seed", "limit"), [(1, 20_000), (2, 3)])
def test_equals_brute_force(spark, docs, seed, limit):
    rows = corpus(seed)
    got = suffix_dedup.remove_repeats(docs(rows), texts=False, limit=limit)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows, 50)


def test_texts_and_other_columns(docs):
    line = "an agreeable line of prose that is longer than fifty bytes in all, surely"
    df = docs([(2, f"own{line}end"), (1, line), (3, None)]).withColumn("list", F.lit(7)).withColumn("n_spans", F.lit("x"))
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(df).collect()}
    assert got[1].text == line and got[2].text == "ownend" and got[3].text is None
    assert (got[2].n_removed, got[2].n_spans, got[2].source) == (len(line), 1, "s")


def test_empty_table(docs):
    assert suffix_dedup.remove_repeats(docs([(1, "")]).limit(0), texts=False).count() == 0


def test_clashing_names_and_a_very_long_text(spark):
    line = "an agreeable line of prose that is longer than fifty bytes in all, surely"
    long = " ".join(str(i * i) for i in range(100_000))
    rows = [(1, line, "a"), (2, f"own{line}end", "b"), (3, long, "c"), (4, f"x{long}y", "d")]
    df, names = spark.createDataFrame(rows, "id long, body string, text string"), ["id", "body", "text"]
    for n in ("doc", "list", "at", "c0", "c1", "mh"):
        df, names = df.withColumn(n, F.lit(n)), [*names, n]
    out = suffix_dedup.remove_repeats(df, key="id", text="body")
    assert out.columns == [*names, "n_bytes", "n_removed", "n_spans"]
    got = {r.id: r for r in out.collect()}
    assert (got[1].body, got[2].body, got[3].body, got[4].body) == (line, "ownend", long, "xy")
    assert [got[i].text for i in range(1, 5)] == ["a", "b", "c", "d"]
    assert all(r[n] == n for r in got.values() for n in names[3:])
