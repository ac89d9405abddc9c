"""Removed sentences against a brute-force pass over all runs in order."""

import cProfile
import random
import re
from zlib import crc32

from pyspark.sql import functions as F

from millwright.llm import sentence_spans as ss


def brute(rows, span, least):
    seen, out = set(), {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        tiles = ss.sentences(t or "")
        words = [" ".join((t or "")[a:b].lower().split()) for a, b in tiles]
        gone = set()
        for s in range(len(words) - span + 1):
            run = tuple(words[s : s + span])
            if sum(len(x.split()) for x in run) < least:
                continue
            if run in seen:
                gone |= set(range(s, s + span))
            seen.add(run)
        kept = t if not gone else "".join(t[a:b] for k, (a, b) in enumerate(tiles) if k not in gone)
        out[i] = (kept, len(tiles), len(gone))
    return out


def test_tiles():
    text = "One two.  Three four!\n\nFive, six. 3.14 is a number\nlast"
    assert [text[a:b] for a, b in ss.sentences(text)] == ["One two.  ", "Three four!\n\n", "Five, six. ", "3.14 is a number\n", "last"]
    long = "a b c d e f g h, " * 3 + "end."
    assert len(ss.sentences(long)) == 4 and ss.sentences("") == []


def test_equals_brute_force(spark, docs):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4)))
    line = lambda: " ".join(word() for _ in range(rng.randint(1, 18))) + rng.choice([". ", "! ", "?\n", ".\n\n", "\n"])
    pool = [[line() for _ in range(n)] for n in (1, 2, 3, 5, 8)]
    rows = []
    for i in rng.sample(range(1000), 150):
        parts = [line() for _ in range(rng.randint(0, 6))]
        for _ in range(rng.randint(0, 2)):
            parts += rng.choice(pool) + [line()]
        rows.append((i, "".join(parts)))
    rows += [(2000, None), (2001, ""), (2002, rows[0][1].upper()), (2003, rows[1][1] * 3)]
    got = {r.doc_id: (r.text, r.n_sentences, r.n_removed) for r in ss.remove_spans(docs([*rows, (None, rows[0][1])])).collect()}
    assert got.pop(None) == (rows[0][1], len(ss.sentences(rows[0][1])), 0)
    assert got == brute(rows, ss.SPAN, ss.MIN_WORDS)


def test_repeated_rows_extra_columns_and_empty(docs):
    text = "this is the first sentence of them all here. and this would be the second sentence of it.\n"
    df = docs([(1, text), (1, text), (2, text), (1, "other")]).withColumn("list", F.lit(1)).withColumn("n_removed", F.lit("x"))
    got = sorted((r.doc_id, r.n_removed, r.lang, r.list) for r in ss.remove_spans(df).collect())
    assert got == [(1, 0, "en", 1), (1, 0, "en", 1), (1, 0, "en", 1), (2, 2, "en", 1)]
    assert ss.remove_spans(df.limit(0)).count() == 0


def test_short_sentences_and_single_ones(docs):
    """Passages of short sentences, exact copies of one sentence and parts of sentences without commas all go."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    short, plain, one = "".join(f"{w}.!! " for w in some(50)), " ".join(some(100)), " ".join(some(10))
    rows = [(1, short), (2, f"{word()} {word()}. {short}{word()}."), (3, one), (4, one), (5, f"{one} {word()}")]
    rows += [(6, " ".join([*some(40), plain, *some(40)])), (7, " ".join([*some(60), plain, *some(20)])), (8, "yes."), (9, "yes."), (10, "")]
    got = {r.doc_id: r.text for r in ss.remove_spans(docs(rows), grow=True).collect()}
    assert [got[i] for i in (1, 3, 5, 6, 8, 10)] == [rows[i - 1][1] for i in (1, 3, 5, 6, 8, 10)]
    assert not set(got[2].split()) & set(short.split()) and len(got[2].split()) == 3
    assert got[4] == got[9] == ""
    assert set(rows[6][1].split()) - set(plain.split()) <= set(got[7].split()) and len(set(got[7].split()) & set(plain.split())) < 40


def test_last_run_grows_backwards(docs):
    """Short last sentences of copies go as well, and a text that only ends alike keeps what stands before its last run."""
    words = iter(f"w{i}" for i in range(1000))
    some = lambda n: " ".join(next(words) for _ in range(n)) + ". "
    assert ss.bounds([15, 3, 3], 2, 12, True) == [(0, 2), (0, 3)] and ss.bounds([6, 6, 5], 2, 12, True) == [(0, 2), (0, 3)]
    assert ss.bounds([9, 8, 7, 5, 1], 2, 12, True) == [(0, 2), (1, 3), (2, 4), (2, 5)]
    assert ss.bounds([9, 8, 7, 5, 1], 2, 12, False) == [(0, 2), (1, 3), (2, 4)]
    first, second, end = some(15) + some(3) + some(3), some(6) + some(6) + some(5), some(14) + some(2) + some(1)
    rows = [(1, first), (2, first.upper()), (3, second), (4, second), (5, some(13) + end), (6, some(16) + end)]
    got = {r.doc_id: r.text for r in ss.remove_spans(docs(rows), grow=True).collect()}
    assert got[2] == got[4] == "" and got[1] == first and got[5] == rows[4][1]
    assert got[6] == rows[5][1][: -len(end)]


def test_clashing_names_and_a_very_long_text(spark):
    copy = "this is the first sentence of them all here. and this would be the second sentence of it.\n"
    long = " ".join(f"word{i}" for i in range(200_000))
    rows = [(1, copy, "a"), (2, copy, "b"), (3, long, "c"), (4, f"before. {long}", "d"), (5, None, None)]
    names = ["id", "body", "text"]
    df = spark.createDataFrame(rows, "id long, body string, text string")
    for n in ("doc", "list", "at", "c0", "c1", "h", "g", "first"):
        df, names = df.withColumn(n, F.lit(n)), [*names, n]
    out = ss.remove_spans(df, key="id", text="body", grow=True)
    assert out.columns == [*names, "n_sentences", "n_removed"]
    got = {r.id: r for r in out.collect()}
    assert got[2].body == "" and got[3].body == long and len(got[4].body) < 500 and got[5].body is None
    assert [got[i].text for i in range(1, 6)] == ["a", "b", "c", "d", None]
    assert all(r[n] == n for r in got.values() for n in names[3:])


def by_patterns(text):
    """The tiles by regular expressions on the characters."""
    def cut(start, end, at):
        edges = [start, *(m.end() for m in re.finditer(at, text[:end]) if m.start() > start and m.end() < end), end]
        return list(zip(edges, edges[1:])) if start < end else []

    long = lambda a, b: len(text[a:b].split()) > ss.LONG
    out = []
    for a, b in cut(0, len(text), r"(?<=[.!?])\s+|\s*\n\s*"):
        for c, d in cut(a, b, r"(?<=,)\s+") if long(a, b) else [(a, b)]:
            edges = [c, d]
            if long(c, d):
                words = list(re.finditer(r"\S+\s*", text[c:d]))
                edges[1:1] = [c + m.end() for m in words[:-1] if crc32(m[0].strip().lower().encode()) % ss.PIECE == 0]
            out += zip(edges, edges[1:])
    return out


def test_sentences_of_odd_texts():
    rng = random.Random(6)
    gaps = ["\n", " ", "  ", "\t", "\r\n", " \n\n ", "\x0b", "\x1c", "\x85", "\xa0", " ", "　"]
    words = ["Bc.", "d,", "!", "İ.", "ΑΣ", "Σ,", ",", ".", "ǅ!", "̇", "a​", "日本。", "﻿", "😀?"]
    for _ in range(3000):
        odd, text = rng.random(), rng.choice(["", *gaps])
        for _ in range(rng.choice([0, 1, 3, 20, 60])):
            text += rng.choice(words) if rng.random() < odd / 2 else f"W{rng.randrange(99)}"
            text += rng.choice(gaps) if rng.random() < odd else " "
        text = text if rng.random() < 0.5 else text.rstrip()
        tiles = ss.sentences(text)
        assert tiles == by_patterns(text), repr(text)
        found, ends = ss.split(text)
        assert found == text.lower().split()
        assert [b - a for a, b in zip([0, *ends], ends)] == [n for n in (len(text[a:b].split()) for a, b in tiles) if n]


def test_calls_a_word():
    """Splitting and hashing take few calls for each word, however long sentences and clauses are."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5)) + rng.choice(["", "", "", ",", "."] if rng.random() < 0.4 else [""])
    text = " ".join(word() for _ in range(20_000))
    profile = cProfile.Profile()
    profile.runcall(ss.runs, text, 2, 12, True)
    assert sum(x.callcount for x in profile.getstats()) < 3 * 20_000
