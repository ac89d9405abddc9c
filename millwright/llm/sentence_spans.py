"""Substring deduplication by sliding spans of sentences.

Every run of SPAN consecutive sentences is hashed and the hashes are joined over all documents. A run of fewer than
MIN_WORDS words grows by further sentences until it has them, the last one of a text backwards, or does not count without
`grow`. Of equal runs the first stands, by document id and place; the sentences of every later one are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, ranges, slices, staged, texts

SPAN = 2
MIN_WORDS = 12
LONG = 16
"""A sentence of more words is cut at its commas, and a clause of more words after one word in PIECE, chosen by its hash.
The clauses and pieces count as sentences."""
PIECE = 8
_WORD = re.compile(r"\S+")


def split(text: str) -> tuple[list[str], list[int]]:
    """The lower-case words of a text and, for each of its sentences, the number of words up to its end.

    A sentence ends with a line or with a word that ends in a stop. Where a piece of a long clause ends follows from the
    hash of its last word, so that the same words are cut alike wherever they stand.
    """
    words: list[str] = []
    ends: list[int] = []
    for line in text.lower().split("\n"):
        start = len(words)
        words += line.split()
        last = len(words)
        if start == last:
            continue
        stops = [k for k, w in enumerate(words[start:], start + 1) if w[-1] in ".!?"]
        if not stops or stops[-1] != last:
            stops.append(last)
        for stop in stops:
            if stop - start <= LONG:
                ends.append(stop)
            else:
                _clauses(words, start, stop, ends)
            start = stop
    return words, ends


def _clauses(words: list[str], start: int, stop: int, ends: list[int]) -> None:
    commas = [k for k, w in enumerate(words[start : stop - 1], start + 1) if w[-1] == ","]
    for end in [*commas, stop]:
        if end - start > LONG:
            ends += [k for k, w in enumerate(words[start : end - 1], start + 1) if not crc32(w.encode("utf-8", "surrogatepass")) % PIECE]
        ends.append(end)
        start = end


def sentences(text: str) -> list[tuple[int, int]]:
    """Ranges that tile the text: each sentence with the white space after it."""
    return _tiles(text, split(text)[1])


def _tiles(text: str, ends: list[int]) -> list[tuple[int, int]]:
    if not text:
        return []
    starts = [m.start() for m in _WORD.finditer(text)]
    edges = [0, *(starts[k] for k in ends[:-1]), len(text)]
    return list(zip(edges, edges[1:]))


def tag(text: str) -> int:
    """24 bits that tell apart the texts of one key."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=3).digest())


def bounds(counts: list[int], span: int, min_words: int, grow: bool) -> list[tuple[int, int]]:
    """(first, end) of every run that counts in sentences of so many words.

    With `grow` the last run begins early enough to reach the end, and a text too short for any run is one run by itself.
    """
    before = [0, *accumulate(counts)]
    out, j = [], 0
    for i in range(len(counts) - span + 1):
        least = before[i] + min_words
        if j < i + span or not grow:
            j = i + span
        while grow and before[j] < least and j < len(counts):
            j += 1
        if before[j] >= least:
            out.append((i, j))
    if grow and out and out[-1][1] < len(counts):
        i = len(counts) - span
        while before[-1] - before[i] < min_words:
            i -= 1
        out.append((i, len(counts)))
    return [(0, len(counts))] if grow and not out and before[-1] else out


def _counts(ends: list[int]) -> list[int]:
    return [b - a for a, b in zip([0, *ends], ends)]


def runs(text: str, span: int, min_words: int, grow: bool = False) -> list[bytes]:
    """128-bit hash of every run that counts, in order. Case and white space do not matter.

    A whole text too short for any run equals whole texts only.
    """
    words, ends = split(text)
    found = bounds(_counts(ends), span, min_words, grow)
    whole = b"\n" if len(ends) < span or len(words) < min_words else b""
    parts = [" ".join(words[a:b]).encode("utf-8", "surrogatepass") for a, b in zip([0, *ends], ends)]
    return [blake2b(whole + b"\n".join(parts[i:j]), digest_size=16).digest() for i, j in found]


def _emit(batches: Iterator[pa.RecordBatch], span: int, min_words: int, grow: bool) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        counts, marks, key = [], [], []
        for text in texts(part.column(1)):
            found = runs(text, span, min_words, grow)
            counts.append(len(found))
            marks.append(tag(text))
            key += found
        halves = np.frombuffer(b"".join(key), np.int64).reshape(-1, 2)
        at = ranges(np.zeros(len(counts), np.int64), np.array(counts)) << 24 | np.repeat(np.array(marks), counts)
        doc = np.repeat(part.column(0).to_numpy(zero_copy_only=False), counts)
        yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(doc, pa.int64()), pa.array(at, pa.int64())], ["h", "g", "doc", "at"])


def _cut(batches: Iterator[pa.RecordBatch], span: int, min_words: int, grow: bool, names: list[str], body: str) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, body):
        kept, total, gone = [], [], []
        for text, lists in zip(part.column(body).to_pylist(), part.column("list").to_pylist(), strict=True):
            ends, out = split(text or "")[1], set()
            if lists:
                found, mark = bounds(_counts(ends), span, min_words, grow), tag(text or "")
                out = {j for x in lists if x & 0xFFFFFF == mark and x >> 24 < len(found) for j in range(*found[x >> 24])}
            kept.append(text if not out else "".join(text[a:b] for i, (a, b) in enumerate(_tiles(text, ends)) if i not in out))
            total.append(len(ends) or int(bool(text)))
            gone.append(len(out))
        cols = [pa.array(kept, pa.string()) if n == body else part.column(n) for n in names]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_sentences", "n_removed"])


def remove_spans(df: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text", grow: bool = False) -> DataFrame:
    """`df` with the remaining text, n_sentences and n_removed.

    A run that repeats inside its own document counts as well. Null and empty texts have no sentences and stay as they
    are; rows without a key neither lose nor claim a run; rows that share key and text are one document, so repeated rows
    do not take from each other. A text of fewer sentences than `span` stays, with `grow` its first copy only. An empty
    table stays empty. Further columns are carried whatever their names; ones named like an added one are replaced.
    """
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text")).filter("doc is not null")
    spans = staged(docs.mapInArrow(lambda it: _emit(it, span, min_words, grow), "h bigint, g bigint, doc bigint, at bigint"), "spans")
    # folded before the shuffle: a hash that a third of the documents share costs one row for each task
    first = spans.groupBy("h", "g").agg(F.min(F.struct("doc", "at")).alias("first"), F.max(F.struct("doc", "at")).alias("last"))
    # each shuffle is released before the next one is written
    first = staged(first.filter("first != last").select("h", "g", "first"), "first")
    later = spans.join(first, ["h", "g"]).filter(F.struct("doc", "at") > F.col("first"))
    lists = staged(later.groupBy("doc").agg(F.collect_set("at").alias("list")), "lists")
    base, names = numbered(df, "n_sentences", "n_removed")
    body, columns = f"c{names.index(text)}", base.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields) + ", n_sentences bigint, n_removed bigint"
    joined = base.withColumn("doc", F.col(f"c{names.index(key)}").cast("long")).join(lists, "doc", "left").drop("doc")
    return joined.mapInArrow(lambda it: _cut(it, span, min_words, grow, columns, body), schema).toDF(*names, "n_sentences", "n_removed")
