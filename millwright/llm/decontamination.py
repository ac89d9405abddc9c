"""Benchmark decontamination by the q-gram lemma with overlapping diagonal bands, verified by banded alignment.

An item of n characters that occurs in a text with at most e edits shares at least n - q + 1 - q * e q-grams with it, and
all of them lie on diagonals (place in the text less place in the item) that differ by at most e. Shared q-grams are
counted in bands of 2 (e + 1) diagonals, each half overlapping the next, so one band holds them all. Bands that reach the
bound are aligned with the item in a region that the band delimits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import ranges, slices, staged, text_buffer

Q = 8
RATE = 0.1
BLOCK_BYTES = 8 << 20
"""Item text that one pass over the documents carries; larger benchmarks take several passes."""
BLOCK_ITEMS = 1 << 15
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)]


def folded(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case ASCII, runs of other ASCII characters than letters and digits as one space, none at the ends of a row."""
    x = _FOLD[buf]
    space = x == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    keep[heads] = ~space[heads]
    before = np.concatenate(([0], np.cumsum(keep)))
    x, offsets = x[keep], before[offsets]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    drop = tails[x[tails] == 32]
    if len(drop):
        keep = np.ones(len(x), bool)
        keep[drop] = False
        before = np.concatenate(([0], np.cumsum(keep)))
        x, offsets = x[keep], before[offsets]
    return x, offsets


def budget(n: np.ndarray, q: int, rate: float) -> np.ndarray:
    """Edits that an item of n characters may have: its share, but never so many that the lemma says nothing."""
    return np.minimum((rate * n + 1e-9).astype(np.int64), np.maximum((n - q) // q, 0))


class Index:
    """q-grams of a block of items. Items shorter than q match nothing: such a string says nothing about its source."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float):
        rows = pa.array([t or "" for _, t in items], pa.string())
        buf, offsets = folded(*text_buffer(rows))
        self.ids = np.array([i for i, _ in items], np.int64)
        self.texts = [buf[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.q, self.n = q, np.diff(offsets)
        self.edits = budget(self.n, q, rate)
        self.least = np.maximum(self.n - q + 1 - q * self.edits, 1)
        count = np.maximum(self.n - q + 1, 0)
        at = ranges(offsets[:-1], count)
        h = rolling.windows(rolling.prefix(buf), q)[at] if len(at) else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(items)), count)
        order = np.argsort(h, kind="stable")
        self.item, self.place = item[order], (at - offsets[item])[order]
        self.grams, self.first = np.unique(h[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(h)))
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.grams >> np.uint64(42)] = True

    def candidates(self, buf: np.ndarray, offsets: np.ndarray):
        """(row, item, first diagonal of the band) that reach the bound of the lemma."""
        empty = np.zeros(0, np.int64)
        h = rolling.windows(rolling.prefix(buf), self.q)
        at = np.flatnonzero(self.seen[h >> np.uint64(42)]) if len(self.grams) else empty
        gram = np.minimum(np.searchsorted(self.grams, h[at]), max(len(self.grams) - 1, 0))
        row = np.searchsorted(offsets, at, side="right") - 1
        ok = (self.grams[gram] == h[at]) & (at + self.q <= offsets[row + 1]) if len(at) else np.zeros(0, bool)
        at, gram, row = at[ok], gram[ok], row[ok]
        if not len(at):
            return empty, empty, empty
        times = self.count[gram]
        hit = ranges(self.first[gram], times)
        row, at = np.repeat(row, times), np.repeat(at - offsets[row], times)
        item = self.item[hit]
        pair = row * len(self.ids) + item
        enough = np.bincount(pair, minlength=1)[pair] >= self.least[item]
        row, item, at, hit = row[enough], item[enough], at[enough], hit[enough]
        width = self.edits[item] + 1
        band = (at - self.place[hit]) // width
        low = -(int(self.n.max()) + 2)
        keys = np.concatenate([((row * len(self.ids) + item) << 32) + (band - low + x) for x in (0, -1)])
        keys, counts = np.unique(keys, return_counts=True)
        pair, band = keys >> 32, (keys & 0xFFFFFFFF) + low
        row, item = pair // len(self.ids), pair % len(self.ids)
        ok = counts >= self.least[item]
        return row[ok], item[ok], band[ok] * (self.edits[item[ok]] + 1)


def best_edits(item: bytes, region: bytes, most: int) -> int:
    """Least edit distance of the item to any substring of the region, or most + 1: bit-parallel, one column a character.

    The region spans the diagonals of one band, so the alignment is confined to that band and its margin.
    """
    places: dict[int, int] = {}
    for i, c in enumerate(item):
        places[c] = places.get(c, 0) | (1 << i)
    full, last = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, score, best = full, 0, len(item), most + 1
    for c in region:
        match = places.get(c, 0)
        same = (((match & up) + up) ^ up) | match | down
        right = down | (full & ~(same | up))
        left = up & same
        if right & last:
            score += 1
        elif left & last:
            score -= 1
        best = min(best, score)
        right <<= 1
        left <<= 1
        up = (left | ~(same | right)) & full
        down = right & same & full
    return best


def matches(docs: DataFrame, items: list[tuple[int, str]], q: int = Q, rate: float = RATE) -> DataFrame:
    """(doc, item, edits) of docs (doc, text) and one block of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items, q, rate)
        for part in slices(batches, "text"):
            buf, offsets = folded(*text_buffer(part.column(1)))
            found: dict[tuple[int, int], int] = {}
            for row, item, diagonal in zip(*(x.tolist() for x in index.candidates(buf, offsets)), strict=True):
                e = int(index.edits[item])
                if found.get((row, item), e + 1) == 0:
                    continue
                a = offsets[row] + max(0, diagonal - e)
                b = min(offsets[row + 1], offsets[row] + diagonal + 2 * (e + 1) + int(index.n[item]) + e)
                edits = best_edits(index.texts[item], buf[a:b].tobytes(), e)
                if edits <= e:
                    found[row, item] = min(edits, found.get((row, item), edits))
            pairs = list(found)
            rows = pa.array([r for r, _ in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(rows), pa.array(index.ids[[i for _, i in pairs]] if pairs else [], pa.int64()), pa.array(list(found.values()), pa.int64())],
                ["doc", "item", "edits"],
            )

    return docs.mapInArrow(run, "doc bigint, item bigint, edits bigint")


def blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most BLOCK_ITEMS and about BLOCK_BYTES; the driver holds one block at a time."""
    block, size = [], 0
    for r in benchmark.select(key, text).filter(F.col(key).isNotNull() & F.col(text).isNotNull()).toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if len(block) == BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    q: int = Q, rate: float = RATE,
) -> DataFrame:
    """(key, contaminated, item_ids, edits) of every row of `docs`: the items found in it and the edits each took.

    Texts are compared folded: ASCII case, punctuation and white space do not matter. Null and empty texts hold nothing,
    nor do null items or items shorter than q. Rows without a key come out not contaminated. Rows that share a key share
    what is found in any of them. Equal items are each reported. Empty tables give an empty or a clean result.
    """
    source = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text")).filter("doc is not null")
    found = None
    for block in blocks(benchmark, item_key, item_text):
        one = staged(matches(source, block, q, rate), "matches")
        found = one if found is None else found.unionByName(one)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc"))
    if found is None:
        lists = rows.limit(0).select("doc", F.array().cast("array<struct<item:bigint,edits:bigint>>").alias("list"))
    else:
        best = found.groupBy("doc", "item").agg(F.min("edits").alias("edits"))
        lists = best.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("item", "edits"))).alias("list"))
    return rows.join(lists, "doc", "left").select(
        F.col("doc").alias(key), F.col("list").isNotNull().alias("contaminated"),
        F.coalesce("list.item", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("list.edits", F.array().cast("array<bigint>")).alias("edits"),
    )
