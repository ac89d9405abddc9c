"""Document fingerprints that subtract: invertible Bloom look-up sketches of paragraph pieces.

A text's lines are cut into pieces after words that a hash selects, so an edit changes few pieces. Each piece, labelled
with its occurrence number, is a 64-bit digest that is added to three cells of a sketch: count, sum of digests, sum of
check hashes. The difference of two sketches holds only what the texts do not share; cells with one digest left give it
away, which frees others. Where that gets stuck, the sketch was too small: both are made again twice as large.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rolling
from .common import slices, text_buffer, texts
from .order_minhash import words

THIRD = 8
"""Cells in each third of the published sketch; the first comparison is made at this size."""
CUT = 4
"""A piece ends after one word in so many."""
ROWS = 1024
"""Documents in a range of ids, on average."""


def digests(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(piece digests, pieces before each row). White space inside a line does not matter; texts without words have none."""
    buf, offsets = text_buffer(pa.array(rows, pa.string()))
    word, begin, starts = words(buf, offsets)
    line = np.cumsum(buf == 10)
    head = np.zeros(len(word), bool)
    head[begin[:-1][begin[:-1] < len(word)]] = True
    if len(word):
        head[1:] |= line[starts[1:]] != line[starts[:-1]]
        head[1:] |= rolling.mix(word, 5)[:-1] % np.uint64(CUT) == 0
        head[0] = True
    first = np.flatnonzero(head)
    end = np.append(first[1:], len(word))
    before = np.searchsorted(first, begin)
    h = rolling.hashes(rolling.prefix(word), first, end[: len(first)])
    row = np.repeat(np.arange(len(rows)), np.diff(before))
    return rolling.mix(h + rolling.occurrences(h, row) * np.uint64(0xD6E8FEB86659FD93), 17), before


def _places(key: np.ndarray, base: np.ndarray, third: int) -> np.ndarray:
    """Cells of each digest, one in each third of its sketch."""
    return np.stack([base * (3 * third) + t * third + (rolling.mix(key, 31 + t) % np.uint64(third)).astype(np.int64) for t in range(3)])


class Cells:
    """Sketches of many rows side by side."""

    def __init__(self, rows: int, third: int):
        self.third = third
        self.count = np.zeros(rows * 3 * third, np.int64)
        self.key = np.zeros(rows * 3 * third, np.uint64)
        self.check = np.zeros(rows * 3 * third, np.uint64)

    def add(self, key: np.ndarray, row: np.ndarray, sign) -> None:
        sign = np.broadcast_to(np.asarray(sign, np.int64), key.shape)
        factor = sign.astype(np.uint64)  # -1 is 2^64 - 1
        for place in _places(key, row, self.third):
            np.add.at(self.count, place, sign)
            np.add.at(self.key, place, key * factor)
            np.add.at(self.check, place, rolling.mix(key, 99) * factor)


def published(key: np.ndarray, before: np.ndarray) -> list[str]:
    """The sketch of each row at the base size as text: per cell a 4-byte count, 8-byte sum and 4-byte check, little-endian."""
    n = len(before) - 1
    cells = Cells(n, THIRD)
    cells.add(key, np.repeat(np.arange(n), np.diff(before)), 1)
    packed = np.zeros(n * 3 * THIRD, [("count", "<i4"), ("key", "<u8"), ("check", "<u4")])
    packed["count"], packed["key"], packed["check"] = cells.count, cells.key, cells.check >> np.uint64(32)
    size = 3 * THIRD * packed.itemsize
    data = packed.tobytes()
    return [base64.b64encode(data[i * size : (i + 1) * size]).decode() for i in range(n)]


def difference(a: np.ndarray, a_before: np.ndarray, b: np.ndarray, b_before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of digests that only a and only b has, row by row, recovered from the subtracted sketches."""
    n = len(a_before) - 1
    only = np.zeros((2, n), np.int64)
    rows, third = np.arange(n), THIRD
    while len(rows):
        place = np.full(n, -1)
        place[rows] = np.arange(len(rows))
        cells = Cells(len(rows), third)
        for key, before, sign in ((a, a_before, 1), (b, b_before, -1)):
            row = place[np.repeat(np.arange(n), np.diff(before))]
            cells.add(key[row >= 0], row[row >= 0], sign)
        only[:, rows] = 0
        while True:
            single = np.flatnonzero(np.abs(cells.count) == 1)
            sign = cells.count[single]
            key = cells.key[single] * sign.astype(np.uint64)
            pure = rolling.mix(key, 99) * sign.astype(np.uint64) == cells.check[single]
            single, sign, key = single[pure], sign[pure], key[pure]
            if not len(single):
                break
            row = single // (3 * third)
            _, one = np.unique(key ^ rolling.mix(row.astype(np.uint64), 3), return_index=True)
            sign, key, row = sign[one], key[one], row[one]
            np.add.at(only[0], rows[row[sign > 0]], 1)
            np.add.at(only[1], rows[row[sign < 0]], 1)
            cells.add(key, row, -sign)
        stuck = ((cells.count != 0) | (cells.key != 0)).reshape(len(rows), -1).any(axis=1)
        rows, third = rows[stuck], third * 2
    return only[0], only[1]


def likeness(a: np.ndarray, a_before: np.ndarray, b: np.ndarray, b_before: np.ndarray) -> np.ndarray:
    """Share of common digests among all; 1 for two rows without any."""
    only_a, only_b = difference(a, a_before, b, b_before)
    common = np.diff(a_before) - only_a
    total = common + only_a + only_b
    return np.where(total > 0, common / np.maximum(total, 1), 1.0)


def with_next(df: DataFrame, key: str, text: str, rows: int = ROWS) -> DataFrame:
    """(key, text, next): the text of the next row by descending key, after the last the first. Null text is empty.

    Ids are cut into ranges of about `rows` documents; the next text is a window function inside a range, and the last of
    a range takes the head of the next range that has any. Rows without a key come last; ties go by text hash.
    """
    docs = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    low, high, n = docs.agg(F.min("k"), F.max("k"), F.count(F.lit(1))).first()
    width = max(1, ((high or 0) - (low or 0) + 1) * rows // max(n, 1))
    docs = docs.withColumn("r", F.when(F.col("k").isNull(), F.lit(-1)).otherwise(F.expr(f"(k - {low or 0}L) div {width}L")))
    order = Window.partitionBy("r").orderBy(F.desc_nulls_last("k"), F.xxhash64("t"))
    placed = docs.withColumns({"next": F.lead("t").over(order), "i": F.row_number().over(order)})
    # the next range that has documents: inside a group of ranges, or the head of the next group
    ranges_ = docs.select("r").distinct().withColumn("g", F.expr("r div 1024"))
    inside = ranges_.withColumn("n", F.lead("r").over(Window.partitionBy("g").orderBy(F.desc("r"))))
    groups = ranges_.groupBy("g").agg(F.max("r").alias("top"))
    groups = groups.select("g", F.lead("top").over(Window.orderBy(F.desc("g"))).alias("below"))
    first = groups.join(ranges_.groupBy("g").agg(F.max("r").alias("top")), "g").agg(F.max("top").alias("wrap"))
    follow = inside.join(groups, "g").crossJoin(F.broadcast(first)).select("r", F.coalesce("n", "below", "wrap").alias("f"))
    heads = placed.filter("i = 1").select(F.col("r").alias("f"), F.col("t").alias("head"))
    wanted = follow.join(heads, "f").select("r", "head")
    return placed.join(wanted, "r").select(F.col("k").alias(key), F.col("t").alias(text), F.coalesce("next", "head").alias("next"))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has the last half of its code points replaced by the first as many of the next text. Equal texts have
    equal fingerprints; a single row is its own successor; null counts as empty; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            own, following = texts(part.column(1)), texts(part.column(2))
            changed = [edited(x, y) for x, y in zip(own, following, strict=True)]
            a, b, c = digests(own), digests(changed), digests(following)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
                 pa.array(published(*a)), pa.array(published(*b)), pa.array(likeness(*a, *b)), pa.array(likeness(*a, *c))],
                ["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    source = with_next(df, key, text).select(F.col(key).alias("k"), F.col(text).alias("text"), "next")
    out = source.mapInArrow(
        run, "k bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    return out.withColumnRenamed("k", key)
