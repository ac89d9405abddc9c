"""Rotating bitmaps with bit-sliced counters: occupancy of a ring of positions, shifted many times and overlaid.

A key's positions on a ring of `h` places are a bitmap of 64-bit words. Turning the ring by s places moves whole words: each
word lands on two neighbouring words, and what passes the end re-enters at the start. Many bitmaps are overlaid with a
counter of two bit planes per place, `once` and `twice` (a carry-save adder that saturates at two): adding x turns
`twice` into twice | once & x and `once` into once | x. Two counters join by the same rule, so tasks fold their
own rows first and only planes are shuffled, whatever the number of occupied places or keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = 64
BLOCK = 512
"""Words of one row: 32,768 places, 4 KB a plane."""
PLANE_BYTES = 64 << 20
"""Planes that a task holds at once; more turns or places are done in parts."""


def bitmaps(cells: DataFrame, key: str, index: str, size: str) -> DataFrame:
    """Rows (key, size, words, bits): the occupied words of each key, at most `BLOCK` in a row; cells may repeat."""
    word = F.floor(F.col(index) / WORD).cast("bigint")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col(index), F.lit(WORD)).cast("int"))
    words = cells.groupBy(key, size, word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    blocks = words.groupBy(key, size, F.floor(F.col("word") / BLOCK).alias("block")).agg(F.collect_list(F.struct("word", "bits")).alias("w"))
    return blocks.select(key, size, F.col("w.word").alias("words"), F.col("w.bits").alias("bits"))


def turned(words: np.ndarray, bits: np.ndarray, shifts: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pieces (turn x word targets, values) of a bitmap turned by each shift; targets of a piece are distinct per turn.

    All pieces of one bitmap and turn have disjoint bits, since a rotation moves no two places to one.
    """
    start = words[None, :] * WORD + shifts[:, None] % size
    room = np.clip(size - start, 0, WORD)  # so many low bits stay before the end of the ring
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    keep = np.where(room == WORD, full, (np.uint64(1) << (room % WORD).astype(np.uint64)) - np.uint64(1))
    for at, value in ((start, bits & keep), (start - size, bits & ~keep)):
        target, by = at // WORD, (at % WORD).astype(np.uint64)
        yield target, value << by
        yield target + 1, np.where(by > 0, value >> (np.uint64(WORD) - np.maximum(by, np.uint64(1))), np.uint64(0))


class Planes:
    """Counters (turn, word) saturating at two."""

    def __init__(self, turns: int, words: int):
        self.once, self.twice = (np.zeros((turns, words), np.uint64) for _ in range(2))

    def add(self, words: np.ndarray, bits: np.ndarray, shifts: np.ndarray, size: int) -> None:
        for target, value in turned(words, bits, shifts, size):
            turn, at = np.nonzero(value)
            to, value = target[turn, at], value[turn, at]
            seen = self.once[turn, to]
            self.twice[turn, to] |= seen & value
            self.once[turn, to] = seen | value

    def blocks(self, first: int) -> Iterator[tuple[int, int, bytes, bytes]]:
        for a in range(0, self.once.shape[1], BLOCK):
            once, twice = self.once[:, a : a + BLOCK], self.twice[:, a : a + BLOCK]
            for turn in np.flatnonzero(once.any(axis=1)):
                yield first + int(turn), a // BLOCK, once[turn].tobytes(), twice[turn].tobytes()


PARTS = pa.schema([("turn", pa.int32()), ("block", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())])


def overlaid(maps: DataFrame, size: str, shifts: str) -> DataFrame:
    """Places that at least two bitmaps occupy, per turn: (turn, places). `shifts` is an array column, an entry per turn."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            places = batch.column(0)[0].as_py()
            words = -(-places // WORD)
            rows = [
                (np.array(w, np.int64), np.array(b, np.int64).view(np.uint64), np.array(s, np.int64))
                for w, b, s in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)
            ]
            turns, step = len(rows[0][2]), max(1, PLANE_BYTES // (16 * words))
            for first in range(0, turns, step):
                planes = Planes(min(step, turns - first), words)
                for w, b, s in rows:
                    planes.add(w, b, s[first : first + step], places)
                found = list(planes.blocks(first))
                for a in range(0, len(found), 1024):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[a : a + 1024], strict=True), PARTS.types, strict=True)], schema=PARTS)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counters of one (turn, block) stand together; they join as they stream by."""
        held: tuple | None = None
        for batch in batches:
            turns, places = [], []
            for turn, block, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                once, twice = (np.frombuffer(x, np.uint64) for x in (once, twice))
                if held and held[:2] == (turn, block):
                    held = (turn, block, held[2] | once, held[3] | twice | held[2] & once)
                    continue
                if held:
                    turns.append(held[0]), places.append(int(np.bitwise_count(held[3]).sum()))
                held = (turn, block, once, twice)
            yield pa.RecordBatch.from_arrays([pa.array(turns, pa.int32()), pa.array(places, pa.int64())], names=["turn", "places"])
        if held:
            last = [pa.array([held[0]], pa.int32()), pa.array([int(np.bitwise_count(held[3]).sum())], pa.int64())]
            yield pa.RecordBatch.from_arrays(last, names=["turn", "places"])

    parts = maps.select(size, "words", "bits", shifts).mapInArrow(fold, "turn int, block long, once binary, twice binary")
    dealt = parts.repartition("turn", "block").sortWithinPartitions("turn", "block")
    return dealt.mapInArrow(join, "turn int, places long").groupBy("turn").agg(F.sum("places").alias("places"))

