"""Best-fit packing of tokenized documents with certified bin counts.

Documents become pieces of at most one capacity. Pieces are dealt into groups of bounded size; each group is packed by
best-fit decreasing and gets a lower bound from dual-feasible functions. A group that meets its bound is finished. The
others keep their full sequences, put the pieces of the loose ones together, deal them anew and pack again, while the
number of sequences is above the bound of what is left; a deal that gains nothing is not taken.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from .common import slices, staged, texts

GROUP = 2048
"""Pieces of a group on average."""
LOOSE = 0.995
"""A sequence filled to a smaller share is taken apart when its group misses its bound."""
CACHE = 400_000
"""Words of a generation, of which a process keeps two."""

#: Outside these, normalisation may do more than lower the case, or white space be cut differently; such texts go to the
#: library whole.
UNSURE = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u017f]")


#: The tokenizer's own cut of a word without apostrophes: letters, single numbers, the rest.
PARTS = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class Ids:
    """Ids of words between white space as little-endian unsigned 32-bit numbers; no token reaches over white space, nor
    over the cuts of `PARTS`, so a new word is put together from its parts and only new parts go to the model.

    Two generations of words are kept: when the newer one is full it becomes the older, whose words come back on use.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.model, self.new, self.old = tokenizer, tokenizer.model, {}, {}
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytewise = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0x180) if not chr(c).isspace()}

    def _part(self, part: str) -> bytes:
        tokens = self.model.tokenize(part.translate(self.bytewise))
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def _word(self, word: str) -> bytes:
        ids = self.new.get(word) or self.old.get(word)
        if ids is None:
            if word.isalpha():
                ids = self._part(word)
            elif "'" in word:  # contractions are cut otherwise
                ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                parts = PARTS.findall(word)
                ids = b"".join(map(self._word, parts)) if len(parts) > 1 else self._part(word)
        self.new[word] = ids
        return ids

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The table of ids, with all of `words` in it."""
        if len(self.new) > CACHE:
            self.old, self.new = self.new, {}
        for word in words.difference(self.new):
            self._word(word)
        return self.new


@lru_cache(maxsize=2)
def _loaded(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return tokenizer, Ids(tokenizer), [x.content for x in tokenizer.get_added_tokens_decoder().values()]


def encoded(texts: list[str], path: str) -> Iterator[bytes]:
    """Ids of each text, 4 bytes each; all words of the texts are looked up once."""
    tokenizer, ids, marks = _loaded(path)
    cut = [None if UNSURE.search(x) or any(m in x for m in marks) else x.lower().split() for x in texts]
    table = ids.learn(set().union(*(x for x in cut if x)))
    for text, words in zip(texts, cut, strict=True):
        if words is None:
            yield np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            yield b"".join(map(table.__getitem__, words))


def encode(text: str, path: str) -> bytes:
    return next(encoded([text], path))


def pieces(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32): every document with its end id, cut only where it exceeds `capacity`."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices((x.rename_columns(["key", "text"]) for x in batches), "text"):
            rows, n, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(encoded(texts(batch.column(1)), path)):
                ids += end
                for at in range(0, len(ids), 4 * capacity):
                    part = ids[at : at + 4 * capacity]
                    rows.append(row)
                    n.append(at // (4 * capacity))
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                [key, "piece", "start", "length", "ids_crc32"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each item and the number of bins. Open bins are kept by free space; one bit mask finds the tightest."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = bins = 0
    for item, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, at = capacity, bins
            bins += 1
        where[item], offset[item] = at, capacity - room
        left = room - size
        if left:
            free[left].append(at)
            mask |= 1 << left
    return where, offset, bins


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs. counts[x]: items of size x, 0 <= x <= capacity.

    The largest of two families of dual-feasible functions: large sizes rounded up and sizes under a threshold left out,
    for every threshold; and sizes rounded down to multiples of capacity/(k+1), scaled by (k+1)/k, for k to 20.
    """
    x = np.arange(capacity + 1)
    items = np.concatenate(([0], np.cumsum(counts)))
    volume = np.concatenate(([0], np.cumsum(counts * x)))
    t = np.arange(capacity // 2 + 1)
    best = int(np.max(-(-((items[-1] - items[capacity - t + 1]) * capacity + volume[capacity - t + 1] - volume[t]) // capacity)))
    for k in range(1, 21):
        whole, rest = np.divmod((k + 1) * x, capacity)
        value = np.where(rest == 0, x * k, whole * capacity)  # over k * capacity
        best = max(best, int(-(-int((counts * value).sum()) // (k * capacity))))
    return best


def _packed(df: DataFrame, key: str, capacity: int, turn: int, total: int) -> DataFrame:
    """One turn: deal `total` pieces, pack each group, mark what is kept."""
    groups = max(1, -(-total // GROUP))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "_i"], ignore_index=True)
        size = group["length"].to_numpy()
        where, offset, bins = best_fit_decreasing(size, capacity)
        met = bins == lower_bound(np.bincount(size, minlength=capacity + 1), capacity)
        full = np.bincount(where, size, minlength=bins) >= LOOSE * capacity
        return group.assign(sequence_id=(turn << 56) + (int(group["_g"].iloc[0]) << 20) + where, offset=offset, kept=met | full[where])

    dealt = df.withColumn("_g", F.pmod(F.xxhash64(F.lit(turn), "_i"), F.lit(groups)))
    kind = df.schema[key].dataType.simpleString()
    schema = (f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, _i bigint, sequence_id bigint, "
              "offset bigint, kept boolean")  # fmt: skip
    return staged(dealt.groupBy("_g").applyInPandas(lambda g: fill(g).drop(columns="_g"), schema), "packed")


def _bins(df: DataFrame) -> int:
    return df.agg(F.count_distinct("sequence_id")).first()[0]


def pack(cut: DataFrame, capacity: int = 2048, key: str = "doc_id", turns: int = 6) -> DataFrame:
    """`pieces` with sequence_id and offset; each sequence holds at most `capacity` tokens without gaps.

    Ties are broken by a row number given when the pieces are written, so repeated rows and null keys spread over the
    groups and each takes a place of its own. An empty table gives an empty result. After `turns` exchanges the packing
    stands as it is. The driver sees counts only, at most one row for each piece length.
    """
    drop = ["_i", "kept"]
    cut = staged(cut.withColumn("_i", F.monotonically_increasing_id()), "pieces")
    packed = _packed(cut, key, capacity, 0, cut.count())
    done, loose = packed.filter("kept"), packed.filter("not kept")
    for turn in range(1, turns + 1):
        sizes = {r[0]: r[1] for r in loose.groupBy("length").count().collect()}
        bins = _bins(loose)
        if bins <= lower_bound(np.array([sizes.get(x, 0) for x in range(capacity + 1)]), capacity):
            break
        again = _packed(loose.drop("sequence_id", "offset", "kept"), key, capacity, turn, sum(sizes.values()))
        if _bins(again) >= bins:
            continue  # another deal may do better
        done, loose = done.unionByName(again.filter("kept")), again.filter("not kept")
    return done.unionByName(loose).drop(*drop)
