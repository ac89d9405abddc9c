"""Exact substring deduplication across documents by depth-bounded longest-previous-factor arrays.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id.

1. Every string of `length` bytes has a minimizer, its k-gram of least hash; a run of starts with the same minimizer is a
   section. Equal strings have equal minimizers, so sections with equal minimizers meet and no others need to.
2. Sections whose whole content stands in an earlier document are settled by their content hash. Within a slice of a task
   this happens before the shuffle, so what is common in the data is folded on the map side.
3. What is left of a minimizer with several contents, mostly the ends of shared passages, is fetched as bytes and
   suffix-sorted to the depth `length`. In suffix order the nearest smaller document before or after a suffix gives its
   longest previous factor; where that reaches `length`, the start is covered.
4. A minimizer with more sections than `GROUP_ROWS` is not sorted in one task: its strings are folded one by one instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import SLICE_BYTES, numbered, ranges, slices, staged, text_buffer

LENGTH = 50
K = 16
GROUP_ROWS = 20_000
SECTION = "mh bigint, sh bigint, doc bigint, at bigint"
# at = first start << 32 | 24 bits of the text's hash << 8 | starts in the section


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost least value in every window of w values, by block-wise prefix and suffix minima."""
    n = len(h)
    bits = max(int(n).bit_length(), 1)
    low = np.uint64((1 << bits) - 1)
    keyed = (h & ~low) | np.arange(n, dtype=np.uint64)
    rows = -(-n // w)
    padded = np.full(rows * w, ~np.uint64(0), np.uint64)
    padded[:n] = keyed
    blocks = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - w + 1], ahead[w - 1 : n]) & low).astype(np.int64)


def sections(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K):
    """(row, first start, starts, minimizer hash, content hash) of all sections of the texts in `buf`."""
    size = np.diff(offsets)
    starts = np.maximum(size - length + 1, 0)
    if not starts.sum():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    p = rolling.prefix(buf)
    grams = rolling.windows(p, k)
    # positions are packed into the low bits for the leftmost least value; the order uses the high bits alone
    least = sliding_least(grams, length - k + 1)
    at = ranges(offsets[:-1], starts)
    row = np.repeat(np.arange(len(size)), starts)
    least = least[at]
    first = np.flatnonzero((np.diff(least, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    n = np.diff(first, append=len(at))
    a = at[first]
    content = rolling.hashes(p, a, a + n - 1 + length)
    return row[first], a - offsets[row[first]], n, grams[least[first]], rolling.mix(content, 1) + n.astype(np.uint64)


def _tags(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return (rolling.hashes(rolling.prefix(buf), offsets[:-1], offsets[1:]) >> np.uint64(40)).astype(np.int64)


def _emit(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    """Sections of each slice. Those whose content stands in a smaller document of the slice come settled: sh null."""
    for part in slices(batches, "text"):
        part = part.filter(part.column(0).is_valid())
        if not part.num_rows:
            continue
        buf, offsets = text_buffer(part.column(1))
        row, a, n, mh, sh = sections(buf, offsets, length, k)
        doc = part.column(0).to_numpy()[row]
        at = (a << 32) | (_tags(buf, offsets)[row] << 8) | n
        order = np.lexsort((doc, sh, mh))
        doc, at, mh, sh = doc[order], at[order], mh[order].view(np.int64), sh[order].view(np.int64)
        new = (np.diff(mh, prepend=mh[:1] + 1) != 0) | (np.diff(sh, prepend=sh[:1] + 1) != 0)
        settled = doc != doc[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        key = np.where(settled, rolling.mix(doc.view(np.uint64) ^ at.view(np.uint64)).view(np.int64), mh)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(sh, mask=settled), pa.array(doc), pa.array(at)], ["mh", "sh", "doc", "at"]
        )


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (mh, sh, doc). Settled sections come out with mh null; first sections of a minimizer that has
    several contents come out with it, to be compared. Only the rows of one document are held between batches."""
    held = np.zeros((4, 0), np.int64)
    several = False
    for batch in batches:
        fixed = batch.filter(batch.column(1).is_null())
        if fixed.num_rows:
            yield _rows(np.zeros(0, np.int64), fixed.column(2).to_numpy(), fixed.column(3).to_numpy())
        batch = batch.filter(batch.column(1).is_valid())
        if not batch.num_rows:
            continue
        x = np.hstack([held, np.array([c.to_numpy() for c in batch.columns])])
        mh, sh, doc, at = x
        new_mh = np.ones(len(mh), bool)
        new_mh[1:] = mh[1:] != mh[:-1]
        new_sh = new_mh.copy()
        new_sh[1:] |= sh[1:] != sh[:-1]
        content = np.cumsum(new_sh) - 1
        first = doc == doc[np.flatnonzero(new_sh)[content]]
        group = np.cumsum(new_mh) - 1
        contents = np.bincount(group[new_sh])
        many = contents > 1
        many[0] |= several and held.shape[1] > 0 and mh[0] == held[0, 0]
        old = np.arange(len(mh)) < held.shape[1]
        yield _rows(np.zeros(0, np.int64), doc[~first], at[~first])
        pick = first & many[group] & ~(old & several)
        yield _rows(mh[pick], doc[pick], at[pick])
        last = first & (content == content[-1])
        held, several = x[:, last], bool(many[-1])


def _rows(mh: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    key = pa.array(mh) if len(mh) else pa.nulls(len(doc), pa.int64())
    return pa.RecordBatch.from_arrays([key, pa.array(doc), pa.array(at)], ["mh", "doc", "at"])


def _bodies(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the listed sections of each document; lists whose tag is another text's are passed over."""
    for part in slices(batches, "text"):
        buf, offsets = text_buffer(part.column("text"))
        lists = part.column("list")
        flat = lists.flatten()
        row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
        mh, at = (flat.field(i).to_numpy() for i in (0, 1))
        ok = ((at >> 8) & 0xFFFFFF) == _tags(buf, offsets)[row]
        row, mh, at = row[ok], mh[ok], at[ok]
        a, size = offsets[row] + (at >> 32), (at & 0xFF) + length - 1
        data = buf[ranges(a, size)]
        ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        body = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(mh), pa.array(part.column("doc").to_numpy()[row]), pa.array(at), body], ["mh", "doc", "at", "body"]
        )


def previous_factors(buf: np.ndarray, at: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes of `buf` starting at `at` have a previous factor of at least `length` bytes in a smaller document.

    The suffixes are sorted to that depth, eight bytes a key, equal ones by document. Then the previous smaller document
    in suffix order shares `length` bytes exactly if the suffix is not of the least document of its equals; the next
    smaller document lies beyond the equals and shares fewer.
    """
    if not len(at):
        return np.zeros(0, bool)
    words = []
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    for d in range(0, length, 8):
        word = np.zeros(len(at), np.uint64)
        for i in range(min(8, length - d)):
            word = (word << np.uint64(8)) | padded[at + d + i]
        words.append(word)
    suffixes = np.lexsort((doc, *reversed(words)))
    new = np.zeros(len(at), bool)
    new[0] = True
    for word in words:  # a shorter common prefix than `length` with the suffix before
        new[1:] |= word[suffixes[1:]] != word[suffixes[:-1]]
    sorted_doc = doc[suffixes]
    least = sorted_doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.zeros(len(at), bool)
    out[suffixes] = sorted_doc > least
    return out


def _compare(batches: Iterator[pa.RecordBatch], length: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by mh. Covered starts as spans (body null); rows of larger groups than `limit` come out as they are."""
    names = ["doc", "at", "body"]

    def out(table: pa.Table) -> pa.RecordBatch:
        data, offsets = _binary(table.column("body"))
        at = table.column("at").to_numpy()
        n = at & 0xFF
        starts = ranges(offsets[:-1], n)
        row = np.repeat(np.arange(len(n)), n)
        covered = previous_factors(data, starts, table.column("doc").to_numpy()[row], length)
        edge = np.diff(np.concatenate(([0], np.where(covered, row + 1, 0), [0])))
        first = np.flatnonzero((edge != 0) & np.append(covered, False))
        last = np.flatnonzero((edge != 0) & np.insert(covered, 0, False))
        r = row[first]
        span = (at[r] & ~np.int64(0xFF)) + ((starts[first] - offsets[r]) << 32) | (last - first)
        return pa.RecordBatch.from_arrays([table.column("doc").combine_chunks().take(pa.array(r)), pa.array(span), pa.nulls(len(r), pa.binary())], names)

    held: pa.Table | None = None
    hot = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if hot is not None:
            same = np.equal(table.column("mh").to_numpy(), hot)
            more = table.filter(pa.array(same))
            if more.num_rows:
                yield from more.select(names).combine_chunks().to_batches()
            table = table.filter(pa.array(~same))
            if not table.num_rows:
                continue
            hot = None
        held = table if held is None else pa.concat_tables([held, table])
        mh = held.column("mh").to_numpy()
        begin = int(np.searchsorted(mh, mh[-1]))  # mh is sorted
        whole = held.slice(0, begin).combine_chunks()
        for lo, hi in _cuts(mh[:begin], limit):
            if hi - lo > limit and mh[lo] == mh[hi - 1]:
                yield from whole.slice(lo, hi - lo).select(names).combine_chunks().to_batches()
            else:
                yield out(whole.slice(lo, hi - lo).combine_chunks())
        held = held.slice(begin)
        if held.num_rows > limit:
            hot = mh[-1]
            yield from held.select(names).combine_chunks().to_batches()
            held = None
    if held is not None and held.num_rows:
        yield out(held.combine_chunks())


def _cuts(keys: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole groups of equal keys of about `limit` rows; a group that is larger stands alone."""
    if not len(keys):
        return
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    end = np.append(begin[1:], len(keys))
    lo = 0
    for b, e in zip(begin.tolist(), end.tolist(), strict=True):
        if e - lo > limit and b > lo:
            yield lo, b
            lo = b
    yield lo, len(keys)


def _binary(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(docs: DataFrame, length: int = LENGTH, k: int = K, limit: int = GROUP_ROWS) -> DataFrame:
    """(doc, at): covered starts of `docs` (doc, text); at packs first start, text tag and number of starts."""
    cut = docs.select("doc", "text").mapInArrow(lambda it: _emit(it, length, k), SECTION)
    dealt = cut.repartition("mh").sortWithinPartitions("mh", "sh", "doc")
    found = staged(dealt.mapInArrow(_settle, "mh bigint, doc bigint, at bigint"), "sections")
    lists = found.filter("mh is not null").groupBy("doc").agg(F.collect_list(F.struct("mh", "at")).alias("list"))
    bodies = docs.select("doc", "text").join(lists, "doc").mapInArrow(
        lambda it: _bodies(it, length), "mh bigint, doc bigint, at bigint, body binary"
    )
    ordered = bodies.repartition("mh").sortWithinPartitions("mh", "doc")
    compared = staged(ordered.mapInArrow(lambda it: _compare(it, length, limit), "doc bigint, at bigint, body binary"), "factors")
    singles = compared.filter("body is not null").select(
        "doc", "at", "body", F.explode(F.sequence(F.lit(0), (F.col("at").bitwiseAND(0xFF) - 1).cast("int"))).alias("i")
    ).select("doc", F.expr("(at & ~255L) + shiftleft(cast(i as bigint), 32) + 1").alias("at"), F.expr(f"substring(body, i + 1, {length})").alias("s"))
    least = singles.groupBy("s").agg(F.min("doc").alias("_least"))
    folded = singles.join(least, "s").filter("doc > _least").select("doc", "at")
    return found.filter("mh is null").select("doc", "at").unionByName(compared.filter("body is null").select("doc", "at")).unionByName(folded)


def _cover(batches: Iterator[pa.RecordBatch], length: int, names: list[str], body: str, texts: bool) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, body, SLICE_BYTES):
        buf, offsets = text_buffer(part.column(body))
        size = np.diff(offsets)
        tags = _tags(buf, offsets)
        lists = part.column("list")
        lists = lists.fill_null(pa.scalar([], lists.type))
        at = lists.flatten().to_numpy()
        row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
        ok = ((at >> 8) & 0xFFFFFF) == tags[row]
        row, at = row[ok], at[ok]
        a = offsets[row] + (at >> 32)
        depth = np.zeros(len(buf) + 1, np.int64)
        np.add.at(depth, a, 1)
        np.add.at(depth, a + (at & 0xFF) - 1 + length, -1)
        gone = np.cumsum(depth)[:-1] > 0
        total = np.concatenate(([0], np.cumsum(gone)))
        removed = total[offsets[1:]] - total[offsets[:-1]]
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        heads = offsets[:-1][size > 0]
        begins[heads] = gone[heads]  # a run does not go on from the text before
        runs = np.concatenate(([0], np.cumsum(begins)))
        kept = buf[~gone]
        ends = np.concatenate(([0], np.cumsum(size - removed)))
        parts = [kept[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)]
        added = [pa.array(size), pa.array(removed), pa.array(runs[offsets[1:]] - runs[offsets[:-1]])]
        if texts:
            old = part.column(body)
            new = [o if not r else p.decode("utf-8", "ignore") for o, p, r in zip(old.to_pylist(), parts, removed, strict=True)]
            cols = [pa.array(new, pa.string()) if n == body else part.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(cols + added, [*names, "n_bytes", "n_removed", "n_spans"])
        else:
            cols = [part.column(n) for n in names]
            added.append(pa.array([hashlib.sha256(p).hexdigest() for p in parts]))
            yield pa.RecordBatch.from_arrays(cols + added, [*names, "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(
    df: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", texts: bool = True, limit: int = GROUP_ROWS
) -> DataFrame:
    """Per row of `df` what stays of its text, with n_bytes, n_removed and n_spans (maximal removed runs).

    With `texts` the rows keep all columns and get the remaining text (a code point cut in two goes whole); without, only
    the key and the SHA-256 of the remaining bytes come out. Null text counts as empty and stays null. Rows without a key
    neither lose bytes nor take them from others. Rows that share a key do not take from each other. Texts shorter than
    `length` stay; an empty table stays empty; further columns are carried whatever their names, ones named like an added
    one replaced.
    """
    if not 24 <= length <= 250:
        raise ValueError("length must be 24 to 250 bytes")
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    found = spans(docs, length, min(K, length // 2), limit)
    lists = found.groupBy("doc").agg(F.collect_list("at").alias("list"))
    added = ["n_bytes", "n_removed", "n_spans"]
    base, names = numbered(df if texts else df.select(f"`{key}`", f"`{text}`"), *added)
    body = f"c{names.index(text)}"
    carried = [f for f in base.schema.fields if texts or f.name != body]
    columns = [f.name for f in carried]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in carried) + ", n_bytes bigint, n_removed bigint, n_spans bigint"
    schema += "" if texts else ", kept_sha256 string"
    joined = base.withColumn("doc", F.col(f"c{names.index(key)}").cast("long")).join(lists, "doc", "left").drop("doc")
    out = joined.mapInArrow(lambda it: _cover(it, length, columns, body, texts), schema)
    return out.toDF(*[names[int(c[1:])] for c in columns], *added, *([] if texts else ["kept_sha256"]))
