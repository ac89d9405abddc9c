"""Nearest neighbours by inner product with multi-index hashing of learned binary codes.

Vectors of unlike norms are lifted onto a sphere (one more coordinate takes up what a vector lacks to the largest norm), so
that the inner product falls with the angle. From a bounded sample four rotations are learned by iterative quantisation,
each from a start of its own; the signs under one rotation are one substring of the code, a 64-bit word at most. The sample
also gives, for each similarity, the Hamming radius that holds `RECALL` of the pairs at least that near.

Every query gets its own radius: its k-th best inner product with the sample is a lower bound of the answer's k-th score,
and the radius of that bound is what it must search. All vectors are dealt into blocks of bounded size; a block's index has one
table per substring, from its values to the rows. By the pigeonhole principle a code within radius r differs from the query
in at least one substring by no more than that substring's share of r - 3; all values within the share are looked up,
by enumerating bit masks where these are fewer than the table's values and by comparing with the values where
they are not. Every code within the radius is thus found, checked as a whole, and reranked by the original floats.

A block is a run of rows whose codes begin alike: the leading bits of the first substring, as many as there are blocks,
name it, and prefixes that hold more than a block are dealt out further. A query goes only to blocks whose prefix lies within its
radius. Query blocks bound the other side, so a task holds one block of each, whatever is hot. Where the answer is spread
thin, as for random directions, the radii are wide and most blocks are visited; close neighbours make them small.

Defined cases. Vectors that are null, zero, empty or hold null or non-finite entries take no part; of unlike lengths the
commonest (of two, the longer) takes part. A query is a row, so another row with the same id is a candidate; rows with
null ids are candidates, after others of the same score, and no queries. Equal scores go by the smaller id. With fewer than
k candidates all are returned; an empty table or one vector gives no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ranges, staged
from .whitening import usable

SAMPLE = 8192
"""Vectors that the rotations and radii are learned from; a documented bound, every vector is indexed."""
PROBES = 512
"""Of these, so many stand for queries when radii are learned."""
TURNS, WORD, STEPS = 4, 64, 30
RECALL = 0.98
"""Share of the pairs of each similarity that the learned radius holds; the answers' recall follows it."""
BLOCK = 16384
QUERY_BLOCK = 16384
PREFIX_BITS = 12
CHUNK = 1 << 22
"""Entries of the largest array that a task makes for a run of queries."""


# --- learned codes ----------------------------------------------------------------------------------------------------


@dataclass
class Codes:
    """Rotations, norms and radii learned from the sample, and the sample's own vectors."""

    largest: float
    mean: np.ndarray
    turns: list[np.ndarray]
    floors: np.ndarray
    radii: np.ndarray
    sample: np.ndarray
    rows: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x / self.largest
        return np.hstack((x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))))

    def encode(self, lifted: np.ndarray) -> np.ndarray:
        """(row, substring) words of sign bits."""
        words = []
        for turn in self.turns:
            bits = np.zeros((len(lifted), WORD), np.uint8)
            bits[:, : turn.shape[1]] = (lifted - self.mean) @ turn > 0
            words.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0])
        return np.stack(words, axis=1)

    def unit(self, queries: np.ndarray) -> np.ndarray:
        return queries / np.linalg.norm(queries, axis=1, keepdims=True)

    def queries(self, x: np.ndarray) -> np.ndarray:
        unit = self.unit(x)
        return self.encode(np.hstack((unit, np.zeros((len(unit), 1)))))

    def radius(self, x: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
        """The radius of each query from its k-th best similarity with the sample, itself left out."""
        near = self.unit(x) @ self.sample.T / self.largest
        near[rows[:, None] == self.rows] = -np.inf
        if near.shape[1] < k:
            return np.full(len(x), self.radii[0])
        bound = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        return self.radii[np.maximum(0, np.searchsorted(self.floors, bound, side="right") - 1)]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def rotation(points: np.ndarray, basis: np.ndarray, seed: int) -> np.ndarray:
    """Iterative quantisation: the orthogonal turn of the principal axes that brings points nearest to their signs."""
    flat = points @ basis
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(basis.shape[1],) * 2))[0]
    for _ in range(STEPS):
        u, _, vt = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
        turn = (u @ vt).T
    return basis @ turn


def learn(sample: np.ndarray, rows: np.ndarray, largest: float, k: int) -> Codes:
    codes = Codes(largest, np.zeros(sample.shape[1] + 1), [], np.zeros(1), np.zeros(1, np.int64), sample, rows)
    lifted = codes.lift(sample)
    codes.mean = lifted.mean(axis=0)
    values, vectors = np.linalg.eigh(np.cov((lifted - codes.mean).T, bias=True))
    basis = vectors[:, ::-1][:, : min(WORD, sample.shape[1])]
    codes.turns = [rotation(lifted - codes.mean, basis, seed) for seed in range(TURNS)]

    # for every similarity level the radius that holds RECALL of the pairs from that level on
    widest = sum(x.shape[1] for x in codes.turns)
    probes = sample[:: max(1, len(sample) // PROBES)][:PROBES]
    near = codes.unit(probes) @ sample.T / largest
    apart = distance(codes.queries(probes)[:, None], codes.encode(lifted)[None])
    top = np.argpartition(-near, min(4 * k, near.shape[1] - 1), axis=1)[:, : 4 * k]
    near, apart = (np.take_along_axis(m, top, axis=1).ravel() for m in (near, apart))
    order = np.argsort(-near)
    groups = np.array_split(order, max(1, len(order) // 1000))
    floors = np.array([near[g].min() for g in groups])[::-1]
    radii = np.maximum.accumulate([np.ceil(np.quantile(apart[g], RECALL)) for g in groups])[::-1].astype(np.int64)
    codes.floors = np.concatenate(([-np.inf], floors))
    codes.radii = np.concatenate(([widest], radii))
    return codes


# --- the index of one block -------------------------------------------------------------------------------------------


def shares(radius: int) -> list[int]:
    """What each substring may differ by: shares sum to radius - substrings + 1, so one of them holds for every code within."""
    whole = radius - TURNS + 1
    return [whole // TURNS + (j < whole % TURNS) for j in range(TURNS)]


def masks(bits: int, share: int, limit: int) -> np.ndarray | None:
    """All words of up to `share` of the lowest `bits`; None if they are more than `limit`."""
    count, term = 1, 1
    for i in range(1, share + 1):
        term = term * (bits - i + 1) // i
        count += term
        if count > limit:
            return None
    flips = [sum(1 << b for b in c) for i in range(share + 1) for c in combinations(range(bits), i)]
    return np.array(flips, np.uint64)


class Index:
    """One table per substring: its sorted distinct values, and the rows of each."""

    def __init__(self, codes: np.ndarray, bits: list[int]):
        self.codes, self.bits, self.tables, self.flips = codes, bits, [], {}
        for column in codes.T:
            order = np.argsort(column, kind="stable")
            values, starts = np.unique(column[order], return_index=True)
            self.tables.append((values, np.append(starts, len(order)), order))

    def probe(self, j: int, word: np.uint64, share: int) -> np.ndarray:
        """Rows whose substring j differs from `word` in at most `share` bits."""
        values, starts, order = self.tables[j]
        if (j, share) not in self.flips:
            self.flips[j, share] = masks(self.bits[j], share, len(values))
        if self.flips[j, share] is None:
            hit = np.flatnonzero(np.bitwise_count(values ^ word) <= share)
        else:
            asked = self.flips[j, share] ^ word
            hit = np.searchsorted(values, asked)
            hit = hit[values[np.minimum(hit, len(values) - 1)] == asked]
        return order[ranges(starts[hit], starts[hit + 1] - starts[hit])]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose codes differ from `code` in at most `radius` bits."""
        found = np.zeros(len(self.codes), bool)
        for j, share in enumerate(shares(radius)):
            if share >= 0:
                found[self.probe(j, code[j], share)] = True
        rows = np.flatnonzero(found)
        return rows[distance(self.codes[rows], code) <= radius]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best; equal scores by the smaller id."""
    if len(scores) > k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= bound)
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((ids[kept], -scores[kept]))[:k]]


# --- jobs -------------------------------------------------------------------------------------------------------------


def floats(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)


def vectors_of(vectors: DataFrame, id: str, embedding: str) -> tuple[DataFrame, int]:
    """Rows (row, id, vec, size of a vector) that take part; `row` tells rows apart."""
    rows = usable(vectors.select(F.col(id).alias("id"), F.col(embedding).alias("vec")), "vec")
    rows = rows.filter(F.exists("vec", lambda c: c != 0))
    size = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = size["size"] if size else 0
    return rows.filter(F.size("vec") == size).withColumn("row", F.monotonically_increasing_id()), size


def learned(rows: DataFrame, size: int, k: int) -> tuple[Codes, int]:
    """The codes, and the number of rows. The sample is the rows of least hash; only about four times as many are ordered."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    largest, total = rows.agg(F.max(norm), F.count("*")).first()
    drawn = rows.withColumn("draw", F.pmod(F.xxhash64("row"), F.lit(1 << 40))).filter(F.col("draw") <= (1 << 42) * SAMPLE // total)
    sample = drawn.orderBy("draw", "row").limit(SAMPLE).select("row", "vec").toArrow()
    return learn(floats(sample["vec"].combine_chunks(), size), sample["row"].to_numpy(), largest, k), total


def nearest(
    vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", k: int = 20, every: int = 20,
    block: int = BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """For each row whose id is divisible by `every` the k rows of largest inner product: query_id, rank, id, score."""
    spark = vectors.sparkSession
    kind = vectors.schema[id].dataType.simpleString()
    rows, size = vectors_of(vectors, id, embedding)
    rows = staged(rows, "search-rows")
    if not size or rows.isEmpty():
        return spark.createDataFrame([], f"query_id {kind}, rank int, {id} {kind}, score double")
    codes, total = learned(rows, size, k)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = codes.encode(codes.lift(floats(batch.column("vec"), size))).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(words.ravel()), TURNS).cast(pa.list_(pa.int64()))],
                names=[*batch.schema.names, "code"],
            )

    fields = f"id {kind}, vec {vectors.schema[embedding].dataType.simpleString()}, row long"
    coded = staged(rows.select("id", "vec", "row").mapInArrow(encode, f"{fields}, code array<long>"), "search-codes")

    # the directory of blocks: a leading part of the first substring, and how many blocks share it; at most 2^PREFIX_BITS rows
    bits = min(PREFIX_BITS, max(0, (total // block).bit_length() - 1), codes.turns[0].shape[1])
    prefix = F.col("code")[0].bitwiseAND((1 << bits) - 1)
    counts = coded.groupBy(prefix.alias("prefix")).count().collect()
    directory = sorted((r["prefix"], -(-r["count"] // block)) for r in counts)
    prefixes = np.array([p for p, _ in directory], np.uint64)
    deals = np.array([d for _, d in directory], np.int64)
    first = np.cumsum(deals) - deals
    start, spread = np.zeros(1 << bits, np.int64), np.ones(1 << bits, np.int64)
    start[prefixes.astype(np.int64)], spread[prefixes.astype(np.int64)] = first, deals
    start, spread = (F.lit(x.tolist())[prefix.cast("int")] for x in (start, spread))
    asking = coded.filter((F.col("id") % every == 0)).select("id", "vec", "row")
    grid = max(1, -(-asking.count() // query_block))

    cell = "cell long, " + fields + ", code array<long>"
    index = coded.withColumn("cell", start + F.pmod(F.xxhash64("row"), spread))
    index = index.withColumn("cell", F.explode(F.sequence(F.col("cell") * grid, F.col("cell") * grid + (grid - 1))))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every query to the blocks that can hold codes within its radius."""
        for batch in batches:
            step = max(1, CHUNK // max(len(codes.sample), int(deals.sum())))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x, mine = floats(part.column("vec"), size), part.column("row").to_numpy()
                words, radius = codes.queries(x), codes.radius(x, mine, k)
                apart = np.bitwise_count((words[:, :1] & np.uint64((1 << bits) - 1)) ^ prefixes)
                query, group = np.nonzero(apart <= radius[:, None])
                blocks = np.concatenate([np.arange(f, f + d) for f, d in zip(first[group], deals[group], strict=True)])
                query = np.repeat(query, deals[group])
                cells = blocks * grid + (mine[query] * 2654435761 >> 7) % grid
                yield pa.RecordBatch.from_arrays([
                    pa.array(cells), *(part.column(c).take(pa.array(query)) for c in ("id", "vec", "row")),
                    pa.FixedSizeListArray.from_arrays(pa.array(words[query].view(np.int64).ravel()), TURNS).cast(pa.list_(pa.int64())),
                    pa.array(radius[query]),
                ], names=["cell", "id", "vec", "row", "code", "radius"])

    sent = asking.select("id", "vec", "row").mapInArrow(send, f"{cell}, radius long")
    bits_of = [x.shape[1] for x in codes.turns]

    def search(there: pa.Table, asked: pa.Table) -> pa.Table:
        if not there.num_rows or not asked.num_rows:
            return out_schema.empty_table()
        there, asked = there.combine_chunks(), asked.combine_chunks()
        table, queries = (floats(t["vec"].combine_chunks(), size) for t in (there, asked))
        words, codes_asked = (t["code"].combine_chunks().flatten().to_numpy().reshape(-1, TURNS).view(np.uint64) for t in (there, asked))
        tree = Index(np.ascontiguousarray(words), bits_of)
        own, order = there["row"].to_numpy(), pc.fill_null(there["id"].cast(pa.int64()), np.iinfo(np.int64).max).to_numpy()
        found, scores, who = [], [], []
        for i, (row, radius) in enumerate(zip(asked["row"].to_numpy(), asked["radius"].to_numpy(), strict=True)):
            near = tree.within(codes_asked[i], int(radius))
            near = near[own[near] != row]
            score = np.concatenate([(table[c] * queries[i]).sum(axis=1) for c in np.array_split(near, len(near) * size // CHUNK + 1)])
            top = best(score, order[near], k)
            found.append(near[top]), scores.append(score[top]), who.append(np.full(len(top), i))
        found, who = np.concatenate(found), np.concatenate(who)
        return pa.table([
            asked["row"].take(pa.array(who)), asked["id"].take(pa.array(who)), there["id"].take(pa.array(found)), pa.array(np.concatenate(scores)),
        ], schema=out_schema)

    id_type = coded.limit(0).select("id").toArrow().schema.field("id").type
    out_schema = pa.schema([("row", pa.int64()), ("query", id_type), ("id", id_type), ("score", pa.float64())])
    near = index.select("cell", "id", "vec", "row", "code").groupBy("cell").cogroup(sent.groupBy("cell")).applyInArrow(
        search, f"row long, query {kind}, id {kind}, score double"
    )
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    ranked = near.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("id").alias(id), "score")
