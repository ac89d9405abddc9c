"""Embedding whitening from an exact bit-sliced scatter matrix.

An entry c becomes the integer x = floor(64 c) + 1000000. In every block of rows each dimension is shifted by its least x
and its bit planes are packed across the rows into 64-bit words; the AND of two planes' words, counted and weighted by both
place values, gives the exact sum of products of two dimensions. Blocks are brought back to the common origin in integers,
so the sums over all partitions are exact at any size; n Q - S S' is the centred scatter times n, still an integer, and the
first thing that is ever rounded is its quotient by n^2, which goes to `eigh`. Only dimension x dimension sums reach the
driver; rows are read once for the sums, once for the error of the result, and once for the result.

Defined cases. Null vectors, and those with null or non-finite entries, are dropped. If lengths differ, the vectors of the
commonest length (of two, the longer) make the fit list and the others are dropped; empty ones hold nothing to whiten. Entries beyond
2^55 in size count as that. Repeated rows and null or repeated ids are rows like others. Components whose eigenvalue is
at most 1e-10 of the largest can't be told from rounding and are not returned (all, if all vectors are equal). A
deviation beyond a long is null. An empty table gives no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, ORIGIN = 64, 1_000_000
LARGEST = 2.0**55
BLOCK_ROWS = 8192
NEGLIGIBLE = 1e-10
LIMBS = 4
"""An exact sum travels as three unsigned limbs of 32 bits and a signed one; sums of limbs are longs."""


def usable(vectors: DataFrame, embedding: str) -> DataFrame:
    bad = F.exists(embedding, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.filter(F.col(embedding).isNotNull() & ~bad & (F.size(embedding) > 0))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Integer rows of an Arrow list column whose lists all have `size` entries."""
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
    return np.floor(np.clip(values, -LARGEST, LARGEST) * SCALE).astype(np.int64) + ORIGIN


def planes(shifted: np.ndarray) -> np.ndarray:
    """(dimension, bit, word): the bit planes of non-negative integers, packed across the rows."""
    rows, size = shifted.shape
    bits = np.arange(max(1, int(shifted.max()).bit_length()))
    packed = np.packbits(((shifted.T[:, None] >> bits[:, None]) & 1).astype(np.uint8), axis=-1)
    padded = np.zeros((size, len(bits), -(-rows // 64) * 8), np.uint8)
    padded[..., : packed.shape[-1]] = packed
    return padded.view(np.uint64)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and sums of products of integer columns, as Python integers."""
    rows, size = x.shape
    least = x.min(axis=0)
    words = planes(x - least)
    weights = np.array([1 << b for b in range(words.shape[1])], object)
    if 2 * len(weights) + rows.bit_length() < 62:
        weights = weights.astype(np.int64)
    sums = np.bitwise_count(words).sum(axis=-1, dtype=np.int64).astype(weights.dtype) @ weights
    products = np.zeros((size, size), weights.dtype)
    for i in range(size):
        for a, weight in enumerate(weights):
            counts = np.bitwise_count(words[i, a] & words[i:]).sum(axis=-1, dtype=np.int64)
            products[i, i:] += counts.astype(weights.dtype) @ weights * weight
    products = np.where(np.tri(size, k=-1, dtype=bool), products.T, products).astype(object)
    sums = sums.astype(object)
    least = least.astype(object)
    products += np.outer(least, sums) + np.outer(sums, least) + np.outer(least, least) * rows
    return sums + least * rows, products


def limbs(value: int) -> list[int]:
    return [(value >> 32 * k) & 0xFFFFFFFF for k in range(LIMBS - 1)] + [value >> 32 * (LIMBS - 1)]


@dataclass
class Moments:
    rows: int
    sums: list[int]
    products: list[list[int]]

    def centred(self) -> np.ndarray:
        """The covariance; every entry is the quotient of two exact integers, rounded once."""
        n, s, q = self.rows, self.sums, self.products
        return np.array([[(n * q[i][j] - s[i] * s[j]) / (n * n) for j in range(len(s))] for i in range(len(s))])


def moments(vectors: DataFrame, embedding: str, size: int) -> Moments:
    """Exact sums over all rows; a task folds its blocks and emits one row for each pair of dimensions."""
    upper = [(i, j) for i in range(size) for j in range(i, size)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums, products = 0, np.zeros(size, object), np.zeros((size, size), object)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                x = matrix(batch.column(0).slice(at, BLOCK_ROWS), size)
                part = scatter(x)
                rows, sums, products = rows + len(x), sums + part[0], products + part[1]
        if rows:
            found = [(-1, -1, rows), *((i, -1, sums[i]) for i in range(size)), *((i, j, products[i, j]) for i, j in upper)]
            split = np.array([[i, j, *limbs(int(v))] for i, j, v in found], np.int64)
            yield pa.RecordBatch.from_arrays(list(split.T), names=names)

    names = ["i", "j", *(f"l{k}" for k in range(LIMBS))]
    parts = vectors.select(embedding).mapInArrow(fold, ", ".join(f"{x} long" for x in names))
    total = parts.groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)])
    value = {(r["i"], r["j"]): sum(r[f"l{k}"] << 32 * k for k in range(LIMBS)) for r in total.collect()}
    products = [[value[min(i, j), max(i, j)] for j in range(size)] for i in range(size)]
    return Moments(value[-1, -1], [value[i, -1] for i in range(size)], products)


@dataclass
class Whitener:
    """Rows of `axes` are the unit components over the root of their eigenvalues."""

    rows: int
    sums: list[int]
    axes: np.ndarray
    explained: np.ndarray

    @classmethod
    def fit(cls, m: Moments, components: int) -> Whitener:
        covariance = m.centred()
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1], vectors[:, ::-1]
        kept = (values > NEGLIGIBLE * max(values[0], 0.0))[:components].nonzero()[0] if values[0] > 0 else np.zeros(0, int)
        axes = vectors[:, kept].T / np.sqrt(values[kept])[:, None]
        if len(kept):  # of the two signs the one with a positive largest entry
            axes = axes * np.sign(axes[np.arange(len(kept)), np.abs(axes).argmax(axis=1)])[:, None]
        return cls(m.rows, m.sums, axes, values[kept] / max(np.trace(covariance), np.finfo(float).tiny))

    def centre(self, x: np.ndarray) -> np.ndarray:
        """n x - S as exact integers: machine ones where they fit, else Python's."""
        middle = [s // self.rows for s in self.sums]
        off = x - np.array(middle, np.int64)
        rest = [s - self.rows * m for s, m in zip(self.sums, middle, strict=True)]
        if (int(np.abs(off).max(initial=0)) + 1) * self.rows < 2**62:
            return off * self.rows - np.array(rest, np.int64)
        return off.astype(object) * self.rows - np.array(rest, object)

    def transform(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.rows).astype(np.float64) @ self.axes.T

    def deviation(self, centred: np.ndarray) -> list[int | None]:
        if centred.dtype == object or int(np.abs(centred).max(initial=0)) ** 2 * centred.shape[1] >= 2**63:
            total = (centred.astype(object) ** 2).sum(axis=1)
            return [int(x) if x < 2**63 else None for x in total]
        return (centred**2).sum(axis=1).tolist()


def blocks(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            yield part, matrix(part.column(column), size)


def identity_error(vectors: DataFrame, embedding: str, model: Whitener) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, from the rows themselves."""
    size, k = len(model.sums), len(model.axes)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for _, x in blocks(batches, 0, size):
            w = model.transform(model.centre(x))
            sums, products = sums + w.sum(axis=0), products + w.T @ w
        i, j = np.triu_indices(k)
        i, j = np.concatenate((np.arange(k), i)), np.concatenate((np.full(k, -1), j))
        yield pa.RecordBatch.from_arrays([i, j, np.concatenate((sums, products[np.triu_indices(k)]))], names=["i", "j", "v"])

    total = vectors.select(embedding).mapInArrow(fold, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    mean = np.zeros(k)
    for r in total:
        if r["j"] < 0:
            mean[r["i"]] = r["v"] / model.rows
    return max(abs(r["v"] / model.rows - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in total if r["j"] >= 0)


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", components: int = 32) -> DataFrame:
    """A row per usable vector and component: its whitened coordinate, exact deviation and the quality of the fit."""
    rows = usable(vectors.select(id, embedding), embedding)
    out = f"{id} {vectors.schema[id].dataType.simpleString()}, {SCHEMA}"
    sizes = rows.groupBy(F.size(embedding).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], out)
    size = sizes["size"]
    rows = rows.filter(F.size(embedding) == size)
    model = Whitener.fit(moments(rows, embedding, size), components)
    if not len(model.axes):
        return vectors.sparkSession.createDataFrame([], out)
    error, k = identity_error(rows, embedding, model), len(model.axes)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in blocks(batches, 1, size):
            centred = model.centre(x)
            at = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(at), model.rows)), pa.array(model.deviation(centred), pa.int64()).take(pa.array(at)),
                pa.array(model.transform(centred).ravel()), pa.array(np.tile(model.explained, len(x))), pa.array(np.full(len(at), error)),
            ], names=names)

    names = [id, *(x.split()[0] for x in SCHEMA.split(", "))]
    return rows.mapInArrow(emit, out)
