"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Presence of hashed n-grams (3 to 5 characters of the lower-cased text) is counted by class over the training texts. The
FEATURES n-grams whose log-count ratio stands out most against its standard error are kept; a text's feature values are
their ratios, and logistic regression with an L2 penalty is fitted on them. Scoring is one narrow pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import numbered, slices, staged, texts

SIZES = (3, 4, 5)
BITS = 20
FEATURES = 4096
MAX_ROWS = 8_000
"""Bound of the labelled rows that the model is fitted on, half of them for either label; a hash of the id draws them."""


def grams(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram occurrence; a text shorter than n has none of that size."""
    coded = [np.frombuffer(x.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for x in rows]
    size = np.array([len(x) for x in coded], np.int64)
    buf = np.concatenate([*coded, np.zeros(0, np.uint32)])
    p = rolling.prefix(buf)
    row = np.repeat(np.arange(len(rows), dtype=np.int64), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(buf))  # characters to the end of the text
    out = []
    for n in SIZES:
        h = rolling.windows(p, n) >> np.uint64(64 - BITS)
        whole = left[: len(h)] >= n
        out.append((row[: len(h)][whole], h[whole].astype(np.int64)))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros((2, 1 << BITS), np.int64)
    for part in slices(batches, "text"):
        row, bucket = grams(texts(part.column(0)))
        label = part.column(1).to_numpy()
        seen = np.unique((row << BITS) | bucket)
        for y in (0, 1):
            found[y] += np.bincount(seen[label[seen >> BITS] == y] & ((1 << BITS) - 1), minlength=1 << BITS)
    used = np.flatnonzero(found.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(found[1][used]), pa.array(found[0][used])], ["bucket", "pos", "neg"])


def _index(buckets: np.ndarray) -> np.ndarray:
    at = np.full(1 << BITS, -1, np.int32)
    at[buckets] = np.arange(len(buckets))
    return at


def features(rows: list[str], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, each once, by row."""
    row, bucket = grams(rows)
    feature = at[bucket]
    hit = feature >= 0
    pairs = np.unique(row[hit] * len(at) + feature[hit])
    return pairs // len(at), pairs % len(at)


def fit_logistic(row, feature, y, weight, values, penalty: float = 1.0, steps: int = 60):
    """(weights, bias) by Newton steps with conjugate gradients; feature j of a row is values[j] if present."""
    n, k = len(y), len(values)
    x = values[feature]
    w = np.zeros(k + 1)  # the last is the bias
    ridge = np.append(np.full(k, penalty), 1e-6)

    def dot(v):
        return np.bincount(row, x * v[feature], minlength=n) + v[k]

    def back(r):
        return np.append(np.bincount(feature, r[row] * x, minlength=k), r.sum())

    def loss(v, z):
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (ridge * v * v).sum())

    z = dot(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        gradient = back(weight * (p - y)) + ridge * w
        size = np.linalg.norm(gradient)
        if size < 1e-3 * weight.sum() ** 0.5:
            break
        curve = weight * p * (1 - p) + 1e-9
        step, rest = np.zeros(k + 1), -gradient
        way, now = rest.copy(), rest @ rest
        for _ in range(30):
            turned = back(curve * dot(way)) + ridge * way
            a = now / (way @ turned)
            step += a * way
            rest -= a * turned
            new = rest @ rest
            if new < 0.01 * size * size:
                break
            way, now = rest + new / now * way, new
        dz, base, slope, a = dot(step), loss(w, z), gradient @ step, 1.0
        while loss(w + a * step, z + a * dz) > base + 1e-4 * a * slope and a > 1e-6:
            a /= 2
        w, z = w + a * step, z + a * dz
    return w[:k], float(w[k])


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS):
    """(buckets, weights, bias). Only rows outside `held_out` with a label of 0 or 1 are learned from.

    Without rows of both labels the model has no features and its bias says what share is labelled 1 (half, without any).
    """
    known = labels.filter(~held_out & F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("y"))
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = total.get(0, 0), total.get(1, 0)
    prior = (n1 + 1) / (n0 + n1 + 2)
    if not (n0 and n1):
        return np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior)))
    part = F.when(F.col("y") == 1, min(1.0, max_rows / 2 / n1)).otherwise(min(1.0, max_rows / 2 / n0))
    drawn = known.filter(F.pmod(F.xxhash64("_key"), F.lit(1_000_000)) < part * 1_000_000).dropDuplicates(["_key"])
    # the drawn keys are bounded by max_rows, whatever the size of the tables
    train = staged(docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(drawn), "_key").select("text", "y"), "training")
    counts = train.mapInArrow(_count, "bucket bigint, pos bigint, neg bigint").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    size = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    m0, m1 = size.get(0, 0), size.get(1, 0)
    if not (m0 and m1):
        return np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior)))
    ratio = F.log((F.col("pos") + 1) / (m1 + 2)) - F.log((F.col("neg") + 1) / (m0 + 2))
    top = counts.select("bucket", ratio.alias("r"), F.abs(ratio / F.sqrt(1 / (F.col("pos") + 1) + 1 / (F.col("neg") + 1))).alias("z"))
    top = top.orderBy(F.desc("z"), "bucket").limit(FEATURES).toPandas()  # FEATURES rows
    buckets, values = top["bucket"].to_numpy(), top["r"].to_numpy()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = _index(buckets)
        for piece in slices(batches, "text"):
            row, feature = features(texts(piece.column(0)), at)
            ends = np.searchsorted(row, np.arange(piece.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature, pa.int32()))
            yield pa.RecordBatch.from_arrays([piece.column(1), lists], ["y", "features"])

    learned = train.mapInArrow(rows, "y int, features array<int>").toPandas()  # at most about max_rows short lists
    y = learned["y"].to_numpy(np.float64)
    row = np.repeat(np.arange(len(y), dtype=np.int32), learned["features"].map(len).to_numpy())
    feature = np.concatenate([*learned["features"], np.zeros(0)]).astype(np.int32)
    del learned
    weight = np.where(y == 1, n1 / m1, n0 / m0)
    w, bias = fit_logistic(row, feature, y, weight, values)
    return buckets, w * values, float(bias)


def score(df: DataFrame, model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every whole text; null counts as empty, and an empty text gets the score of the bias."""
    buckets, weights, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = _index(buckets)
        for part in slices(batches, "text"):
            z = np.full(part.num_rows, bias)
            if len(weights):
                row, feature = features(texts(part.column(1)), at)
                z += np.bincount(row, weights[feature], minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], [key, "score"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(f"`{text}`").alias("text")).mapInArrow(run, f"`{key}` {kind}, score double")


def held_out(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """(key, held_out, score, predicted) of every row of `docs`.

    Repeated rows come out as often as they go in, rows without a key are scored and never held out; labels without a
    document teach nothing; an empty table gives an empty result.
    """
    scored = score(docs, fit(docs, labels, F.coalesce(held_out(key), F.lit(True)), key, text, max_rows=max_rows), key, text)
    return scored.select(
        key, F.coalesce(held_out(key), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """Rows of `docs` that the classifier does not reject, all columns as they were, whatever their names; one narrow pass
    after the fit. Null and empty texts get the bias alone; repeated rows stay or go together."""
    buckets, weights, bias = fit(docs, labels, F.coalesce(held_out(key), F.lit(True)), key, text, max_rows=max_rows)
    base, names = numbered(docs)
    body = f"c{names.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = _index(buckets)
        for part in slices(batches, body):
            z = np.full(part.num_rows, bias)
            if len(weights):
                row, feature = features(texts(part.column(body)), at)
                z += np.bincount(row, weights[feature], minlength=part.num_rows)
            yield part.filter(pa.array(z < 0))

    return base.mapInArrow(run, base.schema).toDF(*names)
