"""One logistic regression per group, all fitted at once by Newton steps on aggregated gradients and Gram matrices.

A pass joins every row with its group's candidate coefficients; tasks add up loss, gradient and curvature per group (a row
of (d + 1)(d + 4) / 2 + 2 numbers), the sums meet by group, and each group takes its next step in its own task. Nothing goes
through the driver but the count of groups still moving, a group's rows never gather in one task, and the number of passes
is that of the slowest group, not the number of groups.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .anomaly import melt
from .scan import percentiles

HELD_BYTES = 64 << 20
"""Sums that a task holds before it sends them on."""


def standardised(rows: DataFrame, key: str, columns: Sequence[str], train: Column, keep: Sequence[str]) -> DataFrame:
    """`x`: the columns with each group's exact training median for missing values, then centred and scaled by its
    training mean and deviation. Columns without a value or without spread in a group's training rows are 0 there."""
    rows = rows.select(key, *keep, train.alias("__train"), *[F.col(c).cast("double").alias(c) for c in columns])
    medians = percentiles(melt(rows.where("__train"), columns, (key,)), [key, "feature"], "value", {"m": 0.5})
    medians = medians.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("feature", "m"))).alias("__m"))
    # a NULL key is a group of its own
    same = lambda a, b: a[key].eqNullSafe(b[key])
    joined = rows.join(medians, same(rows, medians), "left").drop(medians[key])
    filled = joined.select(key, *keep, "__train", *[F.coalesce(F.col(c), F.try_element_at("__m", F.lit(c))).alias(c) for c in columns])
    spread = filled.where("__train").groupBy(key).agg(
        F.array(*[F.avg(c) for c in columns]).alias("__a"), F.array(*[F.stddev_pop(c) for c in columns]).alias("__s")
    )
    out = filled.join(spread, same(filled, spread), "left").drop(spread[key])
    scaled = [F.when(F.col("__s")[i] > 1e-12, (F.col(c) - F.col("__a")[i]) / F.col("__s")[i]).otherwise(0.0) for i, c in enumerate(columns)]
    return out.select(key, *keep, "__train", F.array(*scaled).alias("x"))


def evaluated(x: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Loss, gradient and the upper triangle of the curvature of weighted rows; the intercept comes first."""
    z = np.hstack((np.ones((len(x), 1)), x))
    m = z @ beta
    p = 0.5 * (1 + np.tanh(0.5 * m))
    loss = (w * (np.logaddexp(0, m) - y * m)).sum()
    gram = (z * (w * p * (1 - p))[:, None]).T @ z
    return np.concatenate(([loss], z.T @ (w * (p - y)), gram[np.triu_indices(z.shape[1])]))


def newton(total: np.ndarray, beta: np.ndarray, l2: float) -> tuple[float, np.ndarray, float]:
    """Penalised loss at `beta`, the Newton step from it, and the decrease it promises."""
    d = len(beta)
    loss, gradient = total[0], total[1 : d + 1]
    gram = np.zeros((d, d))
    gram[np.triu_indices(d)] = total[d + 1 :]
    gram = gram + np.triu(gram, 1).T
    ridge = np.full(d, l2)
    ridge[0] = 0.0
    gradient = gradient + ridge * beta
    step = -np.linalg.lstsq(gram + np.diag(ridge), gradient, rcond=None)[0]
    return loss + 0.5 * (ridge * beta * beta).sum(), step, float(-gradient @ step)


def fit_logistic(rows: DataFrame, key: str, l2: float = 1.0, tol: float = 1e-12, passes: int = 60) -> DataFrame:
    """Coefficients per group (key, beta with the intercept first, loss, passes, converged) of rows (key, x, y, w).

    Minimises the weighted log loss plus l2 / 2 times the squared slopes. A candidate that does not lower the loss is
    halved back towards the last point; a group stops when the promised decrease is below `tol` of its loss.
    """
    kind = rows.schema[key].dataType.simpleString()
    rows = stage(rows.select(key, "x", "y", "w"), "grouped-rows")
    first = F.transform(F.sequence(F.lit(0), F.max(F.size("x"))), lambda _: F.lit(0.0))
    state = rows.groupBy(key).agg(first.alias("beta")).select(
        key, "beta", F.col("beta").alias("base"), F.col("beta").alias("step"), F.lit(None).cast("double").alias("loss"),
        F.lit(1.0).alias("t"), F.lit(0).alias("passes"), F.lit(False).alias("converged"),
    )
    state, done = stage(state, "grouped-state"), None
    key_type = rows.limit(0).select(key).toArrow().schema.field(key).type
    partial = pa.schema([(key, key_type), ("sums", pa.list_(pa.float64()))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            size = len(batch.column(4)[0]) - 1 if batch.num_rows else 0
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(names), size)
            y, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            places: dict = {}
            for i, name in enumerate(names):
                places.setdefault(name, []).append(i)
            for name, at in places.items():
                part = evaluated(x[at], y[at], w[at], np.array(batch.column(4)[at[0]].as_py()))
                held[name] = held[name] + part if name in held else part
            if sum(v.nbytes for v in held.values()) > HELD_BYTES:
                yield send(held)
                held = {}
        if held:
            yield send(held)

    def send(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held, key_type), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], schema=partial)

    def move(parts: pa.Table, at: pa.Table) -> pa.Table:
        (now,) = at.to_pylist()
        beta = np.array(now["beta"])
        total = np.sum([np.array(x) for x in parts["sums"].to_pylist()], axis=0)
        loss, step, promise = newton(total, beta, l2)
        now["passes"] += 1
        if now["loss"] is not None and not loss <= now["loss"] + 1e-13 * abs(now["loss"]):  # back towards the last point
            now["t"] /= 2
            now["beta"] = (np.array(now["base"]) + now["t"] * np.array(now["step"])).tolist()
            if now["t"] < 1e-10:
                now["beta"], now["converged"] = now["base"], True
        else:
            now |= {"base": now["beta"], "step": step.tolist(), "loss": loss, "t": 1.0, "converged": promise <= tol * max(1.0, loss)}
            if not now["converged"]:
                now["beta"] = (beta + step).tolist()
        return pa.Table.from_pylist([now], schema=at.schema)

    for _ in range(passes):
        joined = rows.join(state.select(key, "beta"), rows[key].eqNullSafe(state[key])).select(rows[key], "x", "y", "w", "beta")
        parts = joined.mapInArrow(add, f"{key} {kind}, sums array<double>")
        state = stage(parts.groupBy(key).cogroup(state.groupBy(key)).applyInArrow(move, state.schema), "grouped-state")
        ended = state.where("converged")
        done = ended if done is None else done.unionByName(ended)
        state = state.where("NOT converged")
        if state.isEmpty():
            return done.select(key, "beta", "loss", "passes", "converged")
    return done.unionByName(state).select(key, F.col("base").alias("beta"), "loss", "passes", "converged")


def probability(x: str, beta: str) -> Column:
    """Logistic of the intercept plus the inner product."""
    terms = F.zip_with(x, F.slice(beta, 2, F.size(x)), lambda a, b: a * b)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.aggregate(terms, F.col(beta)[0], lambda s, v: s + v)))
