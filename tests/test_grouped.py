"""Models of all groups at once against single fits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from millwright.operators import grouped, models


def data(seed=0, groups=("a", "b", None, "rare"), n=400, d=4):
    rng = np.random.default_rng(seed)
    out = []
    for k, g in enumerate(groups):
        x = rng.normal(size=(n if g != "rare" else 12, d))
        y = (rng.random(len(x)) < 1 / (1 + np.exp(-(x[:, 0] * (k + 1) - 1.5 * x[:, 1] + k - 1)))).astype(float)
        if g == "b":
            y = (x[:, 0] > 0.1).astype(float)  # separable: only the penalty bounds the slopes
        out += [(g, v.tolist(), float(t), float(w)) for v, t, w in zip(x, y, rng.uniform(0.5, 2, len(x)), strict=True)]
    return out


def single(rows, l2):
    x, y, w = (np.array(c) for c in zip(*[r[1:] for r in rows], strict=True))
    beta = np.zeros(x.shape[1] + 1)
    for _ in range(200):
        loss, step, _ = grouped.newton(grouped.evaluated(x, y, w, beta), beta, l2)
        t = 1.0
        while grouped.newton(grouped.evaluated(x, y, w, beta + t * step), beta + t * step, l2)[0] > loss + 1e-14 and t > 1e-12:
            t /= 2
        beta = beta + t * step
    return beta


def test_equals_single_fits_and_the_library(spark):
    rows = data()
    df = spark.createDataFrame(rows, "machine string, x array<double>, y double, w double").repartition(5)
    got = {r["machine"]: r for r in grouped.fit_logistic(df, "machine", 1.0).collect()}
    assert set(got) == {"a", "b", None, "rare"} and all(r["converged"] for r in got.values())
    for g in got:
        mine = [r for r in rows if r[0] == g]
        assert np.allclose(got[g]["beta"], single(mine, 1.0), atol=1e-6)
    mine = df.where("machine = 'a'").withColumn("features", array_to_vector("x"))
    total = mine.agg(F.sum("w")).first()[0]
    lib = LogisticRegression(labelCol="y", weightCol="w", regParam=1.0 / total, standardization=False, maxIter=500, tol=1e-13).fit(mine)
    assert np.allclose(got["a"]["beta"], [lib.intercept, *lib.coefficients], atol=1e-6)


def test_scaling_uses_only_the_group_and_its_training_rows(spark):
    rows = [("a", 1, 1.0, None), ("a", 1, 3.0, None), ("a", 1, None, None), ("a", 0, 100.0, 5.0), ("b", 1, 7.0, 1.0), ("b", 1, 7.0, 3.0), (None, 1, 0.0, 2.0), (None, 1, 4.0, None)]
    df = spark.createDataFrame(rows, "machine string, part int, u double, v double")
    got = grouped.standardised(df, "machine", ["u", "v"], F.col("part") == 1, ["part"])
    by = {}
    for r in got.collect():
        by.setdefault((r["machine"], r["part"]), []).append([round(v, 6) for v in r["x"]])
    s = 1.5**0.5  # medians 2; training values 1, 3 and the filled 2
    assert sorted(by["a", 1]) == sorted([[-s, 0.0], [s, 0.0], [0.0, 0.0]] and [[round(-s, 6), 0.0], [0.0, 0.0], [round(s, 6), 0.0]])
    assert by["a", 0] == [[round(98 / (2 / 3) ** 0.5, 6), 0.0]]
    assert sorted(by["b", 1]) == [[0.0, -1.0], [0.0, 1.0]]
    assert sorted(by[None, 1]) == [[-1.0, 0.0], [1.0, 0.0]]


def test_no_group_large_enough(spark):
    df = spark.createDataFrame([("a", 0, 1.0, "train", 1), ("a", 1, 2.0, "test", 0)], "machine string, ts int, u double, part string, y int")
    assert models.per_machine(df, ["u"], min_rows=10).collect() == []
    assert grouped.fit_logistic(spark.createDataFrame([], "machine string, x array<double>, y double, w double"), "machine").collect() == []


def test_planted_signal(spark):
    rng = np.random.default_rng(1)
    rows = []
    for m, sign in (("a", 1), ("b", -1)):  # opposite signs: a pooled model finds nothing
        for i in range(600):
            u = float(rng.normal())
            rows.append((m, i, u, "train" if i < 400 else "test", int(rng.random() < 1 / (1 + np.exp(-3 * sign * u)))))
    df = spark.createDataFrame(rows, "machine string, ts int, u double, part string, y int")
    got = {r["machine"]: r for r in models.per_machine(df, ["u"]).collect()}
    assert set(got) == {"a", "b"} and min(r["roc_auc"] for r in got.values()) == pytest.approx(0.9, abs=0.08)
