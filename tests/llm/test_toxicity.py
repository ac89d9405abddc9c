"""Held-out accuracy on labelled documents, the fit against a plain solver, and odd inputs."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from millwright.llm import toxicity as tx
from millwright.llm.common import table

SF = "/root/testdata/sf0.1"


def test_grams_of_whole_texts():
    row, bucket = tx.grams(["Abcdef", "ab", "", "ABCDEF"])
    assert np.bincount(row, minlength=4).tolist() == [4 + 3 + 2, 0, 0, 9]
    assert sorted(bucket[row == 0]) == sorted(bucket[row == 3])


def test_fit_reaches_the_optimum():
    rng = np.random.default_rng(1)
    x = rng.random((200, 12)) < 0.3
    y = (x[:, 0] | x[:, 1]).astype(float)
    row, feature = np.nonzero(x)
    values = rng.normal(size=12) + 2
    w, b = tx.fit_logistic(row, feature, y, np.ones(200), values)
    z = (x * values) @ w + b
    error = 1 / (1 + np.exp(-z)) - y
    assert abs(error.sum()) < 0.1 and np.abs((x * values).T @ error + w).max() < 0.1


def test_held_out_accuracy(spark):
    labels = table(spark, SF, "labels")
    got = tx.toxicity(table(spark, SF, "documents"), labels).join(labels, "doc_id").toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
    held = got[got["held_out"]]
    ranks = held["score"].rank()
    ones = held["toxic"] == 1
    auc = (ranks[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    assert auc > 0.97 and (held["predicted"] == held["toxic"]).mean() > 0.95


def test_odd_inputs(spark, docs):
    rows = [(i, f"plain text number {i} of the kind" if i % 2 else f"you awful nasty {i} thing") for i in range(60)]
    df = docs([*rows, (100, None), (101, ""), (None, "nasty"), (3, rows[3][1])]).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows] + [(999, 1), (None, 1), (5, None), (4, 7)], "doc_id long, toxic int")
    got = tx.toxicity(df, labels).collect()
    assert len(got) == 64
    by = {r.doc_id: r for r in got}
    assert all(by[i].predicted == 1 - i % 2 for i, _ in rows) and by[None].held_out is False and by[100].score == by[101].score
    kept = tx.keep_clean(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {i for i, _ in rows if i % 2}
    assert not {r.doc_id for r in kept.collect()} & {i for i, _ in rows if not i % 2}
    assert tx.toxicity(df.limit(0), labels).count() == 0
    none = tx.toxicity(df, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_clashing_names(spark):
    rows = [(i, f"plain words number {i} of the kind" if i % 2 else f"you awful nasty {i} thing", i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, body string, text long").selectExpr("*", "'k' as c0", "'k' as y", "'k' as score")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, *_ in rows], "doc_id long, toxic int")
    kept = tx.keep_clean(df, labels, text="body")
    assert kept.columns == df.columns
    assert sorted(r.text for r in kept.collect()) == list(range(1, 60, 2))
