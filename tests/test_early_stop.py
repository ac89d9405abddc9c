"""Early stopping of the perceptron: a planted signal is learned, the stop is recorded, noise ends early."""

import datetime as dt
import random

from pyspark.sql import functions as F

from millwright.operators import metrics, models
from millwright.operators.predict import chrono_split


def _rows(spark, signal):
    rng = random.Random(4)
    start, out = dt.datetime(2026, 1, 1), []
    for m in range(3):
        for i in range(400):
            a, b = rng.gauss(0, 1), rng.gauss(0, 1)
            y = int(a * b + rng.gauss(0, 0.3) > 0) if signal else rng.randint(0, 1)
            out.append((f"m{m}", start + dt.timedelta(minutes=i), y, a if rng.random() > 0.05 else None, b, None))
    return spark.createDataFrame(out, "machine string, ts timestamp, y int, a double, b double, empty double")


def _auc(scored):
    return metrics.report(scored.select(F.lit("x").alias("g"), "y", "risk"), ["g"]).first()["roc_auc"]


def test_planted_signal_and_recorded_stop(spark):
    split = chrono_split(_rows(spark, True), 0.7)
    columns = ["a", "b", "empty"]
    df = models.prepare(split, columns)
    train = models.balanced(df.where("part = 'train'"))
    model, rounds = models.fit_mlp(train, columns)
    losses = dict(rounds)
    assert [n for n, _ in rounds] == list(range(20, rounds[-1][0] + 1, 20)) and rounds[-1][0] <= 300
    assert _auc(models.score(model, df.where("part = 'test'"))) > 0.85
    # the kept weights are those of the best round, measured on rows that were not learned from
    later = chrono_split(train.drop("part"), 0.9, ties=tuple(columns)).where("part = 'test'")
    kept = models.log_loss(model.stages[-1], models.PipelineModel(model.stages[:-1]).transform(later))
    assert abs(kept - min(losses.values())) < 1e-3


def test_noise_stops_before_the_limit(spark):
    df = models.prepare(chrono_split(_rows(spark, False), 0.7), ["a", "b"])
    rounds = models.fit_mlp(models.balanced(df.where("part = 'train'")), ["a", "b"])[1]
    assert rounds[-1][0] < 300


def test_no_rows_to_validate_on(spark):
    few = _rows(spark, True).groupBy("machine", "y").agg(F.min("ts").alias("ts"), F.max("a").alias("a"), F.max("b").alias("b"))
    train = models.balanced(models.prepare(few.withColumn("part", F.lit("train")), ["a", "b"]))
    model, rounds = models.fit_mlp(train.where("machine = 'm0'"), ["a", "b"], held=0.0)
    assert rounds == [(300, None)] and models.score(model, train).count() == 6
