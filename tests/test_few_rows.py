"""Learners with no row, no column or one class to learn from: every held-out row still gets a risk."""

import datetime as dt

import pytest

from millwright.operators import models

SCHEMA = "machine string, ts timestamp, y int, part string, a double, b double, empty double"
FAMILIES = ("logreg", "random_forest", "gbt", "mlp")


def split(spark, train, test, machines=("m0", "m1")):
    """`train` and `test` are the labels of a machine's rows."""
    rows = []
    for m in machines:
        for i, (y, part) in enumerate([(y, "train") for y in train] + [(y, "test") for y in test]):
            rows.append((m, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i), y, part, float(i % 7), None if i % 3 else 1.0 + i, None))
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def risks(df):
    rows = df.collect()
    assert {r["y"] for r in rows} <= {0.0, 1.0} and len({(r["machine"], r["ts"]) for r in rows}) == len(rows)
    return [r["risk"] for r in rows]


@pytest.mark.parametrize("name", FAMILIES)
def test_no_training_row(spark, name):
    assert risks(models.train_and_score(split(spark, [], [0, 1, 1]), ["a", "b", "empty"], name)) == [0.5] * 6
    assert risks(models.train_and_score(split(spark, [], []), ["a", "b", "empty"], name)) == []


@pytest.mark.parametrize("name", FAMILIES)
def test_no_usable_column(spark, name):
    """The classes alone: even with balanced weights, otherwise their share."""
    got = risks(models.train_and_score(split(spark, [1, 0, 0, 0] * 30, [0, 1]), ["empty"], name))
    assert len(got) == 4 and len(set(got)) == 1
    assert got[0] == pytest.approx(0.5 if name in ("logreg", "random_forest") else 0.25, abs=0.06)


def test_forest_without_a_stop(spark):
    assert risks(models.train_and_score(split(spark, [0] * 30, [0, 1]), ["a", "b"], "random_forest", trees=3)) == [0.0] * 4


def test_importance(spark):
    assert models.importance(split(spark, [], [0, 1]), ["a", "b"]).collect() == []
    assert models.importance(split(spark, [0, 1] * 5, [0, 1]), ["empty"], trees=3).collect() == []


def test_one_hot(spark):
    """Held-out rows are reported on though nothing was learned; without held-out rows there is no report."""
    r = models.one_hot(split(spark, [], [0, 1, 1]), ["a"], trees=3).collect()
    assert [(x["model"], x["tp"] + x["fn"], x["fp"] + x["tn"], x["roc_auc"]) for x in r] == [("random_forest+machine", 4, 2, 0.5)]
    assert models.one_hot(split(spark, [], []), ["a"], trees=3).collect() == []
    assert len(models.one_hot(split(spark, [0, 1] * 5, [0, 1]), ["empty"], trees=3).collect()) == 1


def test_imputed_scaled(spark):
    for train in ([], [0, 1]):
        rows = models.imputed_scaled(split(spark, train, [0, 1, 1]), ["a", "empty"] if not train else ["empty"]).collect()
        assert len(rows) == 2 * (len(train) + 3) and all(r["x"] == [] for r in rows)


def test_ladder_keeps_its_steps(spark):
    space = {"maxIter": (2,), "maxDepth": (2,)}
    for test, pr_auc in (([], None), ([0, 1], 0.5)):
        r = models.tuning_search(split(spark, [], test), ["a"], ["b"], trials=1, space=space, rounds=2).collect()
        assert sorted(x["step"] for x in r) == ["default", "features", "search", "search", "tuned"] and sum(x["selected"] for x in r) == 1
        assert [x["test_pr_auc"] for x in r if x["step"] != "search"] == [pr_auc] * 3


def test_comparisons(spark):
    """Families, feature sets and regimes are reported for the groups with held-out rows, learned from or not."""
    one = split(spark, [], [0, 1], ["m0"])
    assert {r["model"] for r in models.benchmark(one, ["a"]).collect()} == {*FAMILIES, "baseline_always_positive"}
    assert models.benchmark(split(spark, [], []), ["a"]).collect() == []
    assert {r["features"] for r in models.ablation(one, {"x": ["a"], "y": ["empty"]}).collect()} == {"x", "y"}
    r = models.regime_experiment(one, ["a", "b"], ["b"], {"g": ["m0"], "h": ["m1"]}, names=("logreg", "gbt")).collect()
    assert sorted((x["experiment"], x["test_set"], x["learner"], x["pr_auc"]) for x in r) == sorted((e, "g", n, 0.5) for e in ("own", "cross", "znorm") for n in ("logreg", "gbt"))
