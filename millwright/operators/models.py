"""Stop-prediction model families as ML pipelines, compared on the same chronological future."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import grouped, metrics
from .anomaly import melt
from .predict import chrono_split, robust_znorm
from .scan import attach, percentiles


def balanced(train: DataFrame) -> DataFrame:
    """Row weights n / (2 * class size). The two class sizes are one row next to every training row, no join on y."""
    sizes = train.agg(F.count_if(F.col("y") == 1).alias("__ones"), F.count_if(F.col("y") == 0).alias("__zeros"))
    own = F.when(F.col("y") == 1, F.col("__ones")).when(F.col("y") == 0, F.col("__zeros"))
    weight = (F.col("__ones") + F.col("__zeros")) / (2.0 * own)
    return attach(train, sizes).where(own.isNotNull()).withColumn("weight", weight).drop("__ones", "__zeros")


def usable_columns(train: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at least one training value (one aggregate row to the driver)."""
    if not columns:
        return []
    row = train.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] > 0]


CONSTANT = "__constant"


def preprocess(columns: Sequence[str], *, scale: bool, indicators: bool = False) -> list:
    """Median imputation and assembly, optionally standardised; trees also see which values were missing.

    Without a column there is one constant input, so a learner still has the classes to learn from.
    """
    filled = [f"{c}__f" for c in columns]
    stages = [Imputer(strategy="median", inputCols=list(columns), outputCols=filled, relativeError=0.0001)] if columns else []
    inputs = filled + ([f"{c}__isnull" for c in columns] if indicators else []) or [CONSTANT]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="raw" if scale else "features"))
    if scale:
        stages.append(StandardScaler(withMean=True, withStd=True, inputCol="raw", outputCol="features"))
    return stages


def with_indicators(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select("*", *[F.col(c).isNull().cast("double").alias(f"{c}__isnull") for c in columns])


def make_models(n_inputs: int, *, trees: int = 120, rounds: int = 20, seed: int = 0, gbt: dict | None = None) -> dict:
    """The compared families. Weighted learners use `weight`; boosting runs on plain rows."""
    boost = dict(maxIter=rounds, stepSize=0.07, maxDepth=4, minInstancesPerNode=20, seed=seed) | (gbt or {})
    common = dict(featuresCol="features", labelCol="y")
    return {
        "logreg": (LogisticRegression(weightCol="weight", maxIter=100, **common), True, False),
        "random_forest": (RandomForestClassifier(weightCol="weight", numTrees=trees, seed=seed, **common), False, False),
        "gbt": (GBTClassifier(**boost, **common), False, True),
        "mlp": (MultilayerPerceptronClassifier(layers=[max(n_inputs, 1), 64, 24, 2], maxIter=300, seed=seed, **common), True, False),
    }


def prepare(split: DataFrame, columns: Sequence[str]) -> DataFrame:
    df = split.withColumn("y", F.col("y").cast("double"))
    df = df.select(*[c for c in df.columns if c not in columns], *[F.col(c).cast("double").alias(c) for c in columns])
    return with_indicators(df.withColumn(CONSTANT, F.lit(0.0)), columns)


def fit(train: DataFrame, columns: Sequence[str], name: str, **kw) -> PipelineModel | None:
    """The fitted family on the usable columns; None without a training row."""
    if not columns and train.isEmpty():
        return None
    if name == "mlp":
        return fit_mlp(train, columns, **kw)[0]
    est, scale, indicators = make_models(len(columns), **kw)[name]
    return Pipeline(stages=[*preprocess(columns, scale=scale, indicators=indicators), est]).fit(train)


def log_loss(model, rows: DataFrame) -> float | None:
    """Mean cross-entropy of a fitted classifier; None without rows."""
    p = F.least(F.greatest(vector_to_array("probability")[1], F.lit(1e-12)), F.lit(1 - 1e-12))
    return model.transform(rows).agg(F.avg(-F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p)))).first()[0]


def fit_mlp(
    train: DataFrame, columns: Sequence[str], *, held: float = 0.1, step: int = 20, patience: int = 2, tol: float = 1e-4, **kw,
) -> tuple[PipelineModel, list[tuple[int, float | None]]]:
    """Perceptron with early stopping, and (iterations, loss) of each round.

    The latest `held` of every machine's rows is validated on and not learned from. A round goes on from the weights of the
    one before; after `patience` rounds without a gain of `tol`, or at the family's iteration limit, the best round's
    model stays. Without validation rows it learns from all rows for the whole limit, in one round.
    """
    parts = chrono_split(train.drop("part"), 1 - held, ties=tuple(columns))
    learn, later = parts.where(F.col("part") == "train"), parts.where(F.col("part") == "test")
    cols = usable_columns(learn, columns)
    both = cols and learn.agg(F.count_distinct("y")).first()[0] == 2 and not later.isEmpty()
    if not both:
        learn, cols = train, usable_columns(train, columns)
    est = make_models(len(cols), **kw)["mlp"][0]
    ready = Pipeline(stages=preprocess(cols, scale=True)).fit(learn)
    learn = stage(ready.transform(learn).select("features", "y"), "mlp")
    limit = est.getMaxIter()
    if not both:
        return PipelineModel([*ready.stages, est.fit(learn)]), [(limit, None)]
    later = stage(ready.transform(later).select("features", "y"), "mlp-later")
    best, rounds, weights = None, [], None
    for done in range(step, limit + 1, step):
        turn = est.copy({est.maxIter: step})
        if weights is not None:
            turn.setInitialWeights(weights)
        model = turn.fit(learn)
        weights, loss = model.weights, log_loss(model, later)
        rounds.append((done, loss))
        if best is None or loss < best[1] - tol:
            best = (done, loss, model)
        elif done - best[0] >= patience * step:
            break
    return PipelineModel([*ready.stages, best[2]]), rounds


def score(model: PipelineModel | None, rows: DataFrame, keep: Sequence[str] = ("machine", "ts", "y")) -> DataFrame:
    """Risk of every row. Without a model both classes are equally likely; a forest that saw no stop has no second class."""
    if model is None:
        return rows.select(*keep, F.lit(0.5).alias("risk"))
    p = model.transform(rows)
    return p.select(*keep, F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0)).alias("risk"))


def _train(rows: DataFrame) -> DataFrame:
    return balanced(rows.where(F.col("part") == "train"))


def train_and_score(split: DataFrame, columns: Sequence[str], name: str = "gbt", test: DataFrame | None = None, **kw) -> DataFrame:
    """Fit on the train part, score the test part (or the given rows)."""
    df = prepare(split, columns)
    train = _train(df)
    cols = usable_columns(train, columns)
    rows = prepare(test, columns) if test is not None else df.where(F.col("part") == "test")
    return score(fit(train, cols, name, **kw), rows)


def benchmark(split: DataFrame, columns: Sequence[str], names: Sequence[str] = ("logreg", "random_forest", "gbt", "mlp"), **kw) -> DataFrame:
    """Metrics of every family and the trivial baselines on the same held-out rows, best AP first."""
    out = None
    for name in names:
        s = train_and_score(split, columns, name, **kw).select(F.lit(name).alias("model"), "y", "risk")
        out = s if out is None else out.unionByName(s)
    test = split.where(F.col("part") == "test")
    learned = metrics.report(out, ["model"])
    always = metrics.report(test.select(F.lit("baseline_always_positive").alias("model"), "y", F.lit(1.0).alias("risk")), ["model"], fixed=0.5)
    rows = learned.unionByName(always)
    if "anystop_cnt_1h" in split.columns:
        rows = rows.unionByName(metrics.report(recent_stop_scores(test).withColumn("model", F.lit("baseline_recent_stop")), ["model"]))
    return rows.orderBy(F.col("pr_auc").desc_nulls_last(), "model")


def recent_stop_scores(test: DataFrame, column: str = "anystop_cnt_1h", keep: Sequence[str] = ("y",)) -> DataFrame:
    """Persistence baseline: stops in the last hour scaled by their maximum."""
    mx = test.agg(F.max(column).alias("mx"))
    top = F.when(F.col("mx") > 0, F.col("mx")).otherwise(1.0)
    return attach(test, mx).select(*keep, F.coalesce(F.col(column) / top, F.lit(0.0)).alias("risk"))


def importance(split: DataFrame, columns: Sequence[str], top: int = 15, trees: int = 100) -> DataFrame:
    """Random-forest importances of the leading features; none without a usable column."""
    train = _train(prepare(split, columns))
    cols = usable_columns(train, columns)
    model = fit(train, cols, "random_forest", trees=trees)
    vals = model.stages[-1].featureImportances.toArray() if model is not None else []
    rows = sorted(((c, float(v)) for c, v in zip(cols, vals)), key=lambda x: (-x[1], x[0]))[:top]
    return split.sparkSession.createDataFrame(rows, "feature string, importance double")


def regime_experiment(split: DataFrame, columns: Sequence[str], device: Sequence[str], groups: dict[str, list[str]],
    names: Sequence[str] = ("logreg", "random_forest", "gbt"), **kw) -> DataFrame:
    """Own, merged and z-normed training for each group and learner, always tested on the same rows."""
    everyone = sorted({m for ms in groups.values() for m in ms})
    merged = split.where(F.col("machine").isin(*everyone))
    normed = stage(robust_znorm(merged, list(device)), "znorm")  # every learner reads it
    runs = []
    for g, members in groups.items():
        own = split.where(F.col("machine").isin(*members))
        test = own.where(F.col("part") == "test")
        ztest = normed.where((F.col("part") == "test") & F.col("machine").isin(*members))
        runs += [(f"own|{g}|{g}", own, test), (f"cross|merged|{g}", merged, test), (f"znorm|merged|{g}", normed, ztest)]
    out = None
    for label, train, test in runs:
        for name in names:
            s = train_and_score(train, columns, name, test=test, **kw).select(F.lit(f"{label}|{name}").alias("run"), "y", "risk")
            out = s if out is None else out.unionByName(s)
    r = metrics.report(out, ["run"])
    parts = F.split("run", r"\|")
    return r.select(parts[0].alias("experiment"), parts[1].alias("train_regime"), parts[2].alias("test_set"), parts[3].alias("learner"), *[c for c in r.columns if c != "run"])


SPACE = {
    "maxDepth": (3, 4, 5, 6, 8), "maxIter": (100, 200, 300, 400, 500), "stepSize": (0.02, 0.03, 0.05, 0.07, 0.1), "minInstancesPerNode": (10, 20, 40, 80),
    "subsamplingRate": (0.6, 0.8, 1.0), "featureSubsetStrategy": ("all", "0.5", "sqrt"), "maxBins": (32, 64, 128),
}
"""What a search draws from: seven parameters of the boosted trees."""


def draws(n: int, seed: int = 0, space: dict | None = None) -> list[dict]:
    """`n` parameter sets drawn independently with a seed."""
    pick = random.Random(seed)
    return [{k: pick.choice(v) for k, v in (space or SPACE).items()} for _ in range(n)]


def tuning_search(
    split: DataFrame, columns: Sequence[str], extra: Sequence[str] = (), trials: int = 40, seed: int = 0, space: dict | None = None, inner_frac: float = 0.75, rounds: int = 350,
) -> DataFrame:
    """A ladder of three steps, each tested once on the held-out rows: the default, with the extra columns, and tuned.

    The tuned step takes the best of the default and `trials` seeded draws by average precision on an inner
    chronological validation. The extra columns must be in `split`. One row per trial and one per step.
    """
    wide = [*columns, *extra]
    inner = chrono_split(split.where(F.col("part") == "train").drop("part"), inner_frac)
    options, found = [{"maxIter": rounds}, *draws(trials, seed, space)], []
    for i, params in enumerate(options):
        s = train_and_score(inner, wide, "gbt", gbt=params).withColumn("g", F.lit(1))
        ap = metrics.average_precision(metrics.pr_points(s, ["g"]), ["g"]).first()
        found.append(("search", i, str(params), float(ap["pr_auc"] or 0.0) if ap else 0.0))
    best = max(found, key=lambda t: (t[3], -t[1]))[1]
    steps = {"default": (list(columns), options[0]), "features": (wide, options[0]), "tuned": (wide, options[best])}
    tested = None
    for step, (cols, params) in steps.items():
        s = train_and_score(split, cols, "gbt", gbt=params).select(F.lit(step).alias("step"), "y", "risk")
        tested = s if tested is None else tested.unionByName(s)
    ladder = split.sparkSession.createDataFrame([(x,) for x in steps], "step string")
    report = ladder.join(metrics.report(tested, ["step"]), "step", "left").select(  # a step without held-out rows stays
        "step", F.lit(None).cast("int").alias("trial"), F.lit(None).cast("string").alias("params"), F.lit(None).cast("double").alias("inner_pr_auc"),
        F.col("pr_auc").alias("test_pr_auc"), F.col("roc_auc").alias("test_roc_auc"), "threshold",
    )
    rows = split.sparkSession.createDataFrame(found, "step string, trial int, params string, inner_pr_auc double")
    return rows.unionByName(report, allowMissingColumns=True).withColumn("selected", F.coalesce(F.col("trial") == best, F.lit(False)))


def ablation(split: DataFrame, sets: dict[str, Sequence[str]], name: str = "logreg", **kw) -> DataFrame:
    """The same learner on different feature sets."""
    out = None
    for label, cols in sets.items():
        s = train_and_score(split, list(cols), name, **kw).select(F.lit(label).alias("features"), "y", "risk")
        out = s if out is None else out.unionByName(s)
    return metrics.report(out, ["features"])


def own_model_machines(split: DataFrame, min_rows: int = 300) -> DataFrame:
    """Machines with enough training rows and both classes on both sides, with their counts."""
    return split.groupBy("machine").agg(
        F.count_if(F.col("part") == "train").alias("n_train"), F.count_if(F.col("part") == "test").alias("n_test"),
        F.count_distinct(F.when(F.col("part") == "train", F.col("y"))).alias("ct"),
        F.count_distinct(F.when(F.col("part") == "test", F.col("y"))).alias("ce"),
    ).where((F.col("n_train") >= min_rows) & (F.col("ct") == 2) & (F.col("ce") == 2)).select("machine", "n_train", "n_test")


def per_machine_scores(split: DataFrame, columns: Sequence[str], min_rows: int = 300, l2: float = 1.0) -> DataFrame:
    """Held-out risk of every machine's own logistic regression (balanced classes), all machines fitted together."""
    chosen = own_model_machines(split, min_rows)
    rows = split.join(chosen.select("machine"), "machine", "left_semi")
    x = grouped.standardised(rows, "machine", columns, F.col("part") == "train", ["ts", "y"])
    x = stage(x.withColumn("y", F.col("y").cast("double")), "own-models")
    train = x.where("__train")
    sizes = train.groupBy("machine").agg(F.count(F.lit(1)).alias("__n"), F.sum("y").alias("__p"))
    own = F.when(F.col("y") == 1, F.col("__p")).otherwise(F.col("__n") - F.col("__p"))
    fitted = grouped.fit_logistic(train.join(sizes, "machine").withColumn("w", F.col("__n") / (2.0 * own)), "machine", l2)
    test = x.where("NOT __train").join(fitted.select("machine", "beta"), "machine")
    return test.select("machine", "ts", "y", grouped.probability("x", "beta").alias("risk"))


def per_machine(split: DataFrame, columns: Sequence[str], min_rows: int = 300, l2: float = 1.0) -> DataFrame:
    """Metrics of one logistic regression per machine on its own held-out rows."""
    return metrics.report(per_machine_scores(split, columns, min_rows, l2).select("machine", "y", "risk"), ["machine"])


def one_hot(split: DataFrame, columns: Sequence[str], name: str = "random_forest", **kw) -> DataFrame:
    """Pooled model that also sees which machine a row belongs to."""
    enc = Pipeline(stages=[
        StringIndexer(inputCol="machine", outputCol="m_idx", handleInvalid="keep"),
        OneHotEncoder(inputCols=["m_idx"], outputCols=["m_vec"]),
    ])
    df = prepare(split, columns)
    train = _train(df)
    cols = usable_columns(train, columns)
    est, scale, ind = make_models(len(cols), **kw)[name]
    stages = preprocess(cols, scale=False)
    stages[-1].setInputCols([*stages[-1].getInputCols(), "m_vec"])
    model = None if not cols and train.isEmpty() else Pipeline(stages=[enc, *stages, est]).fit(train)
    s = score(model, df.where(F.col("part") == "test"))
    return metrics.report(s.withColumn("model", F.lit(f"{name}+machine")), ["model"])


def imputed_scaled(split: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact train medians for missing values, then train means and deviations; all rows, as one array column.

    Columns without a training value are left out, a constant one becomes 0. The statistics are single rows.
    """
    df = prepare(split, columns)
    train = df.where(F.col("part") == "train")
    cols = usable_columns(train, columns)
    if not cols:
        return df.select("machine", "ts", "part", F.array().cast("array<double>").alias("x"))
    medians = percentiles(melt(train, cols, ()), ["feature"], "value", {"m": 0.5})
    row = medians.agg(*[F.max(F.when(F.col("feature") == c, F.col("m"))).alias(f"__m_{c}") for c in cols])
    filled = attach(df, row).select("machine", "ts", "part", *[F.coalesce(c, f"__m_{c}").alias(c) for c in cols])
    spread = filled.where(F.col("part") == "train").agg(
        *[F.avg(c).alias(f"__a_{c}") for c in cols], *[F.stddev_samp(c).alias(f"__s_{c}") for c in cols]
    )
    scaled = [F.when(F.col(f"__s_{c}") > 1e-12, (F.col(c) - F.col(f"__a_{c}")) / F.col(f"__s_{c}")).otherwise(0.0) for c in cols]
    return attach(filled, spread).select("machine", "ts", "part", F.array(*scaled).alias("x"))
