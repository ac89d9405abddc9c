"""Ranking metrics, normalisation and stop-prediction models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid, metrics, models, predict
from . import views
from .group_time import AUG, REC_OUT, ROLL, ROLL_OUT
from .registry import query, shared

FEATURES = [*ROLL, *ROLL_OUT, *REC_OUT, "downtime_min_4h", "is_idle_now", "hour"]
DEVICE = [*ROLL, *ROLL_OUT]
EACH = ["machine"]

# ------------------------------------------------------------ metrics on the scored table
shared("o_fold", "SELECT machine, risk, sum(y) AS p, count(*) AS n FROM fx_scored GROUP BY 1,2")
shared("o_pr", """
SELECT machine, risk AS score, CAST(sum(p) OVER d AS BIGINT) AS tp, CAST(sum(n) OVER d AS BIGINT) AS flagged, p, CAST(sum(p) OVER (PARTITION BY machine) AS BIGINT) AS pos,
  CAST(sum(n) OVER (PARTITION BY machine) AS BIGINT) AS tot FROM o_fold WINDOW d AS (PARTITION BY machine ORDER BY risk DESC)""")


@query("pr_curve", """
SELECT machine, score, tp, flagged, tp::DOUBLE/flagged AS precision, tp::DOUBLE/nullif(pos,0) AS recall FROM o_pr""", "score precision recall")
def _(p):
    return metrics.pr_points(p.scored, EACH).select("machine", "score", "tp", "flagged", "precision", "recall")


@query("average_precision", """
SELECT machine, CASE WHEN max(pos) > 0 THEN sum(p::DOUBLE/nullif(pos,0) * tp/flagged) END AS pr_auc FROM o_pr GROUP BY 1""", "pr_auc")
def _(p):
    return metrics.average_precision(metrics.pr_points(p.scored, EACH), EACH)


shared("o_auc", """
SELECT machine, CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(r) FILTER (y=1) - sum(y)*(sum(y)+1)/2.0::DOUBLE)/(sum(y)*(count(*)-sum(y))) END AS roc_auc FROM (
  SELECT machine, y, rank() OVER (PARTITION BY machine ORDER BY risk) + (count(*) OVER (PARTITION BY machine, risk) - 1)/2.0::DOUBLE AS r FROM fx_scored) GROUP BY 1""")


@query("roc_auc", "SELECT * FROM o_auc", "roc_auc")
def _(p):
    return metrics.roc_auc(p.scored, EACH)


shared("o_f1", """
SELECT machine, best_f1, best_score, coalesce((SELECT max(score) FROM o_pr q WHERE q.machine=b.machine AND q.score < b.best_score), best_score) AS threshold FROM (
  SELECT machine, max(f1) AS best_f1, arg_max(score, (f1, -score)) AS best_score FROM (
    SELECT machine, score, round(2.0::DOUBLE*tp/(flagged+pos), 12) AS f1 FROM o_pr) GROUP BY 1) b""")


@query("f1_threshold", "SELECT * FROM o_f1", "best_f1 best_score threshold")
def _(p):
    return metrics.f1_thresholds(metrics.pr_points(p.scored, EACH), EACH)


def _confusion_sql(threshold: str, src: str, by: str) -> str:
    return f"""SELECT {by}, {threshold} AS threshold, count(*) FILTER (NOT hit AND y=0) AS tn, count(*) FILTER (hit AND y=0) AS fp, count(*) FILTER (NOT hit AND y=1) AS fn,
  count(*) FILTER (hit AND y=1) AS tp, avg(y)::DOUBLE AS base_rate, coalesce(count(*) FILTER (hit AND y=1)::DOUBLE/nullif(count(*) FILTER (hit),0),0) AS precision,
  coalesce(count(*) FILTER (hit AND y=1)::DOUBLE/nullif(count(*) FILTER (y=1),0),0) AS recall,
  coalesce(2.0::DOUBLE*count(*) FILTER (hit AND y=1)/nullif(2*count(*) FILTER (hit AND y=1) + count(*) FILTER (hit AND y=0) + count(*) FILTER (NOT hit AND y=1),0),0) AS f1
FROM {src} GROUP BY ALL"""


@query("confusion_metrics", f"""
SELECT c.*, a.pr_auc, o.roc_auc, CASE WHEN c.base_rate > 0 THEN a.pr_auc/c.base_rate END AS lift FROM (
  {_confusion_sql('threshold', '(SELECT s.*, f.threshold, s.risk >= f.threshold AS hit FROM fx_scored s JOIN o_f1 f USING (machine))', 'machine')}) c
JOIN (SELECT machine, CASE WHEN max(pos) > 0 THEN sum(p::DOUBLE/nullif(pos,0) * tp/flagged) END AS pr_auc FROM o_pr GROUP BY 1) a USING (machine) JOIN o_auc o USING (machine)""",
    "threshold base_rate precision recall f1 pr_auc roc_auc lift")
def _(p):
    return metrics.report(p.scored, EACH)


@query("baseline_constant", f"""
SELECT c.*, base_rate AS pr_auc, CASE WHEN base_rate > 0 AND base_rate < 1 THEN 0.5::DOUBLE END AS roc_auc, CASE WHEN base_rate > 0 THEN 1.0::DOUBLE END AS lift FROM (
  {_confusion_sql('0.5::DOUBLE', '(SELECT *, true AS hit FROM fx_scored)', 'machine')}) c""", "threshold base_rate precision recall f1 pr_auc roc_auc lift")
def _(p):
    return metrics.report(p.scored.withColumn("risk", F.lit(1.0)), EACH, fixed=0.5)


# ------------------------------------------------------------ supervised split

shared("o_supsplit", """
SELECT *, CASE WHEN row_number() OVER (PARTITION BY machine ORDER BY ts) <= floor(count(*) OVER (PARTITION BY machine) * 0.6::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM o_sup""")


@query("baseline_recent_stop", """
SELECT machine, ts, y, coalesce(anystop_cnt_1h/(SELECT CASE WHEN max(anystop_cnt_1h) > 0 THEN max(anystop_cnt_1h) ELSE 1 END FROM o_supsplit WHERE part='test'), 0) AS risk
FROM o_supsplit WHERE part='test'""", "risk")
def _(p):
    test = views.split_supervised(p).where("part = 'test'")
    return models.recent_stop_scores(test, keep=("machine", "ts", "y"))


@query("usable_columns", " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n FROM o_supsplit WHERE part='train'" for c in DEVICE))
def _(p):
    return grid.column_counts(views.split_supervised(p).where("part = 'train'"), DEVICE)


def _norm_sql(centre: str, scale: str) -> str:
    stats = ", ".join(f"{centre.format(c=c)} AS m_{c}, {scale.format(c=c)} AS s_{c}" for c in DEVICE)
    cols = ", ".join(f"CASE WHEN k.m_{c} IS NOT NULL THEN (r.{c} - k.m_{c})/CASE WHEN k.s_{c} = 0 THEN 1 ELSE k.s_{c} END ELSE r.{c} END AS {c}" for c in DEVICE)
    return f"SELECT r.machine, r.ts, r.part, {cols} FROM o_supsplit r LEFT JOIN (SELECT machine, {stats} FROM o_supsplit WHERE part='train' GROUP BY 1) k USING (machine)"


@query("robust_znorm", _norm_sql("quantile_cont({c}, 0.5::DOUBLE)", "quantile_cont({c}, 0.75::DOUBLE) - quantile_cont({c}, 0.25::DOUBLE)"), " ".join(DEVICE))
def _(p):
    return predict.robust_znorm(views.split_supervised(p), DEVICE).select("machine", "ts", "part", *DEVICE)


@query("znorm_meanstd", _norm_sql("avg({c})", "CASE WHEN stddev_pop({c}) < 1e-12 THEN 0 ELSE stddev_pop({c}) END"), " ".join(DEVICE))
def _(p):
    return predict.znorm_meanstd(views.split_supervised(p), DEVICE).select("machine", "ts", "part", *DEVICE)


@query("ad_comparator_join", """
SELECT s.machine, s.ts, s.y, coalesce(a.score, (SELECT quantile_cont(x.score, 0.5::DOUBLE) FROM o_supsplit t JOIN o_score x ON x.machine=t.machine AND x.ts=t.ts WHERE t.part='test'))/100 AS risk
FROM o_supsplit s LEFT JOIN o_score a ON a.machine=s.machine AND a.ts=s.ts WHERE s.part='test'""", "risk")
def _(p):
    return predict.comparator_scores(views.split_supervised(p), views.scores(p)).select("machine", "ts", "y", "risk")


# ------------------------------------------------------------ preprocessing

_IN = [f"CAST({c} AS DOUBLE)" for c in FEATURES]
shared("o_imp_k", f"SELECT {', '.join(f'quantile_cont({x}, 0.5::DOUBLE) AS k{i}' for i, x in enumerate(_IN))} FROM o_supsplit WHERE part='train'")
shared("o_imp_f", f"SELECT machine, ts, part, {', '.join(f'coalesce({x}, k{i}) AS f{i}' for i, x in enumerate(_IN))} FROM o_supsplit, o_imp_k")
shared("o_imp_s", f"SELECT {', '.join(f'avg(f{i}) AS a{i}, stddev_samp(f{i}) AS s{i}' for i in range(len(_IN)))} FROM o_imp_f WHERE part='train'")


@query("median_impute_scale", f"""
SELECT machine, ts, part, CAST({' + '.join(f'CASE WHEN k{i} IS NULL THEN 0 ELSE 1 END' for i in range(len(_IN)))} AS INTEGER) AS inputs,
  {' + '.join(f'CASE WHEN s{i} > 1e-12 THEN (f{i} - a{i})/s{i} ELSE 0 END' for i in range(len(_IN)))} AS total FROM o_imp_f, o_imp_k, o_imp_s""", "total")
def _(p):
    x = models.imputed_scaled(views.split_supervised(p), FEATURES)
    return x.select("machine", "ts", "part", F.size("x").alias("inputs"), F.aggregate("x", F.lit(0.0), lambda s, v: s + v).alias("total"))


# ------------------------------------------------------------ learned models: scores have no oracle, the scored rows have


def _scored_rows(key: str) -> None:
    """Which rows a model scores, with which label, and that every risk is a probability."""

    @query(f"{key}_rows", "SELECT machine, ts, CAST(y AS INTEGER) AS y, true AS in_range FROM o_supsplit WHERE part='test'")
    def _(p):
        risk = F.col("risk")
        return _SCORES[key](p).select("machine", "ts", F.col("y").cast("int").alias("y"), (risk.isNotNull() & risk.between(0, 1)).alias("in_range"))


_SCORES = {}


def _model(key: str, name: str, **kw) -> None:
    def build(p):
        return p.memo(key, lambda: models.train_and_score(views.split_supervised(p), FEATURES, name, **kw))

    _SCORES[key] = build
    query(key)(build)
    _scored_rows(key)


_model("model_logreg", "logreg")
_model("model_rf", "random_forest")
_model("model_gbt", "gbt", rounds=10)
_model("model_mlp", "mlp")


@query("model_benchmark")
def _(p):
    return models.benchmark(views.split_supervised(p), FEATURES, rounds=10, trees=40)


@query("feature_importance")
def _(p):
    return models.importance(views.split_supervised(p), FEATURES, trees=40)


HALVES = {"cell": [f"M{i:02d}" for i in range(0, 10, 2)], "side": [f"M{i:02d}" for i in range(1, 10, 2)]}


@query("regime_experiment")
def _(p):
    return models.regime_experiment(views.split_supervised(p), FEATURES, DEVICE, HALVES, rounds=4, trees=10)


@query("tuning_search")
def _(p):
    # few short trials: one fit of the full space takes minutes here; the operator's defaults are 40 draws and 350 rounds
    space = models.SPACE | {"maxIter": (4, 6, 8), "maxDepth": (3, 4, 5)}
    return models.tuning_search(predict.augment(views.split_supervised(p)), FEATURES, AUG, trials=3, rounds=5, space=space)


@query("ablation")
def _(p):
    recency = [c for c in FEATURES if c not in DEVICE]
    return models.ablation(views.split_supervised(p), {"recency": recency, "telemetry": DEVICE, "all": FEATURES})


# the given tables have 51 to 219 training rows a machine; the operator's default of 300 would leave none
OWN_ROWS = 150


@query("per_machine_models")
def _(p):
    return models.per_machine(views.split_supervised(p), FEATURES, min_rows=OWN_ROWS)


@query("per_machine_models_rows", f"""SELECT machine, ts, CAST(y AS INTEGER) AS y, true AS in_range FROM o_supsplit WHERE part='test' AND machine IN (
  SELECT machine FROM o_supsplit GROUP BY 1 HAVING count(*) FILTER (part='train') >= {OWN_ROWS}
  AND count(DISTINCT y) FILTER (part='train') = 2 AND count(DISTINCT y) FILTER (part='test') = 2)""")
def _(p):
    s = models.per_machine_scores(views.split_supervised(p), FEATURES, min_rows=OWN_ROWS)
    return s.select("machine", "ts", F.col("y").cast("int").alias("y"), F.col("risk").between(0, 1).alias("in_range"))


@query("machine_onehot")
def _(p):
    return models.one_hot(views.split_supervised(p), FEATURES, trees=40)


def _risk(p):
    s = predict.augment(views.split_supervised(p))
    z = predict.robust_znorm(s, DEVICE)
    return p.memo("risk_scoring", lambda: models.train_and_score(z, [*FEATURES, *AUG], "gbt", rounds=8))


_SCORES["risk_scoring"] = _risk
query("risk_scoring")(_risk)
_scored_rows("risk_scoring")
