"""Anomaly detection: labels, envelopes, deviations, scores, evaluation, score coupling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly, cross, grid, scan, sessions
from ..session import stage
from . import views
from .registry import query, rnd, rnd_even, shared

FEATS = grid.FEATURES
COLS = ", ".join(FEATS)


def _melt(src: str, keep: str) -> str:
    """One row per feature value, NULL values kept."""
    return " UNION ALL ".join(f"SELECT {keep}, '{c}' AS feature, {c} AS value FROM {src}" for c in FEATS)


@query("anomaly_labels", """
SELECT machine, start_ts AS started_on, end_ts AS ended_on, source, label_text, dur_h FROM o_labels""", "dur_h")
def _(p):
    return views.labels(p)


@query("offline_windows", """
SELECT machine, start_ts AS started_on, end_ts AS ended_on, source, instance_id FROM o_offw""")
def _(p):
    return views.offline_windows(p)


# ------------------------------------------------------------ envelopes and deviations

shared("o_clean", """
SELECT g.* FROM o_grid g WHERE NOT is_idle AND NOT is_offline AND NOT EXISTS (SELECT 1 FROM o_labels l WHERE l.machine=g.machine
  AND g.ts BETWEEN l.start_ts AND coalesce(l.end_ts, l.start_ts))""")
shared("o_long", f"SELECT machine, feature, value FROM (UNPIVOT (SELECT machine, {COLS} FROM o_clean) ON {COLS} INTO NAME feature VALUE value)")
shared("o_med", """
SELECT machine, feature, quantile_cont(value, 0.5::DOUBLE) AS median, quantile_cont(value, 0.05::DOUBLE) AS q05, quantile_cont(value, 0.95::DOUBLE) AS q95,
  count(*) AS n_fit, stddev_samp(value) AS sd FROM o_long GROUP BY 1,2 HAVING count(*) >= 20""")
shared("o_env", """
SELECT m.machine, m.feature, m.median, CASE WHEN d.mad*1.4826 > 1e-9 THEN d.mad*1.4826::DOUBLE WHEN m.sd <> 0 THEN m.sd ELSE 1 END AS sigma, m.q05, m.q95, m.n_fit
FROM o_med m JOIN (SELECT l.machine, l.feature, quantile_cont(abs(l.value - k.median), 0.5::DOUBLE) AS mad FROM o_long l JOIN o_med k USING (machine, feature) GROUP BY 1,2) d
  USING (machine, feature)""")


@query("fit_envelope", "SELECT * FROM o_env", "median sigma q05 q95")
def _(p):
    return anomaly.fit_envelopes(views.labelled_grid(p), FEATS, "in_label")


shared("o_gridrn", "SELECT *, row_number() OVER (PARTITION BY machine ORDER BY ts) AS rn FROM o_grid")
shared("o_devrows", f"""
SELECT x.machine, x.ts, x.rn, x.feature, x.value, e.median, e.sigma,
  sum(x.value*pow(0.95::DOUBLE, -x.rn)) OVER w / sum(CASE WHEN x.value IS NOT NULL THEN pow(0.95::DOUBLE, -x.rn) END) OVER w AS ew
FROM ({_melt('o_gridrn', 'machine, ts, rn')}) x JOIN o_env e ON e.machine=x.machine AND e.feature=x.feature
WINDOW w AS (PARTITION BY x.machine, x.feature ORDER BY x.rn)""")
shared("o_dev", """
SELECT machine, ts, feature, value, (value - median)/sigma AS robust_z, (ew - median)/sigma AS ewma_z,
  CASE WHEN value IS NOT NULL THEN greatest(abs((value - median)/sigma), abs((ew - median)/sigma)) END AS dev_score FROM o_devrows""")


@query("deviation_score", "SELECT * FROM o_dev", "value robust_z ewma_z dev_score")
def _(p):
    return anomaly.deviations(views.feature_grid(p), views.envelopes(p), FEATS)


@query("ewma", """
SELECT machine, ts, sum(risk*pow(0.95::DOUBLE, -rn)) OVER w / sum(CASE WHEN risk IS NOT NULL THEN pow(0.95::DOUBLE, -rn) END) OVER w AS ewma, event_id FROM (
  SELECT machine, ts, event_id, CASE WHEN event_id % 7 > 0 THEN risk END AS risk, row_number() OVER (PARTITION BY machine ORDER BY ts, event_id) AS rn FROM fx_scored)
WINDOW w AS (PARTITION BY machine ORDER BY rn)""", "ewma")
def _(p):
    gaps = p.scored.withColumn("x", F.when(F.col("event_id") % 7 > 0, F.col("risk")))
    rows = scan.row_index(gaps, ["machine"], "ts", ties=("event_id",))
    return scan.ewma(rows, ["machine"], "rn", "x", 0.05).select("machine", "ts", "event_id", "ewma")


shared("o_raw", "SELECT machine, ts, quantile_cont(dev_score, 0.95::DOUBLE) AS score_raw FROM o_dev GROUP BY 1,2")
shared("o_score", f"""
SELECT machine, ts, score_raw, CASE WHEN score_raw IS NOT NULL THEN {rnd('pct*100', 2)} END AS score FROM (
  SELECT *, (rank() OVER (PARTITION BY machine, score_raw IS NULL ORDER BY score_raw) + (count(*) OVER (PARTITION BY machine, score_raw) - 1)/2.0::DOUBLE)
    / count(score_raw) OVER (PARTITION BY machine) AS pct FROM o_raw)""")
shared("o_top", f"""
SELECT machine, ts, feature AS role, {rnd('dev_score', 3)} AS dev_score, CASE WHEN robust_z >= 0 THEN 'up' ELSE 'down' END AS direction,
  row_number() OVER (PARTITION BY machine, ts ORDER BY dev_score DESC, feature DESC) AS pos FROM o_dev WHERE dev_score IS NOT NULL QUALIFY pos <= 3""")


@query("machine_score", """
SELECT s.machine, s.ts, s.score_raw, s.score AS score_baseline, coalesce(t.roles, '') AS top_roles FROM o_score s LEFT JOIN (
  SELECT machine, ts, string_agg(role || ':' || direction, ',' ORDER BY pos) AS roles FROM o_top GROUP BY 1,2) t USING (machine, ts)""", "score_raw score_baseline")
def _(p):
    s = anomaly.machine_scores(views.deviations(p))
    text = F.transform("top_roles", lambda x: F.concat_ws(":", x["role"], x["direction"]))
    return s.withColumn("top_roles", F.array_join(text, ","))


# ------------------------------------------------------------ sliding windows and reconstruction

shared("o_zstat", f"""
SELECT o.machine, o.feature, coalesce(e.median, o.m) AS c, coalesce(e.sigma, CASE WHEN o.sd <> 0 THEN o.sd ELSE 1 END) AS s FROM (
  SELECT machine, feature, quantile_cont(value, 0.5::DOUBLE) AS m, stddev_pop(value) AS sd FROM (UNPIVOT (SELECT machine, {COLS} FROM o_grid) ON {COLS} INTO NAME feature VALUE value) GROUP BY 1,2) o
LEFT JOIN o_env e USING (machine, feature)""")
shared("o_zrow", f"""
SELECT x.machine, x.ts, sum(coalesce(greatest(least((x.value - k.c)/k.s, 10), -10), 0)) AS zsum FROM (
  {_melt('o_grid', 'machine, ts')}) x LEFT JOIN o_zstat k ON k.machine=x.machine AND k.feature=x.feature GROUP BY 1,2""")
shared("o_w30", """
SELECT machine, ts, total, n_rows, is_normal FROM (
  SELECT z.machine, z.ts, sum(z.zsum) OVER w AS total, count(*) OVER w AS n_rows, NOT bool_or(b.bad) OVER w AS is_normal, row_number() OVER (PARTITION BY z.machine ORDER BY z.ts) AS rn
  FROM o_zrow z JOIN (SELECT g.machine, g.ts, g.is_offline OR EXISTS (SELECT 1 FROM o_labels l WHERE l.machine=g.machine AND g.ts BETWEEN l.start_ts AND coalesce(l.end_ts, l.start_ts)) AS bad FROM o_grid g) b
    ON b.machine=z.machine AND b.ts=z.ts WINDOW w AS (PARTITION BY z.machine ORDER BY z.ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
WHERE rn >= 30 AND (rn - 30) % 5 = 0""")


def _totals(w):
    add = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    return w.select("machine", "ts", add.alias("total"), F.size("x").alias("n"), "is_normal")


@query("sliding_windows", f"SELECT machine, ts, total, CAST(n_rows * {len(FEATS)} AS INTEGER) AS n, is_normal FROM o_w30", "total")
def _(p):
    return _totals(views.windows30(p))


@query("recon_score")
def _(p):
    z = anomaly.zscores(views.feature_grid(p), views.envelopes(p), FEATS)
    w = stage(anomaly.sliding_windows(z, length=6, stride=2), "windows")
    return anomaly.recon_scores(w, FEATS, length=6).select("machine", "ts", "recon_err", F.to_json("per_feature_err").alias("per_feature_err"))


@query("grid_score_join", """
SELECT g.machine, g.ts, g.is_idle, g.is_offline, s.score AS score_baseline, a.pct*100 AS score_ae, greatest(s.score, a.pct*100) AS score, false AS transferred FROM o_grid g
LEFT JOIN o_score s ON s.machine=g.machine AND s.ts=g.ts LEFT JOIN (
  SELECT machine, ts, (rank() OVER (PARTITION BY machine ORDER BY e) + (count(*) OVER (PARTITION BY machine, e) - 1)/2.0::DOUBLE)/count(*) OVER (PARTITION BY machine) AS pct
  FROM (SELECT machine, ts, round(abs(total), 3) AS e FROM o_w30)) a ON a.machine=g.machine AND a.ts=g.ts""", "score_baseline score_ae score")
def _(p):
    recon = _totals(views.windows30(p)).select(
        "machine", "ts", F.round(F.abs("total"), 3).alias("recon_err"), F.lit(None).cast("map<string,double>").alias("per_feature_err")
    )
    return anomaly.fuse(views.feature_grid(p), views.machine_scores(p), recon).drop("top_roles", "per_feature_err")


# ------------------------------------------------------------ evaluation

shared("o_live_score", """
SELECT s.machine, s.ts, s.score FROM o_score s WHERE NOT EXISTS (SELECT 1 FROM o_offw o WHERE (o.machine=s.machine OR o.machine IS NULL)
  AND s.ts BETWEEN o.start_ts AND coalesce(o.end_ts, o.start_ts))""")


def _lead(src: str) -> str:
    return f"""SELECT l.machine, l.start_ts AS started_on, l.source, l.label_text, epoch_us(l.start_ts - (SELECT min(s.ts) FROM {src} s WHERE s.machine=l.machine AND s.score >= 90
    AND s.ts BETWEEN l.start_ts - INTERVAL 6 HOUR AND l.start_ts))/60000000.0::DOUBLE AS lead_time_min FROM o_labels l"""


@query("lead_time", _lead("o_score"), "lead_time_min")
def _(p):
    return anomaly.lead_time(views.scores(p), views.labels(p), 90.0).select("machine", "started_on", "source", "label_text", "lead_time_min")


LEVELS = ", ".join(f"({50 + i * 49 / 9!r}::DOUBLE)" for i in range(10))


@query("event_pr", f"""
SELECT {rnd('th.x', 1)} AS thresh, b.tp::DOUBLE/nullif(b.flags,0) AS precision, e.m::DOUBLE/nullif(e.n,0) AS recall, b.flags FROM (VALUES {LEVELS}) th(x),
LATERAL (SELECT count(*) AS flags, count(*) FILTER (EXISTS (SELECT 1 FROM o_labels l WHERE l.machine=s.machine AND l.start_ts BETWEEN s.ts AND s.ts + INTERVAL 30 MINUTE)) AS tp
  FROM o_score s WHERE s.score >= th.x AND s.machine IN (SELECT machine FROM o_labels)) b,
LATERAL (SELECT count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM o_score s WHERE s.machine=l.machine AND s.score >= th.x AND s.ts BETWEEN l.start_ts - INTERVAL 30 MINUTE AND l.start_ts)) AS m
  FROM o_labels l) e""", "thresh precision recall")
def _(p):
    return anomaly.event_pr(views.scores(p), views.labels(p))


@query("ad_summary", f"""
SELECT machine, count(*) AS n_events, {rnd('quantile_cont(lead_time_min, 0.5::DOUBLE)', 1)} AS median_lead_min,
  {rnd('avg(CASE WHEN lead_time_min IS NOT NULL THEN 100.0::DOUBLE ELSE 0 END)', 1)} AS pct_with_warning FROM ({_lead('o_live_score')}) GROUP BY 1""", "median_lead_min pct_with_warning")
def _(p):
    return anomaly.summary(views.scores(p), views.labels(p), views.offline_windows(p))


@query("ad_windows", f"""
SELECT w.machine, w.a AS window_start, w.b AS window_end, w.peak AS peak_score, w.n AS n_buckets, l.label_text AS nearest_label,
  {rnd_even('epoch_us(l.start_ts - w.a)/60000000.0::DOUBLE', 1)} AS lead_time_min FROM (
  SELECT machine, min(ts) AS a, max(ts) AS b, max(score) AS peak, count(*) AS n FROM (
    SELECT machine, ts, score, sum(CASE WHEN prev IS NULL OR epoch_us(ts - prev) > 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY machine ORDER BY ts) AS s FROM (
      SELECT machine, ts, score, lag(ts) OVER (PARTITION BY machine ORDER BY ts) AS prev FROM o_score JOIN o_grid USING (machine, ts) WHERE score >= 90 AND NOT is_offline)) GROUP BY machine, s) w
LEFT JOIN LATERAL (SELECT start_ts, label_text FROM o_labels l WHERE l.machine=w.machine AND l.start_ts >= w.b AND l.start_ts <= w.b + INTERVAL 6 HOUR ORDER BY start_ts, label_text LIMIT 1) l ON true""",
    "peak_score lead_time_min")
def _(p):
    w = sessions.extract_windows(views.scores(p), thresh=90.0, merge_gap_min=120)
    return sessions.link_labels(w, views.labels(p)).drop("top_roles", "detector")


@query("deviation_signature", f"""
SELECT id, role, dev, direction, CAST(row_number() OVER (PARTITION BY id ORDER BY dev DESC, role) AS INTEGER) AS position FROM (
  SELECT w.id, t.role, {rnd('avg(t.dev_score)', 2)} AS dev, CASE WHEN count(*) FILTER (direction='up')*2 >= count(*) THEN 'up' ELSE 'down' END AS direction
  FROM fx_stops w JOIN o_top t ON t.machine=w.machine AND t.ts BETWEEN w.started_on - INTERVAL 30 MINUTE AND w.started_on + INTERVAL 10 MINUTE
  WHERE w.display_text IN ('Undefined Stoppage', 'Not running') GROUP BY 1,2) WHERE dev > 0.05 QUALIFY position <= 5""", "dev")
def _(p):
    at = p.stops.where("display_text IN ('Undefined Stoppage', 'Not running')").select("id", "machine", F.col("started_on").alias("at"))
    return anomaly.signature(views.scores(p), at, "id")


# ------------------------------------------------------------ score coupling

_MODE = {"all": "true", "live": "NOT g.is_offline", "running": "NOT g.is_offline AND NOT g.is_idle"}
for _m, _cond in _MODE.items():
    shared(f"o_hs_{_m}", f"""
SELECT s.machine, date_trunc('hour', s.ts) AS h, avg(s.score) AS score FROM o_score s JOIN o_grid g ON g.machine=s.machine AND g.ts=s.ts
WHERE s.score IS NOT NULL AND {_cond} GROUP BY 1,2""")
    shared(f"o_hd_{_m}", f"""
SELECT a.machine, a.i AS h, a.score - b.score AS score FROM (SELECT *, dense_rank() OVER (ORDER BY h) AS i FROM o_hs_{_m}) a
JOIN (SELECT *, dense_rank() OVER (ORDER BY h) AS i FROM o_hs_{_m}) b ON b.machine=a.machine AND b.i = a.i - 1""")


def _pairs(src: str, mode: str, kind: str, n: int) -> str:
    return f"""SELECT '{mode}' AS mode, '{kind}' AS kind, x.machine AS a, y.machine AS b, count(*) AS n, corr(x.score, y.score) AS r FROM {src} x JOIN {src} y
    ON x.h=y.h AND x.machine < y.machine GROUP BY x.machine, y.machine HAVING count(*) >= {n} AND stddev_pop(x.score) > 1e-9 AND stddev_pop(y.score) > 1e-9"""


OVERLAP = 20
shared("o_pairs", " UNION ALL ".join(_pairs(f"o_{k}_{m}", m, kind, OVERLAP) for m in _MODE for k, kind in (("hs", "level"), ("hd", "diff"))))


@query("hourly_score_pivot", "SELECT machine, h, score FROM o_hs_running", "score")
def _(p):
    return cross.hourly_scores(views.scores(p)).select("machine", F.timestamp_micros("h").alias("h"), "score")


@query("coupling", "SELECT * FROM o_pairs", "r")
def _(p):
    return _pair_frame(p)


def _pair_frame(p):
    return p.memo("pairs", lambda: stage(cross.coupling(views.scores(p), min_overlap=OVERLAP), "pairs"))


@query("coupling_summary", """
SELECT mode, kind, count(*) AS pairs, max(r) AS max_r, quantile_cont(r, 0.5::DOUBLE) AS median_r, quantile_cont(r, 0.9::DOUBLE) AS p90_r,
  max(pair) FILTER (pos=1) AS first_pair, max(pair) FILTER (pos=2) AS second_pair FROM (
  SELECT *, a || '~' || b AS pair, row_number() OVER (PARTITION BY mode, kind ORDER BY r DESC, a, b) AS pos FROM o_pairs) GROUP BY 1,2""", "max_r median_r p90_r")
def _(p):
    return cross.coupling_summary(_pair_frame(p))


@query("coupling_clusters", """
WITH RECURSIVE e AS (SELECT a AS src, b AS dst FROM o_pairs WHERE mode='all' AND kind='level' AND r >= 0.1 UNION SELECT b, a FROM o_pairs WHERE mode='all' AND kind='level' AND r >= 0.1),
reach AS (SELECT src, src AS dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src=r.dst)
SELECT src AS machine, min(dst) AS cluster FROM reach GROUP BY src""")
def _(p):
    pairs = cross.coupling_pairs(cross.by_hour_index(cross.hourly_scores(views.scores(p), "all")), OVERLAP)
    return cross.clusters(pairs, 0.1)


@query("coupling_survival", """
SELECT mode, count(*) AS pairs, quantile_cont(r, 0.5::DOUBLE) AS median_r, quantile_cont(r, 0.9::DOUBLE) AS p90_r, max(r) AS max_r FROM o_pairs
WHERE kind='level' AND mode IN ('all','live') GROUP BY 1""", "median_r p90_r max_r")
def _(p):
    return cross.coupling_survival(views.scores(p), OVERLAP)
