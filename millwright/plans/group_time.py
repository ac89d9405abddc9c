"""As-of and interval joins, the feature grid, row windows, labels, splits, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timex import us
from ..operators import anomaly, events, grid, predict, rca, scan, sessions, value
from ..operators.kpi import top_per_group
from ..operators.scan import in_any_interval
from . import views
from .registry import query, rnd_even, shared

# ------------------------------------------------------------ shared oracle text
shared("o_unpl", """
SELECT machine, start_ts, label, duration_ms, greatest(duration_ms/60000, 0.0::DOUBLE) AS minutes FROM o_stops WHERE category='UNPLANNED_RUNSTOP'""")
shared("o_tel", """
SELECT r.machine, r.canonical_role AS role, t.readingdef_uid AS uid, date_trunc('hour', t.time) AS b, t.time AS t, t.value AS v
FROM fx_telemetry t JOIN o_roles r USING (readingdef_uid)""")
shared("o_spans", """
SELECT machine, role, CASE WHEN role='machine_mode' THEN '' ELSE uid END AS uid, min(b) AS lo, max(b) AS hi FROM o_tel GROUP BY 1,2,3""")
shared("o_cnt", """
SELECT c.machine, c.role, c.b, sum(greatest(c.mx - p.mx, 0)) AS d
FROM (SELECT machine, role, uid, b, max(v) AS mx FROM o_tel WHERE role IN ('run_time','production_count') GROUP BY 1,2,3,4) c
JOIN (SELECT machine, role, uid, b, max(v) AS mx FROM o_tel WHERE role IN ('run_time','production_count') GROUP BY 1,2,3,4) p
  ON p.uid=c.uid AND p.role=c.role AND p.b = c.b - INTERVAL 1 HOUR GROUP BY 1,2,3""")
shared("o_axis", """
SELECT machine, b, sum(mv) AS total, max(mv) AS top FROM (
  SELECT machine, uid, b, max(v)-min(v) AS mv FROM o_tel WHERE role='axis_position' GROUP BY 1,2,3) GROUP BY 1,2""")
shared("o_off_own", """
SELECT i.machine, s.started_on AS lo, coalesce(s.ended_on, s.started_on) AS hi FROM fx_status s JOIN o_inst i USING (instance_id) WHERE NOT s.is_online""")


def _spanned(expr: str, role: str) -> str:
    return (
        f"CASE WHEN EXISTS (SELECT 1 FROM o_spans s WHERE s.machine=g.machine AND s.role='{role}' AND g.b BETWEEN s.lo AND s.hi)"
        f" THEN coalesce({expr}, 0)::DOUBLE END"
    )


shared("o_grid", f"""
SELECT g.machine, g.b AS ts, {_spanned('r.d', 'run_time')} AS run_time_delta, {_spanned('q.d', 'production_count')} AS production_count_delta,
  g.cycle_time_mean, g.cycle_time_std, {_spanned('a.total', 'axis_position')} AS axis_move_total, a.top AS axis_move_max,
  g.run_state_duty, g.machine_mode_last, {_spanned('g.changes', 'machine_mode')} AS machine_mode_changes, g.n_samples,
  coalesce(g.run_state_duty, 0) < 0.05 AS is_idle,
  EXISTS (SELECT 1 FROM o_off_own o WHERE o.machine=g.machine AND g.b BETWEEN o.lo AND o.hi) AS is_offline
FROM (SELECT machine, b, count(*) AS n_samples, avg(v) FILTER (role='cycle_time') AS cycle_time_mean,
    stddev_samp(v) FILTER (role='cycle_time') AS cycle_time_std,
    avg(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (role='run_state') AS run_state_duty,
    arg_max(v, (t, v)) FILTER (role='machine_mode' AND v IS NOT NULL) AS machine_mode_last,
    count(DISTINCT v) FILTER (role='machine_mode') AS changes FROM o_tel GROUP BY 1,2) g
LEFT JOIN o_cnt r ON r.machine=g.machine AND r.b=g.b AND r.role='run_time'
LEFT JOIN o_cnt q ON q.machine=g.machine AND q.b=g.b AND q.role='production_count'
LEFT JOIN o_axis a ON a.machine=g.machine AND a.b=g.b""")

# ------------------------------------------------------------ as-of joins


@query("asof_forward", """
SELECT a.machine, a.start_ts AS alarm_start, a.category AS alarm_category, s.start_ts AS stop_start, s.label AS stop_reason,
  epoch_us(s.start_ts - a.start_ts)/1000000.0::DOUBLE AS lag_seconds, s.start_ts IS NOT NULL AS matched
FROM o_alerts a LEFT JOIN LATERAL (SELECT start_ts, label FROM o_unpl u WHERE u.machine=a.machine AND u.start_ts >= a.start_ts
  AND u.start_ts <= a.start_ts + INTERVAL 10 MINUTE ORDER BY start_ts, label LIMIT 1) s ON true
WHERE a.machine IN (SELECT machine FROM o_unpl)""", "lag_seconds")
def _(p):
    return rca.alarm_to_stop(views.alerts(p), views.stops(p))


@query("asof_backward", """
SELECT g.machine, g.ts, (SELECT max(start_ts) FROM o_unpl u WHERE u.machine=g.machine AND u.start_ts <= g.ts) AS last_start FROM o_grid g""")
def _(p):
    return predict.last_start(views.feature_grid(p).select("machine", "ts"), views.unplanned(p))


@query("alarm_match_rate", """
SELECT count(*) AS alarms, avg(CASE WHEN EXISTS (SELECT 1 FROM o_unpl u WHERE u.machine=a.machine AND u.start_ts >= a.start_ts
  AND u.start_ts <= a.start_ts + INTERVAL 10 MINUTE) THEN 1.0::DOUBLE ELSE 0 END) AS match_rate
FROM o_alerts a WHERE a.machine IN (SELECT machine FROM o_unpl)""", "match_rate")
def _(p):
    m = rca.alarm_to_stop(views.alerts(p), views.stops(p))
    return m.agg(F.count(F.lit(1)).alias("alarms"), F.avg(F.col("matched").cast("double")).alias("match_rate"))


# ------------------------------------------------------------ intervals

shared("o_labels", """
SELECT machine, started_on AS start_ts, ended_on AS end_ts, 'stoppage' AS source, display_text AS label_text,
  duration_milliseconds/3600000 AS dur_h FROM fx_stops WHERE NOT is_planned AND NOT contains(lower(coalesce(display_text,'')), 'system offline')
UNION ALL SELECT machine, start_ts, end_ts, 'alert', label, duration_ms/3600000 FROM o_alerts""")
shared("o_offw", """
SELECT machine, started_on AS start_ts, ended_on AS end_ts, 'stoppage_offline' AS source, CAST(NULL AS VARCHAR) AS instance_id
FROM fx_stops WHERE contains(lower(coalesce(display_text,'')), 'system offline')
UNION ALL SELECT NULL, started_on, ended_on, 'status_offline', instance_id FROM fx_status WHERE NOT is_online""")


@query("interval_flag", """
SELECT g.machine, g.ts, EXISTS (SELECT 1 FROM o_offw o WHERE (o.machine=g.machine OR o.machine IS NULL)
  AND g.ts BETWEEN o.start_ts AND coalesce(o.end_ts, o.start_ts)) AS inside FROM o_grid g""")
def _(p):
    return anomaly.flag_intervals(views.feature_grid(p).select("machine", "ts"), views.offline_windows(p), out="inside")


@query("interval_anti", """
SELECT e.event_id, e.machine, e.ts FROM fx_scored e WHERE NOT EXISTS (SELECT 1 FROM o_offw o WHERE (o.machine=e.machine OR o.machine IS NULL)
  AND e.ts BETWEEN o.start_ts AND coalesce(o.end_ts, o.start_ts))""")
def _(p):
    return anomaly.drop_intervals(p.scored.select("event_id", "machine", "ts"), views.offline_windows(p))


@query("interval_flag_telemetry", """
SELECT t.machine, t.uid, t.t AS time, EXISTS (SELECT 1 FROM o_off_own o WHERE o.machine=t.machine AND t.t BETWEEN o.lo AND o.hi) AS offline FROM o_tel t""")
def _(p):
    r = views.readings(p).select("machine", F.col("readingdef_uid").alias("uid"), "time")
    return in_any_interval(
        r, views.outages(p), ["machine"], us("time"), F.col("lo"), F.col("hi"), out="offline"
    )


# ------------------------------------------------------------ grid


def _g(*cols):
    return f"SELECT machine, ts, {', '.join(cols)} FROM o_grid"


@query("grid_counter_delta", _g("run_time_delta", "production_count_delta"), "run_time_delta production_count_delta")
def _(p):
    return views.feature_grid(p).select("machine", "ts", "run_time_delta", "production_count_delta")


@query("grid_gauge", """
SELECT machine, b AS ts, avg(v) AS cycle_time_mean, stddev_samp(v) AS cycle_time_std FROM o_tel WHERE role='cycle_time' GROUP BY 1,2""",
    "cycle_time_mean cycle_time_std")
def _(p):
    f = grid.bucket_features(views.readings(p).where("role = 'cycle_time'"), views.GRID_S)
    return f.select("machine", F.timestamp_micros("b").alias("ts"), "cycle_time_mean", "cycle_time_std")


@query("grid_axis_movement", _g("axis_move_total", "axis_move_max"), "axis_move_total axis_move_max")
def _(p):
    return views.feature_grid(p).select("machine", "ts", "axis_move_total", "axis_move_max")


@query("grid_duty", """
SELECT machine, b AS ts, avg(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END) AS run_state_duty FROM o_tel WHERE role='run_state' GROUP BY 1,2""",
    "run_state_duty")
def _(p):
    f = grid.bucket_features(views.readings(p).where("role = 'run_state'"), views.GRID_S)
    return f.select("machine", F.timestamp_micros("b").alias("ts"), "run_state_duty")


@query("grid_mode", _g("machine_mode_last", "machine_mode_changes"), "machine_mode_last machine_mode_changes")
def _(p):
    return views.feature_grid(p).select("machine", "ts", "machine_mode_last", "machine_mode_changes")


@query("grid_samples", "SELECT machine, b AS ts, count(*) AS n_samples FROM o_tel GROUP BY 1,2")
def _(p):
    f = grid.bucket_features(views.readings(p), views.GRID_S)
    return f.select("machine", F.timestamp_micros("b").alias("ts"), "n_samples")


@query("feature_grid", "SELECT * FROM o_grid", "run_time_delta production_count_delta cycle_time_mean cycle_time_std "
       "axis_move_total axis_move_max run_state_duty machine_mode_last machine_mode_changes")
def _(p):
    return views.feature_grid(p)


@query("nonnull_feature_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n FROM o_grid" for c in grid.FEATURES))
def _(p):
    return grid.column_counts(views.feature_grid(p), grid.FEATURES)


# ------------------------------------------------------------ supervised rows

shared("o_live", """
SELECT g.* FROM o_grid g WHERE NOT g.is_offline AND NOT coalesce((SELECT u.start_ts + to_microseconds(CAST(floor(u.minutes*60000000) AS BIGINT)) >= g.ts
  FROM o_unpl u WHERE u.machine=g.machine AND u.minutes >= 15 AND u.start_ts <= g.ts ORDER BY u.start_ts DESC, u.minutes DESC LIMIT 1), false)""")

ROLL = ["cycle_time_mean", "run_state_duty"]


def _roll_sql(c: str) -> str:
    return f"""
  CASE WHEN count({c}) OVER s >= 3 THEN avg({c}) OVER s END AS {c}__roll_mean,
  CASE WHEN count({c}) OVER s >= 3 THEN stddev_samp({c}) OVER s END AS {c}__roll_std,
  {c} - lag({c}, 15) OVER w AS {c}__slope, CASE WHEN count({c}) OVER l >= 5 THEN avg({c}) OVER l END AS {c}__long_mean"""


ROLL_WINDOW = """WINDOW w AS (PARTITION BY machine ORDER BY ts),
  s AS (PARTITION BY machine ORDER BY ts ROWS BETWEEN 14 PRECEDING AND CURRENT ROW),
  l AS (PARTITION BY machine ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"""
ROLL_OUT = [f"{c}__{s}" for c in ROLL for s in ("roll_mean", "roll_std", "slope", "long_mean")]


@query("rolling_stats", f"SELECT machine, ts, {','.join(_roll_sql(c) for c in ROLL)} FROM o_live {ROLL_WINDOW}", " ".join(ROLL_OUT))
def _(p):
    f = predict.rolling_stats(views.live_grid(p), ROLL)
    return f.select("machine", "ts", *ROLL_OUT)


def _recency_sql(prefix: str, cond: str) -> str:
    def n(h):
        return f"(SELECT count(*) FROM o_unpl u WHERE u.machine=g.machine AND {cond} AND u.start_ts BETWEEN g.ts - INTERVAL {h} HOUR AND g.ts)::DOUBLE"

    since = f"coalesce(epoch_us(g.ts - (SELECT max(start_ts) FROM o_unpl u WHERE u.machine=g.machine AND {cond} AND u.start_ts <= g.ts))/60000000.0::DOUBLE, 9999)"
    if prefix == "micro":
        since = f"CASE WHEN g.machine NOT IN (SELECT machine FROM o_unpl) THEN 0 ELSE {since} END"
    return f"{since} AS {prefix}_min_since, {n(1)} AS {prefix}_cnt_1h, {n(4)} AS {prefix}_cnt_4h"


RECENCY = ", ".join([_recency_sql("anystop", "true"), _recency_sql("sigstop", "u.minutes >= 15"), _recency_sql("micro", "u.minutes < 5")])
BURDEN = """coalesce((SELECT sum(least(u.minutes, 240)) FROM o_unpl u WHERE u.machine=g.machine AND u.start_ts BETWEEN g.ts - INTERVAL 4 HOUR AND g.ts), 0)::DOUBLE AS downtime_min_4h"""
REC_OUT = [f"{k}_{s}" for k in ("anystop", "sigstop", "micro") for s in ("min_since", "cnt_1h", "cnt_4h")]


@query("stop_recency", f"SELECT g.machine, g.ts, {RECENCY} FROM o_grid g", " ".join(REC_OUT))
def _(p):
    f = predict.stop_recency(views.feature_grid(p).select("machine", "ts"), views.unplanned(p))
    return f.drop("downtime_min_4h")


@query("downtime_burden", f"SELECT g.machine, g.ts, {BURDEN} FROM o_grid g", "downtime_min_4h")
def _(p):
    f = predict.stop_recency(views.feature_grid(p).select("machine", "ts"), views.unplanned(p))
    return f.select("machine", "ts", "downtime_min_4h")


LABEL = """CASE WHEN EXISTS (SELECT 1 FROM o_unpl u WHERE u.machine=g.machine AND u.minutes >= 15 AND u.start_ts > g.ts
  AND u.start_ts <= g.ts + INTERVAL 60 MINUTE) THEN 1 ELSE 0 END AS y"""


@query("stop_label", f"SELECT g.machine, g.ts, {LABEL} FROM o_grid g")
def _(p):
    return predict.future_label(views.feature_grid(p).select("machine", "ts"), views.significant(p))


@query("censor_tail", """
SELECT machine, ts FROM o_grid g WHERE ts <= (SELECT max(ts) FROM o_grid h WHERE h.machine=g.machine) - INTERVAL 60 MINUTE""")
def _(p):
    return predict.censor_tail(views.feature_grid(p).select("machine", "ts"))


@query("active_stop_filter", "SELECT machine, ts, is_idle FROM o_live")
def _(p):
    return views.live_grid(p).select("machine", "ts", "is_idle")


shared("o_sup", f"""
SELECT g.machine, g.ts, g.cycle_time_mean, g.run_state_duty, g.n_samples,
  {', '.join('g.' + c for c in ROLL_OUT)}, {RECENCY}, {BURDEN}, CAST(g.is_idle AS INTEGER) AS is_idle_now,
  hour(g.ts)::DOUBLE AS hour, {LABEL}
FROM (SELECT *, {','.join(_roll_sql(c) for c in ROLL)} FROM o_live
  WHERE machine IN (SELECT machine FROM o_live GROUP BY machine HAVING count(*) >= 65) {ROLL_WINDOW}) g
WHERE g.ts <= (SELECT max(ts) FROM o_live h WHERE h.machine=g.machine) - INTERVAL 60 MINUTE""")


@query("supervised_dataset", "SELECT * FROM o_sup", " ".join(["cycle_time_mean", "run_state_duty", *ROLL_OUT, *REC_OUT, "downtime_min_4h", "hour"]))
def _(p):
    return predict.supervised(views.feature_grid(p), views.unplanned(p), ROLL)


AUG = ["cycle_dev", "runstate_dev", "prod_dev", "cycle_short_long", "stop_pressure", "micro_accel", "hour_sin", "hour_cos"]


@query("feature_augment", """
SELECT machine, ts, cycle_time_mean - cycle_time_mean__long_mean AS cycle_dev, run_state_duty - run_state_duty__long_mean AS runstate_dev,
  0.0::DOUBLE AS prod_dev, cycle_time_mean__roll_mean / nullif(cycle_time_mean__long_mean, 0) AS cycle_short_long,
  sigstop_cnt_4h * ln(1 + downtime_min_4h) AS stop_pressure, micro_cnt_1h - micro_cnt_4h/4 AS micro_accel,
  sin(2*pi()*hour/24) AS hour_sin, cos(2*pi()*hour/24) AS hour_cos FROM o_sup""", " ".join(AUG))
def _(p):
    return predict.augment(views.supervised(p)).select("machine", "ts", *AUG)


shared("o_split", """
SELECT event_id, machine, ts, risk, y, CASE WHEN row_number() OVER (PARTITION BY machine ORDER BY ts, event_id)
  <= floor(count(*) OVER (PARTITION BY machine) * 0.6::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM fx_scored""")


@query("chrono_split", "SELECT event_id, machine, ts, part FROM o_split")
def _(p):
    return views.split_scored(p).select("event_id", "machine", "ts", "part")


@query("leakage_check", """
SELECT count(*) AS machines, count(*) FILTER (test_start <= train_end) AS leaking FROM (
  SELECT machine, max(ts) FILTER (part='train') AS train_end, min(ts) FILTER (part='test') AS test_start FROM o_split GROUP BY 1)""")
def _(p):
    s = views.split_scored(p)
    bad = predict.leakage(s).agg(F.count(F.lit(1)).alias("leaking"))
    n = s.agg(F.count_distinct("machine").alias("machines"))
    return scan.attach(n, bad)


@query("base_rate_drift", "SELECT machine, part, count(*) AS n, avg(y)::DOUBLE AS base_rate FROM o_split GROUP BY 1,2", "base_rate")
def _(p):
    return predict.base_rate_drift(views.split_scored(p))


# ------------------------------------------------------------ scores, sessions, windows

@query("score_rank_pct", """
SELECT event_id, machine, risk, (rank() OVER (PARTITION BY machine ORDER BY risk) + (count(*) OVER (PARTITION BY machine, risk) - 1)/2.0::DOUBLE)
  / count(*) OVER (PARTITION BY machine) * 100 AS score FROM fx_scored""", "risk score")
def _(p):
    r = scan.rank_share(p.scored, ["machine"], "risk")
    return r.select("event_id", "machine", "risk", (F.col("pct") * 100).alias("score"))


shared("o_sess", """
SELECT machine, ts, risk, event_id, sum(CASE WHEN prev IS NULL OR epoch_us(ts - prev) > 3600000000 THEN 1 ELSE 0 END)
  OVER (PARTITION BY machine ORDER BY ts, event_id) AS s FROM (
  SELECT *, lag(ts) OVER (PARTITION BY machine ORDER BY ts, event_id) AS prev FROM fx_scored WHERE risk >= 0.6)""")


@query("sessionize_windows", """
SELECT machine, min(ts) AS window_start, max(ts) AS window_end, max(risk)*100 AS peak_score, count(*) AS n_buckets,
  arg_max(event_id, (risk, event_id)) AS peak_event FROM o_sess GROUP BY machine, s""", "peak_score")
def _(p):
    scores = p.scored.select("machine", "ts", (F.col("risk") * 100).alias("score"), "event_id")
    w = sessions.extract_windows(scores, thresh=60.0, merge_gap_min=60, carry="event_id")
    return w.select("machine", "window_start", "window_end", "peak_score", "n_buckets", F.col("event_id").alias("peak_event"))


shared("o_all_rn", """
SELECT *, row_number() OVER (PARTITION BY machine ORDER BY ts, event_id) AS rn FROM fx_scored""")
shared("o_islands", """
SELECT machine, s, min(rn) AS a, max(rn) AS b FROM (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts - prev) > 1200000000 THEN 1 ELSE 0 END)
  OVER (PARTITION BY machine ORDER BY rn) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY machine ORDER BY rn) AS prev
  FROM o_all_rn WHERE risk >= 0.5)) GROUP BY 1,2""")
shared("o_epis", """
SELECT i.machine, min(r.ts) AS start_ts, max(r.ts) AS end_ts, max(r.risk) AS peak_risk,
  sum(CAST(r.risk AS DECIMAL(18,6)))::DOUBLE/count(*) AS mean_risk, count(*) AS n_buckets, max(r.y) = 1 AS hit
FROM o_islands i JOIN o_all_rn r ON r.machine=i.machine AND r.rn BETWEEN i.a AND i.b GROUP BY i.machine, i.s HAVING count(*) >= 3""")


@query("risk_episodes", 'SELECT machine, start_ts AS "start", end_ts AS "end", peak_risk, mean_risk, n_buckets, hit FROM o_epis', "peak_risk mean_risk")
def _(p):
    return sessions.risk_episodes(p.scored, 0.5, ties=("event_id",)).drop("threshold")


@query("scored_windows", """
SELECT machine, min(ts) AS "start", max(ts) AS score_end, max(ts) + INTERVAL 60 MINUTE AS "end",
  epoch_us(max(ts) + INTERVAL 60 MINUTE - min(ts))/86400000000.0::DOUBLE AS observed_days FROM fx_scored GROUP BY machine""", "observed_days")
def _(p):
    return value.scored_windows(p.scored)


@query("risk_downsample", """
SELECT machine, time_bucket(INTERVAL 3 HOUR, ts) AS ts, max(risk) AS risk FROM fx_scored GROUP BY 1,2""", "risk")
def _(p):
    return sessions.downsample_max(p.scored, "risk", 3 * 3600)


@query("topk_per_group", """
SELECT machine, event_id, risk, row_number() OVER (PARTITION BY machine ORDER BY risk DESC, event_id) AS position FROM fx_scored
QUALIFY position <= 8""", "risk")
def _(p):
    t = top_per_group(p.scored, ["machine"], [F.col("risk").desc(), F.col("event_id")], 8)
    return t.select("machine", "event_id", "risk", F.col("position").cast("bigint").alias("position"))


@query("systematic_sample", """
SELECT machine, role, t AS time, v AS value FROM (SELECT machine, role, t, v, uid,
  row_number() OVER (PARTITION BY machine, role ORDER BY t, uid, v) AS rn, count(*) OVER (PARTITION BY machine, role) AS n FROM o_tel WHERE v IS NOT NULL)
WHERE (rn - 1) % greatest(1, n // 300) = 0""", "value")
def _(p):
    r = views.readings(p).where(F.col("value").isNotNull())
    return sessions.systematic_sample(r, ["machine", "role"], "time", ("readingdef_uid", "value"), 300).select(
        "machine", "role", "time", "value"
    )


@query("score_coverage", """
SELECT machine, count(*) AS buckets, avg(CASE WHEN risk >= 0.9 THEN 100.0::DOUBLE ELSE 0 END) AS flagged_pct FROM fx_scored GROUP BY 1""", "flagged_pct")
def _(p):
    return sessions.score_coverage(p.scored, "risk", 0.9)


# ------------------------------------------------------------ windows x events

shared("o_ow", """
SELECT id, machine, started_on - INTERVAL 15 MINUTE AS w0, coalesce(ended_on, started_on) + INTERVAL 5 MINUTE AS w1 FROM fx_stops
WHERE display_text='Undefined Stoppage'""")
shared("o_oe", """
SELECT *, end_ts IS NULL OR end_ts >= (SELECT max(w0) FROM o_ow) AS is_open FROM (
  SELECT machine, source, category, label, start_ts, end_ts FROM o_stops UNION ALL SELECT machine, source, category, label, start_ts, end_ts FROM o_alerts
  UNION ALL SELECT machine, source, category, label, start_ts, end_ts FROM o_offline)""")


@query("interval_overlap", """
SELECT w.machine, w.id, e.source, e.category, e.label, e.start_ts AS start, e.end_ts AS "end", CAST(1 AS BIGINT) AS n_events FROM o_ow w JOIN o_oe e
  ON e.machine=w.machine AND e.start_ts <= w.w1 AND (e.start_ts >= w.w0 OR NOT e.is_open AND e.end_ts >= w.w0)
UNION ALL
SELECT w.machine, w.id, e.source, e.category, NULL, NULL, NULL, count(*) FROM o_ow w JOIN o_oe e ON e.machine=w.machine AND e.start_ts < w.w0 AND e.is_open
GROUP BY w.machine, w.id, e.source, e.category""")
def _(p):
    """One row per paired event; one per window, source and category for the open events from before it."""
    w = p.stops.where("display_text = 'Undefined Stoppage'").select(
        "id", "machine", F.col("started_on").alias("w_start"), F.coalesce("ended_on", "started_on").alias("w_end")
    )
    s = events.event_stream(views.alerts(p), views.stops(p), views.offline(p)).drop("unit_uid", "meta")
    hit = events.overlapping(w, s, "id").select("machine", "id", "source", "category", "label", "start", "end", F.lit(1).cast("bigint").alias("n_events"))
    old = events.open_before(w, s, "id").withColumnRenamed("n_open", "n_events")
    return hit.unionByName(old, allowMissingColumns=True)


@query("range_future_first", """
SELECT w.id, w.machine, l.label_text AS nearest_label, """ + rnd_even("epoch_us(l.start_ts - w.ws)/60000000.0::DOUBLE", 1) + """ AS lead_time_min FROM (
  SELECT id, machine, started_on AS ws, coalesce(ended_on, started_on) AS we FROM fx_stops WHERE display_text='Waiting for work') w
LEFT JOIN LATERAL (SELECT start_ts, label_text FROM o_labels l WHERE l.machine=w.machine AND l.start_ts >= w.we
  AND l.start_ts <= w.we + INTERVAL 6 HOUR ORDER BY start_ts, label_text LIMIT 1) l ON true""", "lead_time_min")
def _(p):
    w = p.stops.where("display_text = 'Waiting for work'").select(
        "id", "machine", F.col("started_on").alias("window_start"), F.coalesce("ended_on", "started_on").alias("window_end")
    )
    return sessions.link_labels(w, views.labels(p)).select("id", "machine", "nearest_label", "lead_time_min")


@query("stop_scope", """
SELECT s.machine, s.start_ts AS start, s.duration_ms FROM (SELECT machine, start_ts, max(least(greatest(duration_ms,0),86400000)) AS duration_ms
  FROM o_unpl WHERE minutes >= 15 GROUP BY 1,2) s JOIN (SELECT machine, min(ts) AS a, max(ts) + INTERVAL 60 MINUTE AS b FROM fx_scored GROUP BY 1) w
ON w.machine=s.machine AND s.start_ts > w.a AND s.start_ts <= w.b""", "duration_ms")
def _(p):
    return value.scope_stops(views.significant(p), value.scored_windows(p.scored))


shared("o_scope", """
SELECT s.machine, s.start_ts, s.duration_ms FROM (SELECT machine, start_ts, max(least(greatest(duration_ms,0),86400000)) AS duration_ms
  FROM o_unpl WHERE minutes >= 15 GROUP BY 1,2) s JOIN (SELECT machine, min(ts) AS a, max(ts) + INTERVAL 60 MINUTE AS b FROM fx_scored GROUP BY 1) w
ON w.machine=s.machine AND s.start_ts > w.a AND s.start_ts <= w.b""")
shared("o_match", """
SELECT s.machine, s.start_ts, s.duration_ms, (SELECT max(r.risk) FROM fx_scored r WHERE r.machine=s.machine
  AND r.ts > s.start_ts - INTERVAL 60 MINUTE AND r.ts < s.start_ts) AS peak FROM o_scope s""")


@query("stop_match", """
SELECT machine, start_ts AS start, duration_ms, coalesce(peak >= 0.75, false) AS caught, peak AS max_prior_risk FROM o_match""", "duration_ms max_prior_risk")
def _(p):
    scope = value.scope_stops(views.significant(p), value.scored_windows(p.scored))
    return value.match_stops(p.scored, scope, 0.75)


@query("timeline_overlay", """
SELECT w.id, t.machine, t.role, t.t AS time, t.v AS value FROM (
  SELECT id, machine, started_on - INTERVAL 15 MINUTE AS w0, coalesce(ended_on, started_on) + INTERVAL 5 MINUTE AS w1 FROM fx_stops
  WHERE display_text='Undefined Stoppage') w
JOIN o_tel t ON t.machine=w.machine AND t.t BETWEEN w.w0 AND w.w1 WHERE t.role IN ('run_state','cycle_time','axis_position','run_time','production_count')""", "value")
def _(p):
    w = p.stops.where("display_text = 'Undefined Stoppage'").select(
        "id", "machine", F.col("started_on").alias("w_start"), F.coalesce("ended_on", "started_on").alias("w_end")
    )
    return rca.telemetry_overlay(w, views.readings(p), "id")
