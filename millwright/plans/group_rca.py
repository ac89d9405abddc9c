"""Event model, cascades, cards, recurrence and cross-machine detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import cross, events, rca, sessions
from . import views
from .registry import query, rnd, rnd_even, shared
from .sqltext import case_map

# ------------------------------------------------------------ events


@query("alert_events", """
SELECT machine, unit_uid, source, category, label, start_ts AS "start", end_ts AS "end", duration_ms, false AS is_planned,
  false AS excludes_oee, 0.9::DOUBLE AS severity, index, is_array FROM o_alerts""", "duration_ms severity")
def _(p):
    return views.alerts(p).select(*[c for c in events.EVENT_COLS if c != "meta"], "meta.index", "meta.is_array")


@query("stoppage_events", """
SELECT machine, unit_uid, source, category, label, start_ts AS "start", end_ts AS "end", duration_ms, is_planned,
  category='CONNECTIVITY' AS excludes_oee, CASE category WHEN 'UNPLANNED_RUNSTOP' THEN 0.7::DOUBLE WHEN 'CONNECTIVITY' THEN 0.4 ELSE 0.2 END AS severity,
  clipped FROM o_stops""", "duration_ms severity")
def _(p):
    return views.stops(p).select(*[c for c in events.EVENT_COLS if c != "meta"], "meta.clipped")


@query("offline_fanout", """
SELECT machine, unit_uid, category, label, start_ts AS "start", end_ts AS "end", duration_ms, instance_id, systemic FROM o_offline""", "duration_ms")
def _(p):
    return views.offline(p).select(
        "machine", "unit_uid", "category", "label", "start", "end", "duration_ms", "meta.instance_id", "meta.systemic"
    )


shared("o_adw", """
SELECT machine, min(ts) AS start_ts, max(ts) AS end_ts, max(risk)*100 AS peak_score FROM (
  SELECT machine, ts, risk, sum(CASE WHEN prev IS NULL OR epoch_us(ts - prev) > 3600000000 THEN 1 ELSE 0 END)
    OVER (PARTITION BY machine ORDER BY ts, event_id) AS s FROM (
    SELECT *, lag(ts) OVER (PARTITION BY machine ORDER BY ts, event_id) AS prev FROM fx_scored WHERE risk >= 0.9)) GROUP BY machine, s""")


def _ad_windows(p):
    scores = p.scored.select("machine", "ts", (F.col("risk") * 100).alias("score"))
    return p.memo("adw", lambda: sessions.extract_windows(scores, thresh=90.0, merge_gap_min=60))


@query("adwindow_events", """
SELECT machine, 'ANOMALY' AS category, start_ts AS "start", end_ts AS "end", epoch_us(end_ts - start_ts)/1000.0::DOUBLE AS duration_ms,
  peak_score/100 AS severity, true AS excludes_oee FROM o_adw""", "duration_ms severity")
def _(p):
    return events.adwindow_events(_ad_windows(p)).select("machine", "category", "start", "end", "duration_ms", "severity", "excludes_oee")


def _stream(p):
    return p.memo("stream", lambda: events.event_stream(
        views.alerts(p), views.stops(p), views.offline(p), events.adwindow_events(_ad_windows(p))))


shared("o_stream", """
SELECT machine, unit_uid, source, category, label, start_ts, end_ts, duration_ms FROM o_stops
UNION ALL SELECT machine, unit_uid, source, category, label, start_ts, end_ts, duration_ms FROM o_alerts
UNION ALL SELECT machine, unit_uid, source, category, label, start_ts, end_ts, duration_ms FROM o_offline
UNION ALL SELECT machine, NULL, 'ad_window', 'ANOMALY', 'telemetry anomaly', start_ts, end_ts, epoch_us(end_ts - start_ts)/1000.0::DOUBLE FROM o_adw""")


@query("event_stream", """
SELECT machine, unit_uid, source, category, label, start_ts AS "start", end_ts AS "end", duration_ms FROM o_stream""", "duration_ms")
def _(p):
    return _stream(p).select("machine", "unit_uid", "source", "category", "label", "start", "end", "duration_ms")


# ------------------------------------------------------------ cascades and cards

shared("o_casc", f"""
SELECT machine, b AS bucket_start, CAST(sum(n) AS BIGINT) AS n_alarms, arg_min(label, (rank, label, category)) AS root_alarm,
  arg_min(category, (rank, label, category)) AS root_category,
  string_agg(label || CASE WHEN n > 1 THEN ' x' || n ELSE '' END, ' -> ' ORDER BY rank, label, category) AS chain FROM (
  SELECT machine, time_bucket(INTERVAL 2 SECOND, start_ts) AS b, category, label, {case_map('category', rules.CAUSAL_RANK, 99)} AS rank, count(*) AS n
  FROM o_alerts GROUP BY 1,2,3,4) GROUP BY 1,2 HAVING sum(n) >= 2""")


@query("alarm_cascade", "SELECT * FROM o_casc")
def _(p):
    return rca.cascades(views.alerts(p)).withColumn("chain", rca.chain_text(F.col("chain")))


def _hypothesis_values() -> str:
    rows = []
    for cat in [*rules.HYPOTHESES, "OTHER_ALARM", "CHUCK", "LUBE_OIL", "MOTOR_OVERLOAD"]:
        o = 0
        for c in dict.fromkeys([cat, rca.GENERIC]):
            for cause, like, _why, act in rules.HYPOTHESES.get(c, []):
                rows.append(f"('{cat}', '{c}', {o}, '{cause}', {like}::DOUBLE, '{act}')")
                o += 1
    return "(VALUES " + ",\n".join(rows) + ") AS h(primary_category, category, o, cause, likelihood, act)"


@query("hypothesis_rank", f"""
SELECT a.machine, a.start_ts AS "start", a.index, h.category, CAST(row_number() OVER (PARTITION BY a.machine, a.start_ts, a.index ORDER BY h.likelihood DESC, h.o) AS INTEGER) AS position,
  h.cause, least(1.0, h.likelihood + CASE WHEN a.index = 1 THEN 0.1::DOUBLE ELSE 0 END) AS likelihood, h.act AS recommended_action
FROM o_alerts a JOIN {_hypothesis_values()} ON h.primary_category = a.category""", "likelihood")
def _(p):
    a = views.alerts(p).select("machine", "start", F.col("meta.index").alias("index"), "category")
    h = a.withColumn("h", rca.hypotheses(F.col("category"), F.col("index") == 1)).drop("category")
    x = h.select("machine", "start", "index", F.posexplode("h").alias("position", "x"))
    return x.select(
        "machine", "start", "index", "x.category", (F.col("position") + 1).alias("position"), "x.cause", "x.likelihood", "x.recommended_action"
    )


shared("o_cw", """
SELECT id, machine, started_on - INTERVAL 15 MINUTE AS w0, coalesce(ended_on, started_on) + INTERVAL 5 MINUTE AS w1 FROM fx_stops
WHERE display_text='Undefined Stoppage'""")
shared("o_facts", """
SELECT w.id, count(*) FILTER (e.source='alert') AS n_alarms, count(*) FILTER (e.source='offline') AS n_off, count(*) FILTER (e.source='ad_window') AS n_ad,
  arg_min(e.label, (e.start_ts, e.label, e.category)) FILTER (e.source='alert') AS al, arg_min(e.category, (e.start_ts, e.label, e.category)) FILTER (e.source='alert') AS ac,
  sum(e.duration_ms) FILTER (e.source='stoppage' AND e.category='UNPLANNED_RUNSTOP') AS linked
FROM o_cw w JOIN o_stream e ON e.machine=w.machine AND e.start_ts <= w.w1 AND (e.end_ts >= w.w0 OR e.end_ts IS NULL OR e.start_ts >= w.w0) GROUP BY w.id""")
shared("o_minlag", """
SELECT machine, min(lag) AS lag FROM (SELECT a.machine, (SELECT min(epoch_us(u.start_ts - a.start_ts))/1000000.0::DOUBLE FROM o_unpl u WHERE u.machine=a.machine
  AND u.start_ts >= a.start_ts AND u.start_ts <= a.start_ts + INTERVAL 10 MINUTE) AS lag FROM o_alerts a) GROUP BY machine""")
shared("o_card", f"""
SELECT *, CASE WHEN root_alarm IS NOT NULL THEN root_category WHEN has_alarm THEN ac WHEN is_connectivity THEN 'CONNECTIVITY' WHEN n_ad > 0 THEN 'ANOMALY' ELSE 'UNPLANNED_RUNSTOP' END AS primary_category,
  CASE WHEN is_connectivity THEN 'CONNECTIVITY' WHEN has_alarm AND n_ad > 0 THEN 'DRIFT_ALARM_STOP' WHEN has_alarm AND lag_seconds <= 60 THEN 'ALARM_CAUSED_STOP'
    WHEN has_alarm THEN 'ALARM_RELATED_STOP' ELSE 'OPERATIONAL_STOP' END AS pattern FROM (
  SELECT w.id, w.machine, w.w0, w.w1, coalesce(f.n_alarms,0) > 0 AS has_alarm, coalesce(f.n_off,0) > 0 AND NOT coalesce(f.n_alarms,0) > 0 AS is_connectivity,
    coalesce(f.n_ad,0) AS n_ad, f.al, f.ac, {rnd_even('coalesce(f.linked,0)/3600000', 2)} AS linked_hours,
    CASE WHEN coalesce(f.n_alarms,0) > 0 THEN l.lag END AS lag_seconds, c.root_alarm, c.root_category, c.n_alarms AS csize, c.chain
  FROM o_cw w LEFT JOIN o_facts f USING (id) LEFT JOIN o_minlag l ON l.machine=w.machine
  LEFT JOIN LATERAL (SELECT * FROM o_casc k WHERE k.machine=w.machine AND k.bucket_start BETWEEN w.w0 AND w.w1 ORDER BY bucket_start LIMIT 1) c ON true)""")


def _cards(p):
    w = p.stops.where("display_text = 'Undefined Stoppage'").select(
        "id", "machine", F.col("started_on").alias("w_start"), F.coalesce("ended_on", "started_on").alias("w_end")
    )
    return p.memo("cards", lambda: rca.cards(w, _stream(p), views.alerts(p), views.stops(p)))


@query("root_cause_card", f"""
SELECT id, machine, w0 AS window_start, w1 AS window_end, pattern, primary_category, lag_seconds, linked_hours, is_connectivity,
  CASE WHEN root_alarm IS NOT NULL THEN 'Alarm cascade root: ' || root_alarm WHEN has_alarm THEN 'Alarm: ' || al WHEN is_connectivity THEN 'System Offline'
    WHEN n_ad > 0 THEN 'Telemetry anomaly (AD)' ELSE 'Unplanned stop' END AS trigger,
  concat_ws(' | ', CASE WHEN root_alarm IS NOT NULL THEN 'Alarm cascade (' || csize || '): ' || chain || ' | root=' || root_alarm WHEN has_alarm THEN 'Alarm: ' || al
    WHEN is_connectivity THEN 'Collector offline window (no machine telemetry present)' WHEN n_ad > 0 THEN 'AD telemetry anomaly; deviating: None' END,
    CASE WHEN lag_seconds IS NOT NULL THEN 'Nearest alarm->stop lag: ' || CAST(round_even(lag_seconds,0) AS BIGINT) || 's' END,
    CASE WHEN root_alarm IS NOT NULL AND n_ad > 0 THEN 'Telemetry drift preceded the alarm (predictive signal)' END) AS evidence,
  (SELECT arg_max(cause, (likelihood, -o)) FROM {_hypothesis_values()} WHERE h.primary_category = CASE WHEN c.primary_category IN ('ANOMALY') THEN 'UNPLANNED_RUNSTOP' ELSE c.primary_category END) AS top_cause,
  (SELECT arg_max(act, (likelihood, -o)) FROM {_hypothesis_values()} WHERE h.primary_category = CASE WHEN c.primary_category IN ('ANOMALY') THEN 'UNPLANNED_RUNSTOP' ELSE c.primary_category END) AS recommended_action
FROM o_card c""", "lag_seconds linked_hours")
def _(p):
    return _cards(p).select(
        "id", "machine", "window_start", "window_end", "trigger", "pattern", "primary_category", "lag_seconds", "linked_hours",
        "is_connectivity", F.array_join("evidence", " | ").alias("evidence"), F.col("hypotheses")[0]["cause"].alias("top_cause"), "recommended_action",
    )


@query("whatif_bridge", f"""
SELECT id, machine, CASE WHEN is_connectivity THEN 'CONNECTIVITY' ELSE cat END AS category,
  CASE WHEN is_connectivity THEN 0 ELSE linked_hours * 3600000 * {case_map('cat', rules.RECOVERY_SHARE, 0.5)} END AS recoverable_ms,
  CASE WHEN is_connectivity THEN 'none' ELSE 'W1' END AS target_scenario FROM (
  SELECT *, CASE WHEN root_alarm IS NOT NULL THEN root_category ELSE (SELECT arg_max(h.category, (likelihood, -o)) FROM {_hypothesis_values()}
    WHERE h.primary_category = CASE WHEN k.primary_category = 'ANOMALY' THEN 'UNPLANNED_RUNSTOP' ELSE k.primary_category END) END AS cat FROM o_card k)""", "recoverable_ms")
def _(p):
    return rca.whatif_hint(_cards(p))


# ------------------------------------------------------------ recurrence

shared("o_rec", f"""
SELECT b AS bucket_start, category, machines, n_machines, total_hours, {rnd('n_machines * greatest(total_hours, 0.01::DOUBLE)', 2)} AS systemic_score,
  {case_map('category', rules.FACILITY_CAUSE, 'MULTI_MACHINE')} AS facility_root FROM (
  SELECT date_trunc('hour', start_ts) AS b, category, string_agg(DISTINCT machine, ',' ORDER BY machine) AS machines, count(DISTINCT machine) AS n_machines,
    sum(duration_ms)/3600000 AS total_hours FROM o_stream WHERE category IN ({', '.join(map(repr, rca.RECURRING))}) GROUP BY 1,2) WHERE n_machines >= 2""")


@query("recurrence", "SELECT * FROM o_rec", "total_hours systemic_score")
def _(p):
    return rca.recurrence(_stream(p)).withColumn("machines", F.array_join("machines", ","))


@query("recurrence_category_rank", """
SELECT count(*) AS systemic_buckets, count(*) FILTER (rn < first_rn) AS rank FROM (
  SELECT *, min(CASE WHEN category='CONNECTIVITY' THEN rn END) OVER () AS first_rn FROM (
    SELECT *, row_number() OVER (ORDER BY systemic_score DESC, bucket_start, category) AS rn FROM o_rec))""")
def _(p):
    return rca.category_rank(rca.recurrence(_stream(p)))


@query("fanout_audit", """
SELECT count(*) AS windows, count(*) FILTER (members > 1) AS replicated, avg(CASE WHEN members > 1 THEN 1.0::DOUBLE ELSE 0 END) AS share, max(members) AS widest
FROM (SELECT DISTINCT s.instance_id, s.started_on, s.ended_on, m.members FROM fx_status s
  JOIN (SELECT instance_id, count(DISTINCT machine) AS members FROM o_inst GROUP BY 1) m USING (instance_id) WHERE NOT s.is_online)""", "share")
def _(p):
    return rca.fanout_audit(p.status, views.instances(p))


# ------------------------------------------------------------ synchronisation

shared("o_sig", "SELECT * FROM o_unpl WHERE minutes >= 15")
shared("o_occ", """
SELECT machine, b AS bucket_start, CAST(epoch(b - b0)/3600 AS BIGINT) AS b_idx, CAST(epoch(b1 - b0)/3600 + 1 AS BIGINT) AS h FROM (
  SELECT DISTINCT machine, date_trunc('hour', start_ts) AS b FROM o_sig), (SELECT min(date_trunc('hour', start_ts)) AS b0, max(date_trunc('hour', start_ts)) AS b1 FROM o_sig)""")


@query("significant_stops", 'SELECT machine, start_ts AS "start", label, duration_ms, minutes FROM o_sig', "duration_ms minutes")
def _(p):
    return views.significant(p)


@query("occupancy", "SELECT * FROM o_occ")
def _(p):
    return cross.occupancy(views.significant(p))


def _sync_sql(name: str, occ: str, n_perm: int, seed: int) -> str:
    mod, step = ("h", 1) if name == "free_shift" else ("greatest(1, h // 24)", 24)
    return f"""
SELECT '{name}' AS null_model, observed, avg(co) AS expected, stddev_pop(co) + 1e-9::DOUBLE AS sd, (observed - avg(co))/(stddev_pop(co) + 1e-9::DOUBLE) AS z,
  avg(CASE WHEN co >= observed THEN 1.0::DOUBLE ELSE 0 END) AS p, (SELECT max(h) FROM {occ}) AS buckets, (SELECT count(DISTINCT machine) FROM {occ}) AS machines
FROM (SELECT perm, count(*) FILTER (m >= 2) AS co FROM (
    SELECT perm, (b_idx + (('0x' || substr(md5(perm || '|' || machine || '|{seed}'),1,8))::BIGINT % ({mod})) * {step}) % h AS b, count(*) AS m
    FROM {occ}, range({n_perm}) t(perm) GROUP BY 1,2) GROUP BY 1),
  (SELECT count(*) AS observed FROM (SELECT b_idx FROM {occ} GROUP BY 1 HAVING count(*) >= 2)) GROUP BY observed"""


@query("synchronization_test", _sync_sql("free_shift", "o_occ", 400, 0) + " UNION ALL " + _sync_sql("daily_preserving", "o_occ", 400, 0), "expected sd z p")
def _(p):
    return cross.synchronization(views.significant(p))


@query("cooccurrence_null", _sync_sql("free_shift", "o_occ5", 300, 1), "expected sd z p")
def _(p):
    return cross.synchronization(views.significant(p), n_perm=300, seed=1, min_events=5, nulls=("free_shift",))


shared("o_occ5", """
SELECT machine, b AS bucket_start, CAST(epoch(b - b0)/3600 AS BIGINT) AS b_idx, CAST(epoch(b1 - b0)/3600 + 1 AS BIGINT) AS h FROM (
  SELECT DISTINCT machine, b FROM o_sig5), (SELECT min(b) AS b0, max(b) AS b1 FROM o_sig5)""")
shared("o_sig5", """
SELECT machine, date_trunc('hour', start_ts) AS b FROM o_sig WHERE machine IN (SELECT machine FROM o_sig GROUP BY 1 HAVING count(*) >= 5)""")


@query("hour_concentration", """
SELECT hour, n, n::DOUBLE/sum(n) OVER () AS share, row_number() OVER (ORDER BY n DESC, hour) AS rank, row_number() OVER (ORDER BY n DESC, hour) <= 3 AS busiest FROM (
  SELECT CAST(hour(bucket_start) AS INTEGER) AS hour, count(*) AS n FROM (SELECT bucket_start FROM o_occ GROUP BY 1 HAVING count(*) >= 2) GROUP BY 1)""", "share")
def _(p):
    return cross.hour_concentration(cross.occupancy(views.significant(p)))


@query("reason_granularity", """
SELECT (SELECT count(DISTINCT label) FROM o_sig) AS reasons, count(*) FILTER (m >= 2) AS co_stop_buckets, (SELECT count(DISTINCT label) FROM o_sig) <= 1 AS vacuous
FROM (SELECT date_trunc('hour', start_ts) AS b, count(DISTINCT machine) AS m FROM o_sig GROUP BY 1)""")
def _(p):
    return cross.reason_granularity(views.significant(p))


# ------------------------------------------------------------ regimes
R = list(cross.REGIME_ROLES)
shared("o_avail", f"""
SELECT m.name AS machine, {', '.join(f'coalesce(g.{c}, 0) AS {c}' for c in ['buckets', 'live_buckets', *R])} FROM o_master m LEFT JOIN (
  SELECT machine, count(*) AS buckets, count(*) FILTER (NOT is_offline) AS live_buckets, {', '.join(f'count({c}) AS {c}' for c in R)} FROM o_grid GROUP BY 1) g ON g.machine=m.name""")


@query("regime_availability", "SELECT * FROM o_avail")
def _(p):
    return cross.availability(views.feature_grid(p), views.master(p))


@query("regime_map", f"""
SELECT CASE WHEN pat = '' THEN '(blind)' ELSE pat END AS regime, count(*) AS n_machines, string_agg(machine, ',' ORDER BY machine) AS machines FROM (
  SELECT machine, concat_ws(', ', {', '.join(f"CASE WHEN {c} >= 100 THEN '{c}' END" for c in R)}) AS pat FROM o_avail) GROUP BY 1""")
def _(p):
    a = cross.availability(views.feature_grid(p), views.master(p))
    return cross.regime_map(a, min_buckets=100).withColumn("machines", F.array_join("machines", ","))


@query("role_comparability", f"""
SELECT role, count(*) AS machines, min(m) AS median_min, max(m) AS median_max, {rnd('max(m)/min(m)', 1)} AS spread_x FROM (
  {' UNION ALL '.join(f"SELECT '{c}' AS role, machine, quantile_cont({c}, 0.5::DOUBLE) AS m FROM o_grid GROUP BY machine" for c in R)})
WHERE m > 0 GROUP BY role HAVING count(*) >= 2""", "median_min median_max spread_x")
def _(p):
    return cross.comparability(views.feature_grid(p))


@query("heterogeneity", """
SELECT machine, quantile_cont(cycle_time_mean, 0.1::DOUBLE) AS p10, quantile_cont(cycle_time_mean, 0.5::DOUBLE) AS median,
  quantile_cont(cycle_time_mean, 0.9::DOUBLE) AS p90, count(cycle_time_mean) AS n FROM o_grid WHERE cycle_time_mean IS NOT NULL GROUP BY 1""", "p10 median p90")
def _(p):
    return cross.heterogeneity(views.feature_grid(p))
