"""Scans, dimensions, scalar functions and summaries (one registered plan per operator)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import oee as ofx
from ..functions import rules
from ..functions.timex import hours, minutes
from ..operators import dims, events, kpi
from ..sources import tables
from . import views
from .registry import query
from .sqltext import COMP, case_map, case_regex, kpis, stop_category

T0, T1 = "2024-01-05 00:00:00", "2024-01-20 12:00:00"

# ---------------------------------------------------------------- scans


@query("telemetry_window", f"""
SELECT time, readingdef_uid, value, index, instance_id FROM fx_telemetry
WHERE time BETWEEN TIMESTAMP '{T0}' AND TIMESTAMP '{T1}'
  AND readingdef_uid IN (SELECT readingdef_uid FROM o_roles WHERE canonical_role='cycle_time')""", "value")
def _(p):
    uids = views.roles(p).where("canonical_role = 'cycle_time'")
    return tables.telemetry_window(p.telemetry, start=T0, end=T1, uids=uids)


@query("telemetry_feature_scan", """
SELECT r.machine, r.canonical_role AS role, t.readingdef_uid, t.time, t.value
FROM fx_telemetry t JOIN o_roles r USING (readingdef_uid) WHERE t.time IS NOT NULL""", "value")
def _(p):
    return tables.feature_scan(p.telemetry, views.roles(p))


@query("unit_conv", """
SELECT id, duration_milliseconds/3600000 AS h, duration_milliseconds/60000 AS mins FROM fx_stops""", "h mins")
def _(p):
    return p.stops.select(
        "id", hours("duration_milliseconds").alias("h"), minutes("duration_milliseconds").alias("mins")
    )


# ---------------------------------------------------------------- dimensions


@query("machine_master", "SELECT * FROM o_master")
def _(p):
    return views.master(p)


@query("signal_classify", f"""
SELECT readingdef_uid, readingdef_name, {case_regex('readingdef_name', rules.SIGNAL_ROLES, 'other', 'i')} AS role
FROM fx_monitor_reading_def UNION ALL
SELECT uid, display_text, {case_regex('display_text', rules.SIGNAL_ROLES, 'other', 'i')} FROM fx_mes_reading_def
UNION ALL SELECT CAST(id AS VARCHAR), display_text, {case_regex('display_text', rules.SIGNAL_ROLES, 'other', 'i')}
FROM fx_stops""")
def _(p):
    a = p.monitor_reading_def.select("readingdef_uid", "readingdef_name")
    b = p.mes_reading_def.select("uid", "display_text")
    c = p.stops.select(F.col("id").cast("string"), "display_text")
    return a.union(b).union(c).withColumn("role", rules.signal_role("readingdef_name"))


@query("signal_map", f"""
SELECT readingdef_uid, machine, vendor, readingdef_name, canonical_role,
  canonical_role IN ({', '.join(repr(r) for r in rules.EVIDENCE_ROLES)}) AS is_evidence_signal,
  mes_display_text, CASE WHEN matched_mes THEN false END AS mes_exclude_from_oee, matched_mes, unit_uid, unit_id
FROM o_signals""")
def _(p):
    return views.signals(p)


@query("role_uid_map", """
SELECT r.readingdef_uid, r.machine, m.vendor, r.canonical_role FROM o_roles r JOIN o_master m ON m.name=r.machine""")
def _(p):
    return views.roles(p)


@query("machine_instance", "SELECT * FROM o_inst")
def _(p):
    return views.instances(p)


@query("reason_lookup", """
SELECT uid AS reading_def_uid, min(display_text) AS display_text FROM fx_mes_reading_def GROUP BY uid""")
def _(p):
    return dims.reason_lookup(p.mes_reading_def)


@query("catalog_join_coverage", """
WITH a AS (SELECT DISTINCT uid FROM fx_mes_reading_def), b AS (SELECT DISTINCT readingdef_uid AS uid FROM fx_telemetry)
SELECT (SELECT count(*) FROM a) AS left_uids, (SELECT count(*) FROM b) AS right_uids,
  (SELECT count(*) FROM a WHERE uid IN (SELECT uid FROM b)) AS both_uids,
  (SELECT count(*) FROM a WHERE uid NOT IN (SELECT uid FROM b)) AS left_only,
  (SELECT count(*) FROM b WHERE uid NOT IN (SELECT uid FROM a)) AS right_only,
  (SELECT count(*) FROM a WHERE uid IN (SELECT uid FROM b))*100.0::DOUBLE/greatest((SELECT count(*) FROM b),1) AS pct_of_right
""", "pct_of_right")
def _(p):
    return dims.catalog_coverage(p.mes_reading_def, "uid", p.telemetry, "readingdef_uid")


@query("unit_coverage", """
SELECT u.uid AS unit_uid, u.name FROM fx_unit u WHERE u.uid NOT IN (SELECT unit_uid FROM fx_monitor_unit)""")
def _(p):
    return (
        p.unit.select(F.col("uid").alias("unit_uid"), "name")
        .join(p.monitor_unit.select("unit_uid"), "unit_uid", "left_anti")
    )


# ---------------------------------------------------------------- scalar functions


@query("json_components", """
SELECT unit_uid, trans_date, CAST(availability->>'A' AS DOUBLE) AS a, CAST(availability->>'UnPlannedStop' AS DOUBLE) AS unplanned,
  CAST(performance->>'PlannedTime' AS DOUBLE) AS planned_time, CAST(quality->>'ProductSum' AS DOUBLE) AS product,
  CAST(quality->>'Missing' AS DOUBLE) AS missing FROM fx_oee_daily""", "a unplanned planned_time product missing")
def _(p):
    return p.oee_daily.select(
        "unit_uid", "trans_date", F.from_json("availability", ofx.A_DDL).alias("x"),
        F.from_json("performance", ofx.P_DDL).alias("y"),
        F.from_json("quality", ofx.Q_DDL + ", Missing DOUBLE").alias("z"),
    ).select(
        "unit_uid", "trans_date", F.col("x.A").alias("a"), F.col("x.UnPlannedStop").alias("unplanned"),
        F.col("y.PlannedTime").alias("planned_time"), F.col("z.ProductSum").alias("product"),
        F.col("z.Missing").alias("missing"),
    )


@query("oee_recompute", """
SELECT machine, trans_date, A, P, Q, A*P*Q AS OEE FROM (SELECT *, """ + kpis(*COMP) + """ FROM fx_oee_large)""", "A P Q OEE")
def _(p):
    return kpi.with_kpis(p.oee_large).select("machine", "trans_date", "A", "P", "Q", "OEE")


@query("oee_baseline", f"""
SELECT machine, unit_uid, date, trans_date, level, OEE, A, P, Q, {', '.join(COMP)}, oee_stored, a_stored
FROM o_base WHERE level = 1""", "OEE A P Q oee_stored a_stored " + " ".join(COMP))
def _(p):
    return views.baseline(p)


@query("oee_baseline_plant", f"""
SELECT machine, unit_uid, date, level, OEE, A, P, Q FROM o_base""", "OEE A P Q")
def _(p):
    return views.baseline(p, None).select("machine", "unit_uid", "date", "level", "OEE", "A", "P", "Q")


@query("classify_alarm", f"""
SELECT machine, started_on, index, value, {case_regex('upper(value)', rules.ALARM_CATEGORIES, 'OTHER_ALARM')} AS category
FROM fx_alerts""")
def _(p):
    return p.alerts.select(
        "machine", "started_on", "index", "value", rules.alarm_category("value").alias("category")
    )


@query("classify_stop", f"""
SELECT id, display_text, is_planned, {stop_category('display_text', 'is_planned')} AS category FROM fx_stops""")
def _(p):
    return p.stops.select(
        "id", "display_text", "is_planned", rules.stop_category("display_text", "is_planned").alias("category")
    )


@query("classify_pattern", """
SELECT event_id, CASE WHEN k % 5 = 0 THEN 'CONNECTIVITY' WHEN k % 2 = 0 AND k % 3 = 0 THEN 'DRIFT_ALARM_STOP'
  WHEN k % 2 = 0 AND dur_s % 120 <= 60 AND k % 7 > 0 THEN 'ALARM_CAUSED_STOP'
  WHEN k % 2 = 0 THEN 'ALARM_RELATED_STOP' ELSE 'OPERATIONAL_STOP' END AS pattern FROM ev""")
def _(p):
    k = F.col("k")
    lag = F.when(k % 7 > 0, (F.col("dur_s") % 120).cast("double"))
    return p.ev.select("event_id", rules.causal_pattern(k % 2 == 0, lag, k % 3 == 0, k % 5 == 0).alias("pattern"))


@query("causal_precedence", f"""
SELECT machine, started_on, index, category, {case_map('category', rules.CAUSAL_RANK, 99)} AS rank FROM (
  SELECT machine, start_ts AS started_on, index, category FROM o_alerts)""")
def _(p):
    return p.alerts.select(
        "machine", "started_on", "index", rules.alarm_category("value").alias("category")
    ).withColumn("rank", rules.causal_rank("category"))


@query("recovery_factor", f"""
SELECT category, count(*) AS n, {case_map('category', rules.RECOVERY_SHARE, 0.5)} AS factor FROM (
  SELECT category FROM o_alerts UNION ALL SELECT category FROM o_stops) GROUP BY category""", "factor")
def _(p):
    cats = views.alerts(p).select("category").unionByName(views.stops(p).select("category"))
    return cats.groupBy("category").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "factor", rules.recovery_share("category")
    )


@query("facility_root", f"""
SELECT category, count(*) AS n, {case_map('category', rules.FACILITY_CAUSE, 'MULTI_MACHINE')} AS facility_root FROM (
  SELECT category FROM o_alerts UNION ALL SELECT category FROM o_stops) GROUP BY category""")
def _(p):
    cats = views.alerts(p).select("category").unionByName(views.stops(p).select("category"))
    return cats.groupBy("category").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "facility_root", rules.facility_cause("category")
    )


@query("kind_flag", """
SELECT id, display_text, CASE WHEN regexp_matches(display_text, 'Offline|Connect', 'i') THEN 'connectivity' ELSE 'fault' END AS kind
FROM fx_stops""")
def _(p):
    return p.stops.select("id", "display_text", rules.reason_kind("display_text").alias("kind"))


@query("tier_classify", """
SELECT name, vendor, CASE WHEN NOT has_telemetry THEN 'Blind (MES-only)' WHEN vendor='Mitsubishi' THEN 'Rich (temp/load*)'
  ELSE 'Sparse (cycle/run)' END AS tier FROM o_master""")
def _(p):
    return views.master(p).select("name", "vendor", rules.tier(F.col("has_telemetry"), F.col("vendor")).alias("tier"))


CELL = ["M00", "M03", "M06", "M09"]
SIDE = ["M01", "M04", "M07"]


@query("regime_of", f"""
SELECT name, CASE WHEN name IN ({', '.join(map(repr, CELL))}) THEN 'cell (predictable)'
  WHEN name IN ({', '.join(map(repr, SIDE))}) THEN 'side line (RCA/OEE only)' ELSE 'telemetry-blind' END AS regime FROM fx_unit""")
def _(p):
    groups = {"cell (predictable)": CELL, "side line (RCA/OEE only)": SIDE}
    return p.unit.select("name", rules.regime(F.col("name"), groups, "telemetry-blind").alias("regime"))


@query("json_safe_labels", """
SELECT event_id, lower(trim(CASE WHEN k % 2 = 0 THEN ' True ' WHEN k % 3 = 0 THEN 'true' ELSE 'False' END)) = 'true' AS hit FROM ev""")
def _(p):
    text = F.when(F.col("k") % 2 == 0, " True ").when(F.col("k") % 3 == 0, "true").otherwise("False")
    return p.ev.select("event_id", (F.lower(F.trim(text)) == "true").alias("hit"))


# ---------------------------------------------------------------- summaries


@query("downtime_pareto", """
SELECT machine, display_text AS reason, count(id) AS events, sum(duration_milliseconds)/3600000 AS hours
FROM fx_stops WHERE NOT is_planned GROUP BY 1,2""", "hours")
def _(p):
    return kpi.downtime_pareto(p.stops)


@query("stop_pareto", """
SELECT 'machine' AS scope, machine, category, label AS reason, count(*) AS events, sum(duration_ms)/3600000 AS hours
FROM o_stops WHERE category <> 'PLANNED_BREAK' GROUP BY machine, category, label
UNION ALL SELECT 'plant', 'PLANT', category, label, count(*), sum(duration_ms)/3600000
FROM o_stops WHERE category <> 'PLANNED_BREAK' GROUP BY category, label""", "hours")
def _(p):
    return kpi.stop_pareto(views.stops(p))


@query("stop_pareto_faults", """
SELECT 'machine' AS scope, machine, category, label AS reason, count(*) AS events, sum(duration_ms)/3600000 AS hours
FROM o_stops WHERE category <> 'CONNECTIVITY' GROUP BY machine, category, label
UNION ALL SELECT 'plant', 'PLANT', category, label, count(*), sum(duration_ms)/3600000
FROM o_stops WHERE category <> 'CONNECTIVITY' GROUP BY category, label""", "hours")
def _(p):
    return kpi.stop_pareto(views.stops(p), include_planned=True, separate_connectivity=False)


@query("alarm_pareto", """
SELECT machine, category, count(*) AS occurrences, count(DISTINCT machine) AS machines_affected FROM o_alerts GROUP BY 1,2
UNION ALL SELECT 'PLANT', category, count(*), count(DISTINCT machine) FROM o_alerts GROUP BY category""")
def _(p):
    a = views.alerts(p)
    return kpi.alarm_pareto(a).unionByName(kpi.alarm_pareto(a, "plant"))


@query("category_hours", """
SELECT machine, category, coalesce(sum(duration_ms),0)/3600000 AS hours FROM o_stops GROUP BY 1,2""", "hours")
def _(p):
    return kpi.category_hours(views.stops(p))


@query("oee_machine_rollup", f"""
SELECT *, A*P*Q AS OEE FROM (SELECT *, {kpis(*COMP)} FROM (
  SELECT machine, {', '.join(f'sum({c})::DOUBLE AS {c}' for c in COMP)}, min(date) AS first_day, max(date) AS last_day,
    CAST(greatest(1, date_diff('day', min(date), max(date)) + 1) AS INTEGER) AS period_days
  FROM o_base WHERE level=1 GROUP BY machine))""", "A P Q OEE")
def _(p):
    return kpi.machine_rollup(views.baseline(p))


@query("oee_median_summary", """
SELECT m.name AS machine, m.vendor, CASE WHEN NOT has_telemetry THEN 'Blind (MES-only)' WHEN vendor='Mitsubishi'
  THEN 'Rich (temp/load*)' ELSE 'Sparse (cycle/run)' END AS tier, b.median_oee
FROM o_master m LEFT JOIN (SELECT machine, quantile_cont(OEE, 0.5::DOUBLE) AS median_oee FROM o_base WHERE level=1 GROUP BY 1) b
  ON b.machine=m.name
UNION ALL SELECT 'PLANT OEE', NULL, NULL, quantile_cont(OEE, 0.5::DOUBLE) FROM o_base WHERE level=1 AND ProductSum>0
UNION ALL SELECT 'PLANT A', NULL, NULL, quantile_cont(A, 0.5::DOUBLE) FROM o_base WHERE level=1
UNION ALL SELECT 'PLANT P', NULL, NULL, quantile_cont(P, 0.5::DOUBLE) FROM o_base WHERE level=1 AND ProductSum>0""", "median_oee")
def _(p):
    return kpi.median_summary(views.baseline(p), views.master(p))


@query("oee_heatmap", "SELECT machine, date, avg(OEE) AS OEE FROM o_base WHERE level=1 GROUP BY 1,2", "OEE")
def _(p):
    return kpi.heatmap(views.baseline(p))


@query("oee_validity", """
SELECT count(*) AS n, count(*) FILTER (a_stored BETWEEN 0 AND 1) AS in_range, count(*) FILTER (a_stored < 0) AS below_0,
  count(*) FILTER (a_stored > 1) AS above_1, count(*) FILTER (a_stored IS NULL) AS missing,
  count(*) FILTER (oee_stored = 0) AS zero_oee, count(*) FILTER (a_stored > 0 AND P = 0) AS a_without_p,
  count(*) FILTER (coalesce(ScrapeSum,0) <> 0) AS scrap_rows FROM o_base WHERE level=1""")
def _(p):
    return kpi.oee_validity(views.baseline(p))


@query("describe_kpis", " UNION ALL ".join(f"""
SELECT '{c}' AS metric, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
  quantile_cont({c}, 0.25::DOUBLE) AS p25, quantile_cont({c}, 0.5::DOUBLE) AS p50, quantile_cont({c}, 0.75::DOUBLE) AS p75
FROM o_base WHERE level=1""" for c in ("oee_stored", "a_stored", "P", "Q", "ProductSum", "ScrapeSum")),
    "mean std min max p25 p50 p75")
def _(p):
    return kpi.describe(views.baseline(p), ["oee_stored", "a_stored", "P", "Q", "ProductSum", "ScrapeSum"])


@query("signal_crosstab", """
SELECT signal_type, coalesce(triggered_by,'(blank)') AS triggered_by, count(*) AS n FROM fx_counter_slice GROUP BY 1,2""")
def _(p):
    return kpi.crosstab(p.counter_slice, "signal_type", "triggered_by")


@query("value_counts_topk", """
SELECT * FROM (SELECT 'alarm' AS what, trim(value) AS value, count(*) AS n FROM fx_alerts GROUP BY 2 ORDER BY n DESC, value LIMIT 6)
UNION ALL SELECT * FROM (SELECT 'reason', display_text AS value, count(*) AS n FROM fx_stops GROUP BY 2 ORDER BY n DESC, value LIMIT 4)
UNION ALL SELECT * FROM (SELECT 'order', order_no AS value, count(*) AS n FROM fx_workorder GROUP BY 2 ORDER BY n DESC, value LIMIT 3)""")
def _(p):
    parts = [
        ("alarm", kpi.top_values(p.alerts, F.trim("value"), 6)),
        ("reason", kpi.top_values(p.stops, F.col("display_text"), 4)),
        ("order", kpi.top_values(p.workorder, F.col("order_no"), 3)),
    ]
    out = None
    for what, df in parts:
        df = df.select(F.lit(what).alias("what"), "value", "n")
        out = df if out is None else out.unionByName(df)
    return out


@query("reason_hours_median", """
SELECT display_text AS reason, count(*) AS events, sum(duration_milliseconds)/3600000 AS hours,
  quantile_cont(duration_milliseconds/60000, 0.5::DOUBLE) AS median_min FROM fx_stops WHERE NOT is_planned GROUP BY 1""",
    "hours median_min")
def _(p):
    return kpi.reason_summary(p.stops)


@query("unplanned_hours_per_machine", """
SELECT machine, sum(duration_milliseconds)/3600000 AS hours FROM fx_stops WHERE NOT is_planned GROUP BY 1""", "hours")
def _(p):
    return kpi.unplanned_hours(p.stops)


@query("counter_workorder_summary", """
SELECT u.name AS machine, CAST(sum(value) AS BIGINT) AS pieces, count(*) AS n, count(*) FILTER (signal_type='COUNT') AS count_rows,
  count(*) FILTER (signal_type='STOCK_CYCLE') AS stock_rows, count(*) FILTER (triggered_by IS NULL) AS untriggered
FROM fx_counter_slice c LEFT JOIN fx_unit u ON u.uid=c.unit_uid GROUP BY 1""")
def _(p):
    return kpi.counter_summary(p.counter_slice, views.master(p))


@query("workorder_summary", """
SELECT count(*) AS n, count(*) FILTER (is_stock) AS stock, count(*) FILTER (is_work_order) AS work_orders,
  count(stock_cycle) AS cycles, avg(stock_cycle) AS mean_cycle, stddev_samp(stock_cycle) AS std_cycle,
  min(stock_cycle) AS min_cycle, max(stock_cycle) AS max_cycle, min(started_on) AS first_start, max(started_on) AS last_start,
  quantile_cont(stock_cycle, 0.25::DOUBLE) AS p25_cycle, quantile_cont(stock_cycle, 0.5::DOUBLE) AS median_cycle,
  quantile_cont(stock_cycle, 0.75::DOUBLE) AS p75_cycle FROM fx_workorder""",
    "mean_cycle std_cycle min_cycle max_cycle p25_cycle median_cycle p75_cycle")
def _(p):
    return kpi.workorder_summary(p.workorder)


@query("time_coverage", """
SELECT 'stops' AS table_name, count(*) AS n, min(started_on) AS first_ts, max(started_on) AS last_ts FROM fx_stops
UNION ALL SELECT 'alerts', count(*), min(started_on), max(started_on) FROM fx_alerts
UNION ALL SELECT 'oee', count(*), min(trans_date), max(trans_date) FROM fx_oee_daily
UNION ALL SELECT 'telemetry', count(*), min(time), max(time) FROM fx_telemetry
UNION ALL SELECT 'workorders', count(*), min(started_on), max(started_on) FROM fx_workorder""")
def _(p):
    return kpi.time_coverage({
        "stops": (p.stops, "started_on"), "alerts": (p.alerts, "started_on"), "oee": (p.oee_daily, "trans_date"),
        "telemetry": (p.telemetry, "time"), "workorders": (p.workorder, "started_on"),
    })


@query("signals_per_machine", f"""
SELECT machine, count(*) AS signals, count(*) FILTER (matched_mes) AS matched,
  count(*) FILTER (canonical_role IN ({', '.join(repr(r) for r in rules.EVIDENCE_ROLES)})) AS evidence,
  count(DISTINCT canonical_role) AS roles FROM o_signals GROUP BY 1""")
def _(p):
    return kpi.signals_per_machine(views.signals(p))


@query("role_counts", "SELECT canonical_role, count(*) AS signals FROM o_signals GROUP BY 1")
def _(p):
    return kpi.role_counts(views.signals(p))


@query("enabled_signals_per_unit", """
SELECT r.unit_uid, count(*) AS signals FROM fx_mes_reading_def r JOIN fx_unit u ON u.uid=r.unit_uid WHERE u.is_enabled GROUP BY 1""")
def _(p):
    on = p.unit.where("is_enabled").select(F.col("uid").alias("unit_uid"))
    return p.mes_reading_def.join(on, "unit_uid", "left_semi").groupBy("unit_uid").agg(F.count(F.lit(1)).alias("signals"))


@query("top_telemetry_signals", """
SELECT * FROM (SELECT 'numeric' AS kind, d.readingdef_name, count(*) AS n FROM fx_telemetry t
  LEFT JOIN fx_monitor_reading_def d USING (readingdef_uid) GROUP BY 2 ORDER BY n DESC, 2 LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'text', d.readingdef_name, count(*) AS n FROM fx_telemetry_string t
  LEFT JOIN fx_monitor_reading_def d USING (readingdef_uid) GROUP BY 2 ORDER BY n DESC, 2 LIMIT 5)""")
def _(p):
    a = kpi.top_signals(p.telemetry, p.monitor_reading_def, 5).select(F.lit("numeric").alias("kind"), "*")
    b = kpi.top_signals(p.telemetry_string, p.monitor_reading_def, 5).select(F.lit("text").alias("kind"), "*")
    return a.unionByName(b)


@query("source_counts", """
SELECT source, category, count(*) AS n FROM (SELECT source, category FROM o_stops UNION ALL SELECT source, category FROM o_alerts
  UNION ALL SELECT source, category FROM o_offline) GROUP BY 1,2""")
def _(p):
    s = events.event_stream(views.alerts(p), views.stops(p), views.offline(p))
    return s.groupBy("source", "category").agg(F.count(F.lit(1)).alias("n"))


@query("offline_dedup_hours", """
SELECT count(*) AS windows, sum(duration_milliseconds)/3600000 AS schedule_hours FROM (
  SELECT DISTINCT instance_id, started_on, ended_on, duration_milliseconds FROM fx_status WHERE NOT is_online)""", "schedule_hours")
def _(p):
    return kpi.offline_dedup_hours(p.status)


@query("fleet_mean_oee", f"""
SELECT count(*) AS machines, avg(A*P*Q) AS mean_oee FROM (SELECT *, {kpis(*COMP)} FROM (
  SELECT machine, {', '.join(f'sum({c})::DOUBLE AS {c}' for c in COMP)} FROM o_base WHERE level=1 GROUP BY machine)
  WHERE UnPlannedStop > 0 AND machine IN (SELECT name FROM o_master WHERE has_telemetry))""", "mean_oee")
def _(p):
    return kpi.fleet_mean_oee(kpi.machine_rollup(views.baseline(p)), views.master(p))
