"""SQL fragments the oracles share, spelled out for DuckDB."""

from __future__ import annotations

from ..functions import rules
from .registry import shared


def case_regex(col: str, table, default: str, flags: str = "") -> str:
    f = f", '{flags}'" if flags else ""
    whens = " ".join(f"WHEN regexp_matches({col}, '{p}'{f}) THEN '{label}'" for p, label in table)
    return f"CASE {whens} ELSE '{default}' END"


def case_map(col: str, table, default) -> str:
    def q(v):
        return f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)

    whens = " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in table.items())
    return f"CASE {col} {whens} ELSE {'NULL' if default is None else q(default)} END"


def words(col: str, ws) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in ws) + ")"


def stop_category(text: str, planned: str) -> str:
    t = f"lower(coalesce({text},''))"
    return f"""CASE WHEN {words(t, rules.OFFLINE_WORDS)} THEN 'CONNECTIVITY'
      WHEN {words(t, rules.WAITING_WORDS)} THEN 'WAITING_WORK'
      WHEN {words(t, rules.PLANNED_WORDS)} THEN 'PLANNED_BREAK'
      WHEN {planned} THEN 'PLANNED_BREAK'
      WHEN {words(t, rules.UNPLANNED_WORDS)} THEN 'UNPLANNED_RUNSTOP'
      WHEN NOT {planned} THEN 'UNPLANNED_RUNSTOP' ELSE 'OTHER' END"""


def kpis(wt, ps, us, wk, pt, pr, sc, p="") -> str:
    """A, P, Q (as columns p||A ...) of component expressions."""
    return f"""
      least(greatest(CASE WHEN ({wt})-({ps}) > 0 THEN (({wt})-({ps})-({us}))::DOUBLE/(({wt})-({ps})) ELSE 0 END, 0), 1)::DOUBLE AS {p}A,
      least(greatest(CASE WHEN ({pt}) > 0 AND ({pr}) > 0 THEN ({wk})::DOUBLE/({pt}) ELSE 0 END, 0), 1)::DOUBLE AS {p}P,
      least(greatest(CASE WHEN ({pr}) > 0 THEN (({pr})-({sc}))::DOUBLE/({pr}) ELSE 1 END, 0), 1)::DOUBLE AS {p}Q"""


COMP = ["WorkTotal", "PlannedStop", "UnPlannedStop", "WorkingTime", "PlannedTime", "ProductSum", "ScrapeSum"]

shared("o_master", f"""
SELECT u.uid AS unit_uid, u.name, {case_map('d.collector_type_name', rules.VENDORS, None)} AS vendor,
  d.collector_type_name, u.is_enabled, n.id AS monitor_unit_id, n.id IS NOT NULL AS has_telemetry
FROM fx_unit u LEFT JOIN fx_device d ON d.uid=u.device_uid LEFT JOIN fx_monitor_unit n ON n.unit_uid=u.uid""")

shared("o_signals", f"""
SELECT r.readingdef_uid, m.name AS machine, m.vendor, r.readingdef_name,
  {case_regex('r.readingdef_name', rules.SIGNAL_ROLES, 'other', 'i')} AS canonical_role,
  t.txt AS mes_display_text, t.txt IS NOT NULL AS matched_mes, n.unit_uid, r.unit_id
FROM fx_monitor_reading_def r LEFT JOIN fx_monitor_unit n ON n.id=r.unit_id
LEFT JOIN o_master m ON m.unit_uid=n.unit_uid
LEFT JOIN (SELECT uid, min(display_text) AS txt FROM fx_mes_reading_def GROUP BY uid) t ON t.uid=r.readingdef_uid""")

shared("o_roles", f"""
SELECT readingdef_uid, min(machine) AS machine, min(canonical_role) AS canonical_role FROM o_signals
WHERE canonical_role IN ({', '.join(repr(r) for r in rules.FEATURE_ROLES)}) GROUP BY readingdef_uid""")

shared("o_inst", """
SELECT machine, arg_min(instance_id, (-n, instance_id)) AS instance_id, min(unit_uid) AS unit_uid FROM (
  SELECT m.name AS machine, r.instance_id, count(*) AS n, min(m.unit_uid) AS unit_uid
  FROM fx_mes_reading_def r JOIN o_master m ON m.unit_uid=r.unit_uid GROUP BY 1,2) GROUP BY machine""")

shared("o_stops", f"""
SELECT machine, unit_uid, 'stoppage' AS source, {stop_category('display_text','is_planned')} AS category,
  display_text AS label, started_on AS start_ts, ended_on AS end_ts,
  least(duration_milliseconds, 86400000.0::DOUBLE) AS duration_ms, is_planned,
  duration_milliseconds > 86400000 AS clipped
FROM fx_stops WHERE started_on IS NOT NULL""")

shared("o_alerts", f"""
SELECT machine, unit_uid, 'alert' AS source,
  {case_regex('upper(value)', rules.ALARM_CATEGORIES, 'OTHER_ALARM')} AS category,
  trim(value) AS label, started_on AS start_ts, CAST(NULL AS TIMESTAMP) AS end_ts, duration_milliseconds AS duration_ms,
  index, is_array FROM fx_alerts""")

shared("o_offline", """
SELECT i.machine, i.unit_uid, 'offline' AS source, 'CONNECTIVITY' AS category, 'System Offline' AS label,
  s.started_on AS start_ts, s.ended_on AS end_ts, s.duration_milliseconds AS duration_ms, s.instance_id,
  (SELECT count(*) FROM o_inst j WHERE j.instance_id=s.instance_id) > 1 AS systemic
FROM fx_status s JOIN o_inst i ON i.instance_id=s.instance_id WHERE NOT s.is_online""")

shared("o_base", f"""
SELECT u.name AS machine, o.unit_uid, CAST(o.trans_date AS DATE) AS date, o.trans_date, o.level, o.oee AS oee_stored,
  CAST(o.availability->>'A' AS DOUBLE) AS a_stored, c.*, c.A*c.P*c.Q AS OEE FROM (
  SELECT *, {kpis('WorkTotal','PlannedStop','UnPlannedStop','WorkingTime','PlannedTime','ProductSum','ScrapeSum')}
  FROM (SELECT unit_uid AS uu, trans_date AS td,
    {', '.join(f"CAST({j}->>'{c}' AS DOUBLE) AS {c}" for c, j in zip(COMP, ['availability']*3+['performance']*2+['quality']*2))}
    FROM fx_oee_daily)) c
JOIN fx_oee_daily o ON o.unit_uid=c.uu AND o.trans_date=c.td LEFT JOIN fx_unit u ON u.uid=o.unit_uid""")
