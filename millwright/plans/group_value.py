"""What-if scenarios, finance, and the value chain of a stop predictor."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import oee as fx
from ..operators import kpi, value
from ..operators.scan import attach
from ..operators.value import Lever, Money, Prevention
from . import views
from .registry import query, rnd, rnd_even, shared
from .sqltext import COMP, kpis

C0 = {c: f"coalesce({c},0)::DOUBLE" for c in COMP}
SIDES = "bA bP bQ bOEE aA aP aQ aOEE"


def scenario_sql(src: str, keys: str, kind: str, pct: float, abs_ms: str = "NULL", cat: str = "NULL", scrap: float = 0.0) -> str:
    """Before / after KPI columns of one lever, straight from its definition."""
    b, a = dict(C0), dict(C0)
    room = f"CASE WHEN {cat} IS NULL THEN {C0['UnPlannedStop']} ELSE least({C0['UnPlannedStop']}, greatest(0, {cat})) END"
    shift = f"least(greatest(0, coalesce({abs_ms}, {pct}::DOUBLE*({room}))), {room})"
    if kind in ("W1", "W3"):
        a["UnPlannedStop"] = f"greatest(0, {C0['UnPlannedStop']} - {shift})"
    elif kind == "W2":
        a["UnPlannedStop"], a["PlannedStop"] = f"{C0['UnPlannedStop']} - {shift}", f"{C0['PlannedStop']} + {shift}"
    elif kind == "W4":
        wk, pt, pr, f = C0["WorkingTime"], C0["PlannedTime"], C0["ProductSum"], f"(1 + {pct}::DOUBLE)"
        a["WorkingTime"] = f"CASE WHEN {pr} > 0 THEN CASE WHEN {pt} > 0 THEN least({wk}*{f}, {pt}) ELSE {wk}*{f} END ELSE {wk} END"
        a["ProductSum"] = f"CASE WHEN {pr} > 0 THEN {pr}*{f} ELSE {pr} END"
    elif kind == "W5":
        b["ScrapeSum"] = f"{scrap}::DOUBLE*{C0['ProductSum']}"
        a["ScrapeSum"] = f"{scrap}::DOUBLE*{C0['ProductSum']}*(1 - {pct}::DOUBLE)"
    rt = "greatest(0, ({}) - ({}) - ({}))"
    names = ("WorkTotal", "PlannedStop", "UnPlannedStop")
    return f"""
SELECT *, recovered/nullif(CASE WHEN prod_b > 0 THEN work_b/prod_b END, 0) AS by_cycle,
  greatest(0, coalesce(recovered/nullif(CASE WHEN prod_b > 0 THEN work_b/prod_b END, 0), prod_a - prod_b)) AS extra_pieces FROM (
  SELECT *, bA*bP*bQ AS bOEE, aA*aP*aQ AS aOEE, rt_a - rt_b AS recovered FROM (
    SELECT {keys}, {kpis(*[b[c] for c in COMP], p='b')}, {kpis(*[a[c] for c in COMP], p='a')},
      {rt.format(*[b[c] for c in names])} AS rt_b, {rt.format(*[a[c] for c in names])} AS rt_a,
      {b['WorkingTime']} AS work_b, {b['ProductSum']} AS prod_b, {a['ProductSum']} AS prod_a FROM {src}))"""


def _delta(x: str) -> str:
    return f"{rnd(f'a{x}', 8)} - {rnd(f'b{x}', 8)}"


DELTAS = ", ".join(f"{rnd(f'a{k} - b{k}', 4)} AS d{k}" for k in ("OEE", "A", "P", "Q"))
DCOLS = "dOEE dA dP dQ"
shared("o_day", "SELECT * FROM o_base WHERE level=1")
LEVERS = {
    "scenario_w1": Lever("W1", 0.30), "scenario_w2": Lever("W2", 0.9, abs_ms=8 * 3.6e6),
    "scenario_w3": Lever("W3", 0.5, abs_ms=2 * 3.6e6), "scenario_w4": Lever("W4", 0.10), "scenario_w5": Lever("W5", 0.5, scrap_pct=0.05),
}


def _lever_sql(v: Lever, cat: str = "NULL") -> str:
    return scenario_sql("o_day", "machine, date", v.kind, v.pct, "NULL" if v.abs_ms is None else f"{v.abs_ms}::DOUBLE", cat, v.scrap_pct)


def _flat(s):
    names = ("A", "P", "Q", "OEE")
    return s.select(
        "machine", "date", *[F.col(f"before.{n}").alias(f"b{n}") for n in names], *[F.col(f"after.{n}").alias(f"a{n}") for n in names],
        "dOEE", "dA", "dP", "dQ", (F.col("recovered_ms") / 3.6e6).alias("recovered_h"), "extra_pieces",
    )


def _register(name: str, v: Lever) -> None:
    @query(name, f"SELECT machine, date, {SIDES.replace(' ', ', ')}, {DELTAS}, recovered/3600000 AS recovered_h, extra_pieces FROM ({_lever_sql(v)})",
           f"{SIDES} {DCOLS} recovered_h extra_pieces")
    def _(p):
        return _flat(value.run_scenarios(views.baseline(p), [v]))


for _n, _v in LEVERS.items():
    _register(_n, _v)

shared("o_cat", "SELECT machine, sum(duration_ms) AS cat_ms FROM o_stops WHERE category='UNPLANNED_RUNSTOP' AND label='Undefined Stoppage' GROUP BY 1")
shared("o_daycat", "SELECT b.*, c.cat_ms FROM o_day b LEFT JOIN o_cat c USING (machine)")


@query("scenario_run", f"""
SELECT machine, date, {SIDES.replace(' ', ', ')}, {DELTAS}, recovered/3600000 AS recovered_h, extra_pieces FROM ({scenario_sql('o_daycat', 'machine, date', 'W1', 0.8, 'NULL', 'cat_ms')})""",
    f"{SIDES} {DCOLS} recovered_h extra_pieces")
def _(p):
    s = views.stops(p).where("category = 'UNPLANNED_RUNSTOP' AND label = 'Undefined Stoppage'")
    cat = s.groupBy("machine").agg(F.sum("duration_ms").alias("cat_ms"))
    rows = views.baseline(p).join(cat, "machine", "left")
    return _flat(value.run_scenarios(rows, [Lever("W1", 0.8)], F.col("cat_ms")))


_RANGE = [Lever("W1", 0.30, name="cut"), Lever("W2", 0.5, name="replan"), Lever("W4", 0.10, name="faster"), Lever("W5", 0.5, scrap_pct=0.05, name="scrap")]


def _large_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT machine, trans_date, '{v.name}' AS scenario, bOEE, aOEE, {DELTAS}, recovered/3600000 AS recovered_h, extra_pieces "
        f"FROM ({scenario_sql('fx_oee_large', 'machine, trans_date', v.kind, v.pct, 'NULL', 'NULL', v.scrap_pct)})" for v in _RANGE)


@query("scenario_range", _large_sql(), f"bOEE aOEE {DCOLS} recovered_h extra_pieces")
def _(p):
    s = value.run_scenarios(p.oee_large, _RANGE)
    return s.select(
        "machine", "trans_date", F.col("lever.name").alias("scenario"), F.col("before.OEE").alias("bOEE"), F.col("after.OEE").alias("aOEE"),
        "dOEE", "dA", "dP", "dQ", (F.col("recovered_ms") / 3.6e6).alias("recovered_h"), "extra_pieces",
    )


@query("portfolio_impact", f"""
SELECT 'cut' AS scenario, count(*) AS machine_days, sum(recovered)/3600000 AS recovered_h, sum(extra_pieces) AS extra_pieces,
  avg({rnd('aOEE - bOEE', 4)})*100 AS mean_doee_pp, sum(extra_pieces)*12 AS gross FROM ({_lever_sql(Lever('W1', 0.30))})""", "recovered_h extra_pieces mean_doee_pp gross")
def _(p):
    return value.portfolio_impact(value.run_scenarios(views.baseline(p), [Lever("W1", 0.30, name="cut")]), Money())


# ------------------------------------------------------------ decomposition

_DEC = f"""SELECT machine, date, {SIDES.replace(' ', ', ')}, (aA-bA)*bP*bQ AS da, aA*(aP-bP)*bQ AS dp, aA*aP*(aQ-bQ) AS dq, aOEE-bOEE AS tot FROM ({_lever_sql(Lever('W1', 0.5))})"""


@query("oee_decompose", f"""
SELECT machine, date, {rnd('da', 5)} AS "dA_contrib", {rnd('dp', 5)} AS "dP_contrib", {rnd('dq', 5)} AS "dQ_contrib", {rnd('tot', 5)} AS total, {rnd('tot-(da+dp+dq)', 6)} AS residual
FROM ({_DEC})""", "dA_contrib dP_contrib dQ_contrib total residual")
def _(p):
    d = value.decompose(value.run_scenarios(views.baseline(p), [Lever("W1", 0.5)]))
    return d.select("machine", "date", "dA_contrib", "dP_contrib", "dQ_contrib", "total", "residual")


@query("oee_waterfall", f"""
SELECT machine, date, unnest([0,1,2,3,4]) AS step, unnest(['Baseline OEE','dA','dP','dQ','Scenario OEE']) AS label,
  unnest([{rnd('bOEE', 4)}, {rnd('da', 5)}, {rnd('dp', 5)}, {rnd('dq', 5)}, {rnd('aOEE', 4)}]) AS value FROM ({_DEC})""", "value")
def _(p):
    return value.waterfall(value.decompose(value.run_scenarios(views.baseline(p), [Lever("W1", 0.5)])), ["machine", "date"])


# ------------------------------------------------------------ finance


def _fin_sql(src: str, per: str, days: str) -> str:
    return f"""SELECT *, {rnd('recovered/3600000', 3)} AS recovered_hours, {rnd(f'{per}*30/greatest({days},1)', 2)} AS gross_benefit,
  {rnd(f'{per}*30/greatest({days},1) - 300', 2)} AS net_benefit, CASE WHEN {per} > 0 THEN {rnd(f'300.0::DOUBLE/nullif({per},0)', 2)} END AS payback_days,
  {rnd(f'({per}*30/greatest({days},1) - 300)/300', 2)} AS roi FROM ({src})"""


@query("financials", f"""
SELECT machine, date, recovered_hours, gross_benefit, net_benefit, payback_days, roi FROM ({_fin_sql(_lever_sql(Lever('W1', 0.30)), '(extra_pieces*12)', '1')})""",
    "recovered_hours gross_benefit net_benefit payback_days roi")
def _(p):
    f = value.financials(value.run_scenarios(views.baseline(p), [Lever("W1", 0.30)]), Money())
    return f.select("machine", "date", "recovered_hours", "gross_benefit", "net_benefit", "payback_days", "roi")


shared("o_roll", f"""
SELECT machine, {', '.join(f'sum({c})::DOUBLE AS {c}' for c in COMP)}, CAST(greatest(1, date_diff('day', min(date), max(date)) + 1) AS INTEGER) AS period_days
FROM o_base WHERE level=1 GROUP BY machine""")
shared("o_rolltop", """
SELECT r.*, t.reason, t.hours*3600000 AS cat_ms FROM o_roll r JOIN (SELECT machine, display_text AS reason, sum(duration_milliseconds)/3600000 AS hours FROM fx_stops
  WHERE NOT is_planned AND NOT regexp_matches(display_text, 'Offline|Connect', 'i') GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY machine ORDER BY hours DESC, reason) = 1) t USING (machine)""")
_CAT_OUT = f"{DCOLS} runtime_h schedule_h extra_pieces gross_benefit net_benefit roi payback_days"


def _catalog_part(name: str, scope: str, src: str) -> str:
    return f"""SELECT '{name}' AS scenario, machine, {scope} AS scope, period_days, {', '.join(f"{rnd(f'a{k} - b{k}', 4)} AS d{k}" for k in ('A', 'P', 'Q', 'OEE'))},
  recovered_hours AS runtime_h, 0.0::DOUBLE AS schedule_h, {rnd('extra_pieces', 1)} AS extra_pieces, gross_benefit, net_benefit, roi, payback_days
  FROM ({_fin_sql(src, '(recovered/3600000*80)', 'period_days')})"""


@query("scenario_catalog", f"""
{_catalog_part('top_reason', 'reason', scenario_sql('o_rolltop', 'machine, reason, period_days', 'W1', 0.30, 'NULL', 'cat_ms'))}
UNION ALL {_catalog_part('cycle', "'whole period'", scenario_sql('o_roll', 'machine, period_days', 'W4', 0.10))}
UNION ALL SELECT 'connectivity', 'PLANT', count(*) || ' distinct outages', NULL, 0, 0, 0, 0, 0, {rnd('sum(duration_milliseconds)/3600000', 3)}, 0, 0, 0, NULL, NULL
FROM (SELECT DISTINCT instance_id, started_on, ended_on, duration_milliseconds FROM fx_status WHERE NOT is_online)""", _CAT_OUT)
def _(p):
    money = Money(value_time_as="downtime_cost")
    return value.scenario_catalog(kpi.machine_rollup(views.baseline(p)), kpi.downtime_pareto(p.stops), p.status, money)


# ------------------------------------------------------------ predictor value
shared("o_win", """
SELECT machine, min(ts) AS a, max(ts) + INTERVAL 60 MINUTE AS b, epoch_us(max(ts) + INTERVAL 60 MINUTE - min(ts))/86400000000.0::DOUBLE AS days FROM fx_scored GROUP BY 1""")
_FRAC = """least(greatest(epoch_us(least(d.trans_date + INTERVAL 1 DAY, w.b) - greatest(d.trans_date, w.a))/86400000000.0::DOUBLE, 0), 1)"""
shared("o_pro", f"""
SELECT w.machine, w.a, w.b, w.days, {', '.join(f'coalesce(sum(d.{c}*{_FRAC}), 0)::DOUBLE AS {c}' for c in COMP)} FROM o_win w LEFT JOIN o_day d ON d.machine=w.machine GROUP BY 1,2,3,4""")


_MS = [c for c in COMP if not c.endswith("Sum")]


@query("oee_proration", f"""
SELECT machine, scope_start, scope_end, {', '.join(f'{c}/3600000 AS {c}' for c in _MS)}, "ProductSum", "ScrapeSum", A, P, Q, A*P*Q AS OEE FROM (
  SELECT machine, a AS scope_start, b AS scope_end, {', '.join(COMP)}, {kpis(*COMP)} FROM o_pro)""", " ".join(COMP) + " A P Q OEE")
def _(p):
    w = kpi.prorate(views.baseline(p), value.scored_windows(p.scored))
    for c in _MS:
        w = w.withColumn(c, F.col(c) / 3.6e6)
    return w


def _attr(src: str, keys: str, hours: str) -> str:
    """Applied hours and KPI change of prevented downtime."""
    return scenario_sql(f"(SELECT *, least(greatest(0, {hours}), greatest(0, UnPlannedStop)/3600000) AS app FROM {src})", keys + ", app", "W1", 0.0, "app*3600000", "app*3600000")


@query("attributable_oee", f"""
SELECT machine, date, app AS applied_h, {SIDES.replace(' ', ', ')}, {DELTAS} FROM ({_attr('o_day', 'machine, date', '1.5::DOUBLE')})""", f"applied_h {SIDES} {DCOLS}")
def _(p):
    o = value.attributable_oee(views.baseline(p), F.lit(1.5), ["machine", "date"])
    for k in ("A", "P", "Q", "OEE"):
        o = o.withColumnRenamed(f"{k}_before", f"b{k}").withColumnRenamed(f"{k}_after", f"a{k}")
    return o


def _money_sql(h: str, ep: str, days: str) -> str:
    g, c, f = f"({h}*80)", f"({ep}*300.0::DOUBLE)", f"(365.0::DOUBLE/greatest({days}, 1e-9::DOUBLE))"
    return f"""{rnd(g, 2)} AS gross, {rnd(c, 2)} AS intervention, {rnd(f'{g}-{c}', 2)} AS net, CASE WHEN {c} > 0 THEN {rnd(f'({g}-{c})/nullif({c},0)', 4)} END AS roi,
  {rnd(f, 6)} AS annual_factor, {rnd(f'{h}*{f}', 3)} AS annual_prevented_h, {rnd(f'{g}*{f}', 2)} AS annual_gross, {rnd(f'{c}*{f}', 2)} AS annual_intervention, {rnd(f'({g}-{c})*{f}', 2)} AS annual_net"""


MONEY = "gross intervention net roi annual_factor annual_prevented_h annual_gross annual_intervention annual_net"


@query("financial_projection", f"""
SELECT machine, {_money_sql('h', 'ep', 'days')} FROM (SELECT s.machine, w.days, sum(s.duration_ms)/3600000 AS h, count(*) AS ep FROM o_scope s JOIN o_win w USING (machine) GROUP BY 1,2)""", MONEY)
def _(p):
    w = value.scored_windows(p.scored)
    s = value.scope_stops(views.significant(p), w).groupBy("machine").agg((F.sum("duration_ms") / 3.6e6).alias("h"), F.count(F.lit(1)).alias("ep"))
    fin = value.projection(F.col("h"), F.col("ep"), F.col("observed_days"), Money())
    return s.join(w, "machine").select("machine", *[v.alias(n) for n, v in fin.items()])


shared("o_th", "SELECT i/50.0::DOUBLE AS th FROM range(51) t(i) UNION SELECT 0.75::DOUBLE")
shared("o_thep", """
SELECT th, machine, count(*) AS episodes, count(*) FILTER (hit) AS hits FROM (
  SELECT i.th, i.machine, i.s, i.b - i.a + 1 AS n, (SELECT max(r.y) FROM o_all_rn r WHERE r.machine=i.machine AND r.rn BETWEEN i.a AND i.b) = 1 AS hit FROM (
    SELECT th, machine, s, min(rn) AS a, max(rn) AS b FROM (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts - prev) > 1200000000 THEN 1 ELSE 0 END)
      OVER (PARTITION BY th, machine ORDER BY rn) AS s FROM (SELECT t.th, r.machine, r.rn, r.ts, lag(r.ts) OVER (PARTITION BY t.th, r.machine ORDER BY r.rn) AS prev
      FROM o_all_rn r JOIN o_th t ON r.risk >= t.th)) GROUP BY 1,2,3) i WHERE i.b - i.a + 1 >= 3) GROUP BY 1,2""")
_SRC = f"""(SELECT t.th, w.machine, w.a, w.b, w.days, {', '.join('p.' + c for c in COMP)}, coalesce(s.n,0) AS stops, coalesce(s.tot,0) AS tot, coalesce(s.caught,0) AS caught, coalesce(s.ch,0) AS ch,
  coalesce(e.episodes,0) AS ep, coalesce(e.hits,0) AS hits FROM o_th t, o_win w JOIN o_pro p ON p.machine=w.machine
  LEFT JOIN (SELECT x.th, m.machine, count(*) AS n, sum(m.duration_ms)/3600000 AS tot, count(*) FILTER (m.peak >= x.th) AS caught, sum(m.duration_ms) FILTER (m.peak >= x.th)/3600000 AS ch
    FROM o_match m, o_th x GROUP BY 1,2) s ON s.th=t.th AND s.machine=w.machine LEFT JOIN o_thep e ON e.th=t.th AND e.machine=w.machine)"""
shared("o_points", f"""
SELECT * FROM ({_attr(_SRC, 'th, machine, a, b, days, stops, tot, caught, ch, ep, hits, ' + ', '.join(COMP), 'ch*0.35::DOUBLE')})""")
_POINT = f"""{rnd_even('days', 4)} AS observed_days, stops AS significant_stops, caught AS caught_stops, {rnd_even('caught::DOUBLE/nullif(stops,0)', 4)} AS recall"""


@query("operating_point", f"""
SELECT machine, {_POINT}, {rnd_even('tot', 3)} AS total_downtime_h, {rnd_even('ch', 3)} AS caught_downtime_h, {rnd_even('app', 3)} AS prevented_h, ep AS episodes, hits AS episode_hits,
  ep - hits AS false_alarm_episodes, {rnd_even('hits::DOUBLE/nullif(ep,0)', 4)} AS episode_precision, {DELTAS}, {_money_sql('app', 'ep', 'days')} FROM o_points WHERE th=0.75""",
    f"observed_days recall total_downtime_h caught_downtime_h prevented_h episode_precision {DCOLS} {MONEY}")
def _(p):
    o = value.operating_points(p.scored, views.significant(p), views.baseline(p), 0.75, ties=("event_id",))
    return o.select(
        "machine", "observed_days", "significant_stops", "caught_stops", "recall", "total_downtime_h", "caught_downtime_h", "prevented_h",
        "episodes", "episode_hits", "false_alarm_episodes", "episode_precision", *DCOLS.split(), *MONEY.split(),
    )


shared("o_port", f"""
SELECT * FROM ({_attr(f'''(SELECT th, CAST(sum(stops) AS BIGINT) AS stops, CAST(sum(caught) AS BIGINT) AS caught, CAST(sum(ep) AS BIGINT) AS ep, CAST(sum(hits) AS BIGINT) AS hits,
  sum({rnd_even('ch', 3)}) AS ch, sum({rnd_even('app', 3)}) AS req, epoch_us(max(b) - min(a))/86400000000.0::DOUBLE AS days, {', '.join(f'sum({c}) AS {c}' for c in COMP)} FROM o_points GROUP BY th)''',
  'th, stops, caught, ep, hits, ch, days, ' + ', '.join(COMP), 'req')})""")
_PORT = f"""SELECT th AS threshold, {_POINT}, {rnd_even('ch', 3)} AS caught_downtime_h, {rnd_even('app', 3)} AS prevented_h, ep AS episodes, hits AS episode_hits, ep - hits AS false_alarm_episodes,
  {rnd_even('hits::DOUBLE/nullif(ep,0)', 4)} AS episode_precision, {rnd('aOEE - bOEE', 4)} AS delta_oee, {_money_sql('app', 'ep', 'days')} FROM o_port"""
_PORT_D = f"threshold observed_days recall caught_downtime_h prevented_h episode_precision delta_oee {MONEY}"


@query("operating_point_portfolio", _PORT + " WHERE th=0.75", _PORT_D)
def _(p):
    o = value.operating_points(p.scored, views.significant(p), views.baseline(p), 0.75, ties=("event_id",))
    return value.portfolio_points(o).drop(*fx.COMPONENTS)


@query("threshold_sweep", f"""
SELECT *, threshold = (SELECT arg_max(threshold, (annual_net, threshold)) FROM ({_PORT})) AS is_optimum FROM ({_PORT})""", _PORT_D)
def _(p):
    return value.threshold_sweep(p.scored, views.significant(p), views.baseline(p), 0.75, ties=("event_id",))


@query("effectiveness_slider", f"""
SELECT eff AS effectiveness, app AS prevented_h, aA - bA AS delta_a, aOEE - bOEE AS delta_oee, app*100 AS gross, ep*250.0::DOUBLE AS intervention, app*100 - ep*250.0::DOUBLE AS net,
  (app*100 - ep*250.0::DOUBLE)/(ep*250.0::DOUBLE) AS roi, (app*100 - ep*250.0::DOUBLE)*365/days AS annual_net FROM (
  {_attr(f'''(SELECT e.eff, p.ep, {rnd_even('p.days', 4)} AS days, {rnd_even('p.ch', 3)} AS ch, {', '.join('p.' + c for c in COMP)} FROM o_port p, (VALUES (0.1::DOUBLE),(0.35::DOUBLE),(0.6::DOUBLE),(1.0::DOUBLE)) e(eff) WHERE p.th=0.75)''',
  'eff, ep, days', 'ch*eff')})""", "effectiveness prevented_h delta_a delta_oee gross intervention net roi annual_net")
def _(p):
    o = value.operating_points(p.scored, views.significant(p), views.baseline(p), 0.75, ties=("event_id",))
    return value.effectiveness_slider(value.portfolio_points(o), [0.1, 0.35, 0.6, 1.0], 100.0, 250.0)


@query("assumption_rows", """
SELECT a.scope, a.name, a.value, a.label, (SELECT count(*) FROM fx_scored) AS scored_rows FROM (VALUES """ + ", ".join(
    f"('{s}','{k}','{v}','{value.ASSUMPTION_LABEL}')" for s, d in (("money", vars(Money())), ("prevention", vars(Prevention()))) for k, v in d.items()) + """) a(scope, name, value, label)""")
def _(p):
    """Assumptions stamped on the scored rows they are applied to."""
    n = p.scored.agg(F.count(F.lit(1)).alias("scored_rows"))
    return attach(value.assumption_rows(p.spark, Money(), Prevention()), n)
