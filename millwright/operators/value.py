"""What-if scenarios over many rows, finance, and the value chain of a stop predictor."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import oee as fx
from ..functions.timex import MS_PER_HOUR, US_PER_DAY, US_PER_MIN, clamp, half_even, half_up, us
from .kpi import prorate
from .scan import range_max
from .sessions import risk_episodes

ASSUMPTION_LABEL = "Entered by the user, not measured; results in currency are only as good as this entry."


@dataclass(frozen=True)
class Money:
    """Assumed prices; recovered time is valued once, as margin or as downtime cost."""

    margin_per_piece: float = 12.0
    machine_hour_cost: float = 45.0
    downtime_cost_per_hour: float = 80.0
    scrap_cost_per_piece: float = 18.0
    intervention_cost: float = 300.0
    horizon_days: int = 30
    currency: str = "EUR"
    value_time_as: str = "margin"


@dataclass(frozen=True)
class Prevention:
    effectiveness: float = 0.35
    horizon_min: int = 60
    annual_days: int = 365


@dataclass(frozen=True)
class Lever:
    """One what-if lever. W1/W3 cut unplanned stops, W2 reclassifies them, W4 speeds up, W5 reduces scrap."""

    kind: str
    pct: float = 0.0
    abs_ms: float | None = None
    scrap_pct: float = 0.0
    name: str = ""

    def __post_init__(self):
        if self.kind not in ("W1", "W2", "W3", "W4", "W5"):
            raise ValueError(f"unknown lever {self.kind!r}")


def _num(v: float | None) -> Column:
    return F.lit(None if v is None else float(v)).cast("double")


def run_scenarios(components: DataFrame, levers: Sequence[Lever], category_ms: Column | None = None) -> DataFrame:
    """Every lever on every component row: before, after, change, recovered runtime and extra pieces.

    The levers are constants exploded next to each row in one narrow projection; nothing is shuffled.
    """
    spec = F.array(*[
        F.struct(
            F.lit(v.name or v.kind).alias("name"), F.lit(v.kind).alias("kind"), _num(v.pct).alias("pct"),
            _num(v.abs_ms).alias("abs_ms"), _num(v.scrap_pct).alias("scrap_pct"),
        )
        for v in levers
    ])
    rows = components.withColumn("lever", F.explode(spec))
    cat = category_ms if category_ms is not None else F.lit(None).cast("double")
    b, a = fx.scenario(
        fx.cols(), F.col("lever.kind"), F.col("lever.pct"), F.col("lever.abs_ms"), cat, F.col("lever.scrap_pct")
    )

    def side(c):
        k = fx.kpis(c)
        return F.struct(
            *[v.alias(n) for n, v in k.items()], fx.runtime_ms(c).alias("runtime_ms"), *[c[n].alias(n) for n in fx.COMPONENTS]
        )

    keep = [c for c in components.columns if c not in fx.COMPONENTS]
    s = rows.select(*keep, "lever", side(b).alias("before"), side(a).alias("after"))
    recovered = F.col("after.runtime_ms") - F.col("before.runtime_ms")
    prod = F.col("before.ProductSum")
    cycle = F.when(prod > 0, F.col("before.WorkingTime") / prod)
    gained = F.when(cycle != 0, recovered / cycle).otherwise(F.col("after.ProductSum") - prod)
    note = F.when((F.col("lever.kind") == "W4") & (prod <= 0), "P lever INERT: ProductSum=0 (no production this scope)")
    return s.select(
        "*", *[half_up(F.col(f"after.{k}") - F.col(f"before.{k}"), 4).alias(f"d{k}") for k in ("OEE", "A", "P", "Q")],
        recovered.alias("recovered_ms"), F.greatest(F.lit(0.0), gained).alias("extra_pieces"), note.alias("note"),
    )


def decompose(scenarios: DataFrame) -> DataFrame:
    """Exact split of the OEE change into its A, P and Q parts."""
    names = ("A", "P", "Q", "OEE")
    b, a = ({n: F.col(f"{side}.{n}") for n in names} for side in ("before", "after"))
    return scenarios.select("*", *[v.alias(n) for n, v in fx.decompose(b, a).items()])


def waterfall(decomposed: DataFrame, keys: Sequence[str]) -> DataFrame:
    steps = [
        ("Baseline OEE", half_up(F.col("before.OEE"), 4)), ("dA", F.col("dA_contrib")), ("dP", F.col("dP_contrib")),
        ("dQ", F.col("dQ_contrib")), ("Scenario OEE", half_up(F.col("after.OEE"), 4)),
    ]
    arr = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("label"), v.alias("value")) for i, (n, v) in enumerate(steps)])
    return decomposed.select(*keys, F.explode(arr).alias("s")).select(*keys, "s.*")


def financials(scenarios: DataFrame, money: Money, period_days: Column | int = 1, scrap_pieces: Column | float = 0.0) -> DataFrame:
    """Gross, net, payback and return of each scenario row over the assumed horizon."""
    hours = F.col("recovered_ms") / MS_PER_HOUR
    margin = F.col("extra_pieces") * money.margin_per_piece
    saving = hours * money.downtime_cost_per_hour
    scrap = (scrap_pieces if isinstance(scrap_pieces, Column) else F.lit(scrap_pieces)) * money.scrap_cost_per_piece
    per = (margin if money.value_time_as == "margin" else saving) + scrap
    days = F.greatest(period_days if isinstance(period_days, Column) else F.lit(period_days), F.lit(1))
    gross = per * (F.lit(float(money.horizon_days)) / days)
    net = gross - money.intervention_cost
    cost = F.lit(money.intervention_cost)
    return scenarios.select(
        "*", half_up(hours, 3).alias("recovered_hours"), half_up(margin, 2).alias("margin_gain"),
        half_up(saving, 2).alias("downtime_saving"), half_up(gross, 2).alias("gross_benefit"),
        half_up(net, 2).alias("net_benefit"), half_up(F.when(per > 0, cost / per), 2).alias("payback_days"),
        half_up(F.when(cost > 0, net / cost), 2).alias("roi"),
    )


def portfolio_impact(scenarios: DataFrame, money: Money) -> DataFrame:
    pieces = F.sum("extra_pieces")
    return scenarios.groupBy(F.col("lever.name").alias("scenario")).agg(
        F.count(F.lit(1)).alias("machine_days"), (F.sum("recovered_ms") / MS_PER_HOUR).alias("recovered_h"),
        pieces.alias("extra_pieces"), (F.avg("dOEE") * 100).alias("mean_doee_pp"),
        (pieces * money.margin_per_piece).alias("gross"),
    )


# ---------------------------------------------------------------- predictor value


def scored_windows(scored: DataFrame, horizon_min: int = 60) -> DataFrame:
    """Scored interval of each machine, extended by the label horizon."""
    g = scored.groupBy("machine").agg(F.min("ts").alias("start"), F.max("ts").alias("score_end"))
    end = F.timestamp_micros(us("score_end") + horizon_min * US_PER_MIN)
    g = g.withColumn("end", end)
    return g.withColumn("observed_days", (us("end") - us("start")) / float(US_PER_DAY))


def scope_stops(stops: DataFrame, windows: DataFrame, machines: Sequence[str] | None = None) -> DataFrame:
    """Stops inside their machine's scored interval; clipped to a day first, then the longest per start is kept."""
    dur = clamp(F.col("duration_ms").try_cast("double"), 0.0, 24 * MS_PER_HOUR)
    s = stops.select("machine", "start", dur.alias("duration_ms"))
    if machines is not None:
        s = s.where(F.col("machine").isin(*machines))
    s = s.dropna(subset=["machine", "start", "duration_ms"])
    s = s.groupBy("machine", "start").agg(F.max("duration_ms").alias("duration_ms"))
    w = windows.select("machine", F.col("start").alias("ws"), F.col("end").alias("we"))
    return s.join(w, "machine").where("start > ws AND start <= we").drop("ws", "we")


def stop_peaks(scored: DataFrame, stops: DataFrame, horizon_min: int = 60) -> DataFrame:
    """Highest risk strictly inside (stop - horizon, stop), NULL when nothing was scored there."""
    return range_max(
        stops, scored, ["machine"], us("start"), us("ts"), F.col("risk").try_cast("double"),
        horizon_min * US_PER_MIN, strict=True, out="max_prior_risk",
    )


def match_stops(scored: DataFrame, stops: DataFrame, threshold: float, horizon_min: int = 60) -> DataFrame:
    peaks = stop_peaks(scored, stops, horizon_min)
    caught = F.coalesce(F.col("max_prior_risk") >= threshold, F.lit(False))
    return peaks.select("machine", "start", "duration_ms", caught.alias("caught"), "max_prior_risk")


def attributable_oee(components: DataFrame, prevented_h: Column, keep: Sequence[str] = ()) -> DataFrame:
    """W1 with the prevented hours, never more than the unplanned stop time of the row."""
    cap = F.greatest(F.lit(0.0), F.coalesce(F.col("UnPlannedStop"), F.lit(0.0))) / MS_PER_HOUR
    applied = F.least(F.greatest(F.lit(0.0), prevented_h), cap)
    rows = components.withColumn("applied_h", applied)
    ms = F.col("applied_h") * MS_PER_HOUR
    b, a = fx.scenario(fx.cols(), F.lit("W1"), F.lit(0.0), ms, ms, F.lit(0.0))
    kb, ka = fx.kpis(b), fx.kpis(a)
    return rows.select(
        *keep, "applied_h", *[kb[n].alias(f"{n}_before") for n in kb], *[ka[n].alias(f"{n}_after") for n in ka],
        *[half_up(ka[n] - kb[n], 4).alias(f"d{n}") for n in ka],
    )


def projection(prevented_h: Column, episodes: Column, observed_days: Column, money: Money, annual_days: int = 365) -> dict[str, Column]:
    """Observed and annualised value; every alert episode is charged, false alarms included."""
    days = F.greatest(observed_days, F.lit(1e-9))
    gross = prevented_h * money.downtime_cost_per_hour
    cost = episodes.cast("double") * money.intervention_cost
    net = gross - cost
    factor = F.lit(float(annual_days)) / days
    return {
        "gross": half_up(gross, 2), "intervention": half_up(cost, 2), "net": half_up(net, 2),
        "roi": half_up(F.when(cost > 0, net / cost), 4), "annual_factor": half_up(factor, 6),
        "annual_prevented_h": half_up(prevented_h * factor, 3), "annual_gross": half_up(gross * factor, 2),
        "annual_intervention": half_up(cost * factor, 2), "annual_net": half_up(net * factor, 2),
    }


def _machine_points(
    scored: DataFrame, stops: DataFrame, baseline: DataFrame, thresholds: Sequence[float], prevention: Prevention,
    ties: Sequence[str], episodes: DataFrame | None,
) -> DataFrame:
    """One row per (threshold, machine): stops, catches, episodes and prorated components."""
    levels = sorted({float(x) for x in thresholds})
    w = scored_windows(scored, prevention.horizon_min)
    peaks = stop_peaks(scored, scope_stops(stops, w), prevention.horizon_min)
    arr = F.array(*[F.lit(x) for x in levels])
    totals = peaks.groupBy("machine").agg(
        F.count(F.lit(1)).alias("stops"), (F.sum("duration_ms") / MS_PER_HOUR).alias("total_h")
    )
    hit = peaks.withColumn("threshold", F.explode(F.filter(arr, lambda x: x <= F.col("max_prior_risk"))))
    caught = hit.groupBy("threshold", "machine").agg(
        F.count(F.lit(1)).alias("caught"), (F.sum("duration_ms") / MS_PER_HOUR).alias("caught_h")
    )
    ep = episodes if episodes is not None else risk_episodes(scored, levels, ties=ties)
    ep = ep.groupBy("threshold", "machine").agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if("hit").alias("episode_hits")
    )
    comp = prorate(baseline, w).select("machine", *fx.COMPONENTS)
    base = w.select("machine", "start", "end", "observed_days").join(comp, "machine").join(totals, "machine", "left")
    base = base.withColumn("threshold", F.explode(arr))
    out = base.join(caught, ["threshold", "machine"], "left").join(ep, ["threshold", "machine"], "left")
    out = out.fillna(0, ["stops", "caught", "episodes", "episode_hits"]).fillna(0.0, ["total_h", "caught_h"])
    return out.withColumn("requested_h", F.col("caught_h") * prevention.effectiveness)


def operating_points(
    scored: DataFrame, stops: DataFrame, baseline: DataFrame, thresholds: float | Sequence[float],
    prevention: Prevention = Prevention(), money: Money = Money(value_time_as="downtime_cost"),
    ties: Sequence[str] = (), episodes: DataFrame | None = None,
) -> DataFrame:
    """Per machine: recall, alert cost, attributable OEE and value at each threshold."""
    levels = [thresholds] if isinstance(thresholds, (int, float)) else list(thresholds)
    m = _machine_points(scored, stops, baseline, levels, prevention, ties, episodes)
    keep = ["threshold", "machine", "start", "end", "observed_days", "stops", "total_h", "caught", "caught_h",
            "episodes", "episode_hits", *fx.COMPONENTS]
    o = attributable_oee(m, F.col("requested_h"), keep)
    fin = projection(F.col("applied_h"), F.col("episodes"), F.col("observed_days"), money, prevention.annual_days)
    return o.select(
        "threshold", "machine", half_even("observed_days", 4).alias("observed_days"), F.col("stops").alias("significant_stops"),
        F.col("caught").alias("caught_stops"), half_even(F.try_divide(F.col("caught"), F.col("stops")), 4).alias("recall"),
        half_even("total_h", 3).alias("total_downtime_h"), half_even("caught_h", 3).alias("caught_downtime_h"),
        half_even("applied_h", 3).alias("prevented_h"), "episodes", "episode_hits",
        (F.col("episodes") - F.col("episode_hits")).alias("false_alarm_episodes"),
        half_even(F.try_divide(F.col("episode_hits"), F.col("episodes")), 4).alias("episode_precision"),
        *[c for c in o.columns if c.endswith(("_before", "_after"))], "dOEE", "dA", "dP", "dQ",
        *[v.alias(n) for n, v in fin.items()], "start", "end", *fx.COMPONENTS,
    )


def portfolio_points(points: DataFrame, prevention: Prevention = Prevention(), money: Money = Money(value_time_as="downtime_cost")) -> DataFrame:
    """Plant totals per threshold, built from the machine rows as reported (hours already rounded)."""
    g = points.groupBy("threshold").agg(
        F.sum("significant_stops").alias("significant_stops"), F.sum("caught_stops").alias("caught_stops"),
        F.sum("episodes").alias("episodes"), F.sum("episode_hits").alias("episode_hits"),
        F.sum("caught_downtime_h").alias("caught_downtime_h"), F.sum("prevented_h").alias("req_h"),
        *[F.sum(c).alias(c) for c in fx.COMPONENTS], F.min("start").alias("t0"), F.max("end").alias("t1"),
    )
    g = g.withColumn("observed_days", (us("t1") - us("t0")) / float(US_PER_DAY))
    o = attributable_oee(g, F.col("req_h"), g.columns)
    fin = projection(F.col("applied_h"), F.col("episodes"), F.col("observed_days"), money, prevention.annual_days)
    return o.select(
        half_even("threshold", 6).alias("threshold"), half_even("observed_days", 4).alias("observed_days"),
        "significant_stops", "caught_stops",
        half_even(F.try_divide(F.col("caught_stops"), F.col("significant_stops")), 4).alias("recall"),
        half_even("caught_downtime_h", 3).alias("caught_downtime_h"), half_even("applied_h", 3).alias("prevented_h"),
        "episodes", "episode_hits", (F.col("episodes") - F.col("episode_hits")).alias("false_alarm_episodes"),
        half_even(F.try_divide(F.col("episode_hits"), F.col("episodes")), 4).alias("episode_precision"),
        F.col("dOEE").alias("delta_oee"), *[v.alias(n) for n, v in fin.items()], *fx.COMPONENTS,
    )


def sweep_levels(deployed: float, levels: Sequence[float] | None = None) -> list[float]:
    """51 evenly spaced thresholds (or the given ones) plus the deployed one."""
    base = [i / 50 for i in range(51)] if levels is None else [float(x) for x in levels]
    return sorted({*base, float(deployed)})


def threshold_sweep(
    scored: DataFrame, stops: DataFrame, baseline: DataFrame, deployed: float, *, levels: Sequence[float] | None = None,
    prevention: Prevention = Prevention(), money: Money = Money(value_time_as="downtime_cost"), ties: Sequence[str] = (),
) -> DataFrame:
    """All thresholds in one job; `is_optimum` marks the best annual net (ties: higher threshold)."""
    pts = operating_points(scored, stops, baseline, sweep_levels(deployed, levels), prevention, money, ties)
    rows = portfolio_points(pts, prevention, money)
    # one row per threshold is left: a bounded window finds the best of them
    everything = Window.partitionBy(F.lit(1))
    best = F.max(F.struct("annual_net", "threshold")).over(everything)
    return rows.drop(*fx.COMPONENTS).withColumn("is_optimum", F.col("threshold") == best["threshold"])


def effectiveness_slider(
    portfolio: DataFrame, effectiveness: Sequence[float], downtime_cost: float, intervention_cost: float,
    annual_days: int = 365,
) -> DataFrame:
    """Re-price one operating point for other assumptions; `portfolio` holds components and totals."""
    arr = F.array(*[F.lit(float(e)) for e in effectiveness])
    rows = portfolio.withColumn("effectiveness", F.explode(arr))
    want = F.col("caught_downtime_h") * F.col("effectiveness")
    keep = ["effectiveness", "episodes", "observed_days"]
    o = attributable_oee(rows, want, keep)
    gross = F.col("applied_h") * downtime_cost
    cost = F.col("episodes").cast("double") * intervention_cost
    factor = F.lit(float(annual_days)) / F.col("observed_days")
    return o.select(
        "effectiveness", F.col("applied_h").alias("prevented_h"), (F.col("A_after") - F.col("A_before")).alias("delta_a"),
        (F.col("OEE_after") - F.col("OEE_before")).alias("delta_oee"), gross.alias("gross"), cost.alias("intervention"),
        (gross - cost).alias("net"), F.when(cost > 0, (gross - cost) / cost).alias("roi"),
        ((gross - cost) * factor).alias("annual_net"),
    )


def assumption_rows(spark: SparkSession, money: Money, prevention: Prevention) -> DataFrame:
    """The assumptions behind every currency figure, one row each."""
    rows = [("money", k, str(v)) for k, v in asdict(money).items()]
    rows += [("prevention", k, str(v)) for k, v in asdict(prevention).items()]
    return spark.createDataFrame([(*r, ASSUMPTION_LABEL) for r in rows], "scope string, name string, value string, label string")


def scenario_catalog(rollup: DataFrame, pareto: DataFrame, status: DataFrame, money: Money) -> DataFrame:
    """Inspectable scenarios: each machine's top fault reason -30 %, cycle +10 %, and repaired connectivity.

    Connectivity recovers schedule visibility only, never machine OEE.
    """
    from ..functions import rules
    from .kpi import offline_dedup_hours, top_per_group

    faults = pareto.where(rules.reason_kind("reason") == "fault")
    top = top_per_group(faults, ["machine"], [F.col("hours").desc(), F.col("reason")], 1).select("machine", "reason", "hours")
    base = rollup.select("machine", "period_days", *fx.COMPONENTS)
    cut = run_scenarios(
        base.join(top, "machine"), [Lever("W1", 0.30, name="top_reason")], F.col("hours") * MS_PER_HOUR
    )
    fast = run_scenarios(base.withColumn("reason", F.lit("whole period")), [Lever("W4", 0.10, name="cycle")])
    cols = ["machine", "period_days", "reason", "lever", "before", "after", "dOEE", "dA", "dP", "dQ", "recovered_ms", "extra_pieces"]
    both = cut.select(*cols).unionByName(fast.select(*cols))
    priced = financials(both, money, F.col("period_days")).select(
        F.col("lever.name").alias("scenario"), "machine", F.col("reason").alias("scope"), "period_days",
        "dA", "dP", "dQ", "dOEE", F.col("recovered_hours").alias("runtime_h"), F.lit(0.0).alias("schedule_h"),
        half_up("extra_pieces", 1).alias("extra_pieces"), "gross_benefit", "net_benefit", "roi", "payback_days",
    )
    zero = F.lit(0.0)
    none = F.lit(None).cast("double")
    net = offline_dedup_hours(status).select(
        F.lit("connectivity").alias("scenario"), F.lit("PLANT").alias("machine"),
        F.concat(F.col("windows").cast("string"), F.lit(" distinct outages")).alias("scope"),
        F.lit(None).cast("int").alias("period_days"), zero.alias("dA"), zero.alias("dP"), zero.alias("dQ"), zero.alias("dOEE"),
        zero.alias("runtime_h"), half_up("schedule_hours", 3).alias("schedule_h"), zero.alias("extra_pieces"),
        zero.alias("gross_benefit"), zero.alias("net_benefit"), none.alias("roi"), none.alias("payback_days"),
    )
    return priced.unionByName(net)
