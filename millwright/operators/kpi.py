"""OEE baselines, Pareto tables and descriptive summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import oee as fx
from ..functions import rules
from ..functions.timex import US_PER_DAY, clamp, hours, us
from .scan import attach, percentiles


def oee_baseline(summary: DataFrame, unit: DataFrame, level: int | None = 1) -> DataFrame:
    """Parse the JSON components once per column and recompute the KPIs; `level=None` keeps plant rows."""
    rows = summary if level is None else summary.where(F.col("level") == level)
    parsed = rows.select(
        "*", F.from_json("availability", fx.A_DDL).alias("a"), F.from_json("performance", fx.P_DDL).alias("p"),
        F.from_json("quality", fx.Q_DDL).alias("q"),
    )
    src = {
        "WorkTotal": "a", "PlannedStop": "a", "UnPlannedStop": "a", "WorkingTime": "p", "PlannedTime": "p",
        "ProductSum": "q", "ScrapeSum": "q",
    }
    comp = {c: F.col(f"{s}.{c}") for c, s in src.items()}
    k = fx.kpis(comp)
    names = unit.select(F.col("uid").alias("unit_uid"), F.col("name").alias("machine"))
    return parsed.join(names, "unit_uid", "left").select(
        "machine", "unit_uid", F.to_date("trans_date").alias("date"), "trans_date", "level",
        *[k[n].alias(n) for n in ("OEE", "A", "P", "Q")], *[comp[c].alias(c) for c in fx.COMPONENTS],
        F.col("oee").alias("oee_stored"), F.col("a.A").alias("a_stored"),
    )


def with_kpis(components: DataFrame) -> DataFrame:
    k = fx.kpis(fx.cols())
    return components.select("*", *[k[n].alias(n) for n in ("OEE", "A", "P", "Q")])


def downtime_pareto(stops: DataFrame) -> DataFrame:
    """Unplanned hours and events per machine and reason; durations are taken as recorded."""
    return (
        stops.where(~F.col("is_planned"))
        .groupBy("machine", F.col("display_text").alias("reason"))
        .agg(F.count("id").alias("events"), F.sum(hours("duration_milliseconds")).alias("hours"))
    )


def stop_pareto(events: DataFrame, *, include_planned: bool = False, separate_connectivity: bool = True) -> DataFrame:
    """Machine and plant scope in one pass through grouping sets; `hours` and `events` rank them."""
    ev = events
    if not include_planned:
        ev = ev.where(F.col("category") != "PLANNED_BREAK")
    if not separate_connectivity:
        ev = ev.where(F.col("category") != "CONNECTIVITY")
    g = ev.groupingSets(
        [[F.col("machine"), F.col("category"), F.col("label")], [F.col("category"), F.col("label")]],
        F.col("machine"), F.col("category"), F.col("label"),
    ).agg(
        F.count(F.lit(1)).alias("events"), F.sum(hours("duration_ms")).alias("hours"),
        F.grouping("machine").alias("plant"),
    )
    scope = F.when(F.col("plant") == 1, "plant").otherwise("machine")
    machine = F.when(F.col("plant") == 1, "PLANT").otherwise(F.col("machine"))
    return g.select(
        scope.alias("scope"), machine.alias("machine"), "category", F.col("label").alias("reason"), "events", "hours"
    )


def alarm_pareto(alerts: DataFrame, scope: str = "machine") -> DataFrame:
    keys = ["machine", "category"] if scope == "machine" else ["category"]
    g = alerts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("occurrences"), F.count_distinct("machine").alias("machines_affected")
    )
    return g if scope == "machine" else g.withColumn("machine", F.lit("PLANT"))


def category_hours(events: DataFrame, machine: str | None = None, category: str | None = None) -> DataFrame:
    """Total hours per (machine, category), optionally for one of each."""
    ev = events
    if machine is not None:
        ev = ev.where(F.col("machine") == machine)
    if category is not None:
        ev = ev.where(F.col("category") == category)
    return ev.groupBy("machine", "category").agg(F.coalesce(F.sum(hours("duration_ms")), F.lit(0.0)).alias("hours"))


def machine_rollup(baseline: DataFrame) -> DataFrame:
    """Ratio of sums per machine; the period counts both end days, at least one."""
    sums = baseline.groupBy("machine").agg(
        *[F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in fx.COMPONENTS],
        F.min("date").alias("first_day"), F.max("date").alias("last_day"),
    )
    days = F.greatest(F.lit(1), F.date_diff("last_day", "first_day") + 1)
    return with_kpis(sums).withColumn("period_days", days)


def prorate(baseline: DataFrame, windows: DataFrame) -> DataFrame:
    """Components of each machine window: every day row counts by the share of it inside the window.

    Days are first matched to windows by calendar day so a machine's full history is never paired.
    """
    day0 = F.coalesce(us("trans_date"), us(F.col("date").cast("timestamp")))
    d = baseline.select(
        "machine", day0.alias("d0"), *[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) for c in fx.COMPONENTS]
    )
    w = windows.select("machine", F.col("start").alias("scope_start"), F.col("end").alias("scope_end"))
    span = F.sequence(F.floor(us("scope_start") / US_PER_DAY) - 1, F.floor(us("scope_end") / US_PER_DAY))
    wd = w.withColumn("day", F.explode(span))
    joined = wd.join(d.withColumn("day", F.floor(F.col("d0") / US_PER_DAY)), ["machine", "day"])
    lo = F.greatest(F.col("d0"), us("scope_start"))
    hi = F.least(F.col("d0") + US_PER_DAY, us("scope_end"))
    frac = clamp((hi - lo) / float(US_PER_DAY), 0.0, 1.0)
    sums = joined.groupBy("machine", "scope_start", "scope_end").agg(
        *[F.sum(F.col(c) * frac).alias(c) for c in fx.COMPONENTS]
    )
    full = w.join(sums, ["machine", "scope_start", "scope_end"], "left").fillna(0.0, list(fx.COMPONENTS))
    return with_kpis(full)


def median_summary(baseline: DataFrame, master: DataFrame) -> DataFrame:
    """Median OEE per machine next to its tier, plus the plant medians (OEE and P on production days)."""
    per = percentiles(baseline, ["machine"], "OEE", {"median_oee": 0.5})
    tiers = master.select(
        F.col("name").alias("machine"), "vendor", rules.tier(F.col("has_telemetry"), F.col("vendor")).alias("tier")
    )
    rows = tiers.join(per, "machine", "left")
    prod = baseline.where(F.col("ProductSum") > 0)
    none = F.lit(None).cast("string")

    def plant(name, df, col):
        return percentiles(df, [], col, {"median_oee": 0.5}).select(
            F.lit(f"PLANT {name}").alias("machine"), none.alias("vendor"), none.alias("tier"), "median_oee"
        )

    return (
        rows.unionByName(plant("OEE", prod, "OEE")).unionByName(plant("A", baseline, "A"))
        .unionByName(plant("P", prod, "P"))
    )


def heatmap(baseline: DataFrame, metric: str = "OEE") -> DataFrame:
    """Long form of the machine x day grid; pivot on `date` for a dense picture."""
    return baseline.groupBy("machine", "date").agg(F.avg(metric).alias(metric))


def oee_validity(baseline: DataFrame) -> DataFrame:
    a = F.col("a_stored")
    return baseline.agg(
        F.count(F.lit(1)).alias("n"), F.count_if((a >= 0) & (a <= 1)).alias("in_range"),
        F.count_if(a < 0).alias("below_0"), F.count_if(a > 1).alias("above_1"),
        F.count_if(a.isNull()).alias("missing"), F.count_if(F.col("oee_stored") == 0).alias("zero_oee"),
        F.count_if((a > 0) & (F.col("P") == 0)).alias("a_without_p"),
        F.count_if(F.coalesce(F.col("ScrapeSum"), F.lit(0.0)) != 0).alias("scrap_rows"),
    )


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation and exact quartiles of several columns in long form."""
    pairs = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in columns)
    long = df.select(F.expr(f"stack({len(columns)}, {pairs}) AS (metric, v)"))
    basic = long.groupBy("metric").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )
    quart = percentiles(long, ["metric"], "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return basic.join(quart, "metric", "left")


def crosstab(df: DataFrame, a: str, b: str, blank: str = "(blank)") -> DataFrame:
    """Counts of every value pair in long form, blanks labelled."""
    return df.groupBy(F.coalesce(F.col(a), F.lit(blank)).alias(a), F.coalesce(F.col(b), F.lit(blank)).alias(b)).agg(
        F.count(F.lit(1)).alias("n")
    )


def top_values(df: DataFrame, value: Column, k: int) -> DataFrame:
    """Most frequent values; equal counts are ordered by value. The sort is a bounded top-k."""
    return (
        df.select(value.alias("value")).where(F.col("value").isNotNull())
        .groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col("value")).limit(k)
    )


def reason_summary(stops: DataFrame) -> DataFrame:
    """Events, hours and exact median minutes per unplanned reason."""
    up = stops.where(~F.col("is_planned")).select(
        F.col("display_text").alias("reason"), hours("duration_milliseconds").alias("h"),
        (F.col("duration_milliseconds") / 6e4).alias("minutes"),
    )
    g = up.groupBy("reason").agg(F.count(F.lit(1)).alias("events"), F.sum("h").alias("hours"))
    med = percentiles(up, ["reason"], "minutes", {"median_min": 0.5})
    return g.join(med, g.reason.eqNullSafe(med.reason), "left").select(g.reason, "events", "hours", "median_min")


def unplanned_hours(stops: DataFrame) -> DataFrame:
    return (
        stops.where(~F.col("is_planned")).groupBy("machine").agg(F.sum(hours("duration_milliseconds")).alias("hours"))
    )


def counter_summary(counters: DataFrame, master: DataFrame) -> DataFrame:
    owners = master.select("unit_uid", F.col("name").alias("machine"))
    return (
        counters.groupBy("unit_uid").agg(
            F.sum("value").alias("pieces"), F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("signal_type") == "COUNT").alias("count_rows"),
            F.count_if(F.col("signal_type") == "STOCK_CYCLE").alias("stock_rows"),
            F.count_if(F.col("triggered_by").isNull()).alias("untriggered"),
        )
        .join(owners, "unit_uid", "left").groupBy("machine")
        .agg(*[F.sum(c).alias(c) for c in ("pieces", "n", "count_rows", "stock_rows", "untriggered")])
    )


def workorder_summary(orders: DataFrame) -> DataFrame:
    flags = orders.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_stock").alias("stock"), F.count_if("is_work_order").alias("work_orders"),
        F.count("stock_cycle").alias("cycles"), F.avg("stock_cycle").alias("mean_cycle"),
        F.stddev_samp("stock_cycle").alias("std_cycle"), F.min("stock_cycle").alias("min_cycle"),
        F.max("stock_cycle").alias("max_cycle"), F.min("started_on").alias("first_start"),
        F.max("started_on").alias("last_start"),
    )
    med = percentiles(orders, [], "stock_cycle", {"p25_cycle": 0.25, "median_cycle": 0.5, "p75_cycle": 0.75})
    return attach(flags, med)


def time_coverage(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    out = None
    for name, (df, ts) in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
        row = row.select(F.lit(name).alias("table_name"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def signals_per_machine(signals: DataFrame) -> DataFrame:
    return signals.groupBy("machine").agg(
        F.count(F.lit(1)).alias("signals"), F.count_if("matched_mes").alias("matched"),
        F.count_if("is_evidence_signal").alias("evidence"),
        F.count_distinct("canonical_role").alias("roles"),
    )


def role_counts(signals: DataFrame) -> DataFrame:
    return signals.groupBy("canonical_role").agg(F.count(F.lit(1)).alias("signals"))


def top_signals(telemetry: DataFrame, catalog: DataFrame, k: int = 10) -> DataFrame:
    """Busiest signal names; readings whose uid is in no catalog keep a NULL name. Folded by uid first."""
    per_uid = telemetry.groupBy("readingdef_uid").agg(F.count(F.lit(1)).alias("n"))
    names = catalog.select("readingdef_uid", "readingdef_name")
    return (
        per_uid.join(names, "readingdef_uid", "left").groupBy("readingdef_name").agg(F.sum("n").alias("n"))
        .orderBy(F.col("n").desc(), F.col("readingdef_name")).limit(k)
    )


def offline_dedup_hours(status: DataFrame) -> DataFrame:
    """Schedule hours hidden by distinct outage windows."""
    keys = ["instance_id", "started_on", "ended_on", "duration_milliseconds"]
    off = status.where(~F.col("is_online")).select(*keys).dropDuplicates(keys)
    return off.agg(
        F.count(F.lit(1)).alias("windows"),
        F.sum(F.coalesce(hours("duration_milliseconds"), F.lit(0.0))).alias("schedule_hours"),
    )


def fleet_mean_oee(rollup: DataFrame, master: DataFrame) -> DataFrame:
    tele = master.where("has_telemetry").select(F.col("name").alias("machine"))
    return (
        rollup.join(tele, "machine", "left_semi").where(F.col("UnPlannedStop") > 0)
        .agg(F.count(F.lit(1)).alias("machines"), F.avg("OEE").alias("mean_oee"))
    )


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per key; the rank filter is pushed below the shuffle as a per-task group limit."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)
