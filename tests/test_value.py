"""The published what-if and value cases, re-expressed on DataFrames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millwright.operators import value
from millwright.operators.value import Lever, Money, Prevention

H = 3.6e6
UTC = dt.timezone.utc


def at(h, m=0):
    return dt.datetime(2026, 1, 1, h, m, tzinfo=UTC)


def component_row(spark, unplanned_h=10.0, product=100.0, machine="M1"):
    return spark.createDataFrame(
        [(machine, dt.date(2026, 1, 1), at(0), 100 * H, 10 * H, unplanned_h * H, 80 * H, 100 * H, float(product), 0.0)],
        "machine string, date date, trans_date timestamp, WorkTotal double, PlannedStop double, UnPlannedStop double, "
        "WorkingTime double, PlannedTime double, ProductSum double, ScrapeSum double",
    )


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(9, 0, 0.9, 1), (9, 30, 0.1, 1), (9, 59, 0.8, 1), (10, 0, 0.99, 0), (10, 30, 0.1, 0)]
    return spark.createDataFrame([("M1", at(h, m), r, y) for h, m, r, y in rows], "machine string, ts timestamp, risk double, y int")


def stops(spark, *rows):
    return spark.createDataFrame(list(rows), "machine string, start timestamp, duration_ms double")


def test_reclassify_keeps_runtime(spark):
    r = value.run_scenarios(component_row(spark), [Lever("W2", 0.9, abs_ms=8 * H)]).first()
    assert r.after.UnPlannedStop == pytest.approx(2 * H)
    assert r.after.PlannedStop == pytest.approx(18 * H)
    assert r.recovered_ms == pytest.approx(0)
    assert r.dA > 0


def test_absolute_move_is_capped_by_category(spark):
    r = value.run_scenarios(component_row(spark), [Lever("W2", abs_ms=8 * H)], F.lit(3 * H)).first()
    assert r.after.UnPlannedStop == pytest.approx(7 * H)
    assert r.after.PlannedStop == pytest.approx(13 * H)


def test_speed_up_is_inert_without_production(spark):
    r = value.run_scenarios(component_row(spark, product=0), [Lever("W4", 0.1)]).first()
    assert r.dP == 0 and r.dOEE == 0 and "INERT" in r.note


def test_unknown_lever_is_refused():
    with pytest.raises(ValueError):
        Lever("W9")


def test_match_window_is_strict(spark, scored):
    s = stops(spark, ("M1", at(10), H))
    assert value.match_stops(scored, s, 0.85).first().caught is False
    assert value.match_stops(scored, s, 0.75).first().caught is True


def test_dedup_keeps_longest_clipped_stop(spark, scored):
    w = value.scored_windows(scored)
    raw = stops(spark, ("M1", at(10), 30 * H), ("M1", at(10), 12 * H), ("M7", at(10), H))
    rows = value.scope_stops(raw, w).collect()
    assert [r.duration_ms for r in rows] == [24 * H]
    assert value.match_stops(scored, value.scope_stops(raw, w), 0.95).first().caught is False


def test_prevention_is_capped_by_unplanned_time(spark):
    r = value.attributable_oee(component_row(spark, unplanned_h=2), F.lit(9.0)).first()
    assert r.applied_h == 2
    assert r.dOEE > 0 and r.dP == 0 and r.dQ == 0


def test_annualisation_and_return(spark):
    fin = value.projection(F.lit(10.0), F.lit(2), F.lit(100.0), Money(downtime_cost_per_hour=80, intervention_cost=300))
    r = spark.range(1).select(*[c.alias(n) for n, c in fin.items()]).first()
    assert (r.gross, r.intervention) == (800, 600)
    assert r.roi == pytest.approx(1 / 3, abs=1e-4)
    assert r.annual_prevented_h == pytest.approx(36.5)


def test_optimum_is_by_net_value(spark, scored):
    s = stops(spark, ("M1", at(10), 10 * H))
    money = Money(downtime_cost_per_hour=1000, intervention_cost=1, value_time_as="downtime_cost")
    sweep = value.threshold_sweep(
        scored, s, component_row(spark), 0.75, levels=[0.75, 0.95], prevention=Prevention(effectiveness=1.0), money=money
    ).collect()
    assert [r.threshold for r in sweep if r.is_optimum] == [0.75]


def test_decomposition_has_no_residual_and_waterfall_is_ordered(spark):
    d = value.decompose(value.run_scenarios(component_row(spark), [Lever("W1", 0.5)]))
    assert d.first().residual == 0
    steps = [r.label for r in value.waterfall(d, ["machine"]).orderBy("step").collect()]
    assert steps == ["Baseline OEE", "dA", "dP", "dQ", "Scenario OEE"]


def test_finance_values_time_once(spark):
    s = value.run_scenarios(component_row(spark), [Lever("W1", 0.5)])
    m = value.financials(s, Money()).first()
    c = value.financials(s, Money(value_time_as="downtime_cost")).first()
    assert m.gross_benefit == pytest.approx(30 * m.margin_gain, abs=0.5)
    assert c.gross_benefit == pytest.approx(30 * c.downtime_saving, abs=0.5)
