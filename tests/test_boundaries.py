"""One row per inclusive / strict / NULL cell of the operator semantics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millwright.functions import oee as fx
from millwright.functions import rules
from millwright.functions.timex import hours
from millwright.operators import anomaly, cross, events, grid, kpi, predict, rca, sessions

UTC = dt.timezone.utc
D0 = dt.datetime(2026, 1, 1, tzinfo=UTC)


def t(minutes=0.0):
    return D0 + dt.timedelta(minutes=minutes)


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


STOP = "machine string, unit_uid string, display_text string, is_planned boolean, started_on timestamp, ended_on timestamp, duration_milliseconds double"


def test_interval_ends_are_inclusive_null_end_is_a_point_and_null_machine_is_everyone(spark):
    pts = frame(spark, "machine string, ts timestamp", *[("A", t(m)) for m in (9, 10, 20, 21, 30, 31)], ("B", t(40)), ("B", t(41)))
    win = frame(
        spark, "machine string, started_on timestamp, ended_on timestamp",
        ("A", t(10), t(20)), ("A", t(30), None), (None, t(40), t(40)),
    )
    got = {(r.machine, r.ts.astimezone(UTC)): r.inside for r in anomaly.flag_intervals(pts, win).collect()}
    want = {("A", 9): False, ("A", 10): True, ("A", 20): True, ("A", 21): False, ("A", 30): True, ("A", 31): False, ("B", 40): True, ("B", 41): False}
    assert {k: got[(k[0], t(k[1]))] for k in want} == want


def test_alarm_to_stop_lag_is_inclusive_and_machines_without_stops_vanish(spark):
    al = frame(spark, "machine string, unit_uid string, value string, started_on timestamp, duration_milliseconds double",
               ("A", "u", "CHUCK", t(0), 1.0), ("A", "u", "CHUCK", t(0.5), 1.0), ("Z", "u", "CHUCK", t(0), 1.0))
    st = frame(spark, STOP, ("A", "u", "Not running", False, t(10.0), None, 1.0))
    m = rca.alarm_to_stop(events.alert_events(al), events.stoppage_events(st)).orderBy("alarm_start").collect()
    assert [r.matched for r in m] == [True, True] and m[0].lag_seconds == 600
    late = frame(spark, STOP, ("A", "u", "Not running", False, t(10.6), None, 1.0))
    m = rca.alarm_to_stop(events.alert_events(al), events.stoppage_events(late)).orderBy("alarm_start").collect()
    assert [r.matched for r in m] == [False, False]


def test_session_gap_of_exactly_ten_minutes_merges(spark):
    s = frame(spark, "machine string, ts timestamp, score double, is_offline boolean",
              ("A", t(0), 95.0, False), ("A", t(10), 91.0, False), ("A", t(20.1), 99.0, False), ("A", t(21), 99.5, True), ("A", t(5), 89.9, False))
    w = sessions.extract_windows(s).orderBy("window_start").collect()
    assert [(r.n_buckets, r.peak_score) for r in w] == [(2, 95.0), (1, 99.0)]


def test_episode_counts_rows_below_threshold_inside_and_gap_of_twenty_merges(spark):
    rows = [(0, 0.9, 0), (10, 0.2, 1), (20, 0.8, 0), (60, 0.9, 0), (61, 0.9, 0)]
    s = frame(spark, "machine string, ts timestamp, risk double, y int", *[("A", t(m), r, y) for m, r, y in rows])
    e = sessions.risk_episodes(s, 0.5).collect()
    assert len(e) == 1
    assert (e[0].n_buckets, e[0].hit, e[0].peak_risk) == (3, True, 0.9)
    assert e[0].mean_risk == pytest.approx((0.9 + 0.2 + 0.8) / 3)


def test_label_window_is_open_at_t_and_closed_at_the_horizon(spark):
    rows = frame(spark, "machine string, ts timestamp", ("A", t(0)), ("A", t(60)), ("A", t(59)))
    starts = frame(spark, "machine string, start timestamp", ("A", t(60)))
    got = {r.ts.astimezone(UTC): r.y for r in predict.future_label(rows, starts).collect()}
    assert got == {t(0): 1, t(59): 1, t(60): 0}
    nxt = frame(spark, "machine string, start timestamp", ("A", t(60.01)))
    assert predict.future_label(rows, nxt).where(F.col("ts") == F.lit(t(0))).first().y == 0


def test_recency_without_any_stop_and_inclusive_four_hours(spark):
    rows = frame(spark, "machine string, ts timestamp", ("A", t(240)), ("A", t(240.5)), ("B", t(0)))
    stops = frame(spark, "machine string, start timestamp, minutes double", ("A", t(0), 500.0))
    got = {(r.machine, r.ts.astimezone(UTC)): r for r in predict.stop_recency(rows, stops).collect()}
    a, late, b = got[("A", t(240))], got[("A", t(240.5))], got[("B", t(0))]
    assert (a.anystop_min_since, a.anystop_cnt_4h, a.anystop_cnt_1h, a.downtime_min_4h) == (240.0, 1.0, 0.0, 240.0)
    assert late.anystop_cnt_4h == 0.0 and late.downtime_min_4h == 0.0
    assert a.micro_min_since == 9999.0 and b.micro_min_since == 0.0 and b.anystop_min_since == 9999.0


def test_only_latest_start_decides_an_active_stop(spark):
    rows = frame(spark, "machine string, ts timestamp", ("A", t(30)), ("A", t(45)))
    stops = frame(spark, "machine string, start timestamp, minutes double", ("A", t(0), 600.0), ("A", t(20), 10.0))
    assert [r.ts.astimezone(UTC) for r in predict.drop_active_stops(rows, stops).collect()] == [t(45)]


READ = "machine string, role string, readingdef_uid string, time timestamp, value double"


def test_counter_delta_needs_the_adjacent_bucket_and_zero_inside_null_outside_the_span(spark):
    r = frame(
        spark, READ,
        ("A", "run_time", "c1", t(0), 5.0), ("A", "run_time", "c1", t(1), 9.0), ("A", "run_time", "c1", t(3), 30.0),
        ("A", "cycle_time", "g", t(2), 1.0), ("A", "cycle_time", "g", t(5), 2.0),
    )
    g = {x.ts.astimezone(UTC): x for x in grid.feature_grid(r).collect()}
    assert [g[t(m)].run_time_delta for m in (0, 1, 2, 3, 5)] == [0.0, 4.0, 0.0, 0.0, None]
    assert g[t(2)].cycle_time_std is None and g[t(2)].cycle_time_mean == 1.0
    assert g[t(0)].is_idle is True and g[t(0)].axis_move_total is None


def test_counter_reset_is_clipped_and_null_value_rows_count(spark):
    r = frame(spark, READ, ("A", "run_time", "c", t(0), 9.0), ("A", "run_time", "c", t(1), 2.0), ("A", "run_state", "s", t(1), None), ("A", "run_state", "s", t(1.2), 1.0))
    g = {x.ts.astimezone(UTC): x for x in grid.feature_grid(r).collect()}
    assert g[t(1)].run_time_delta == 0.0 and g[t(1)].n_samples == 3 and g[t(1)].run_state_duty == 0.5


def test_mode_changes_are_distinct_values(spark):
    r = frame(spark, READ, *[("A", "machine_mode", "m", t(s / 60), v) for s, v in ((1, 1.0), (2, 2.0), (3, 1.0))], ("A", "cycle_time", "g", t(1), 1.0), ("A", "machine_mode", "m", t(2), 7.0))
    g = {x.ts.astimezone(UTC): x for x in grid.feature_grid(r).collect()}
    assert (g[t(0)].machine_mode_last, g[t(0)].machine_mode_changes) == (1.0, 2.0)
    assert (g[t(1)].machine_mode_last, g[t(1)].machine_mode_changes) == (None, 0.0)


def _bucket_rows(n, value):
    return [("A", t(i), value(i), False, False) for i in range(n)]


GRID = "machine string, ts timestamp, x double, is_idle boolean, is_offline boolean"


def test_envelope_needs_twenty_values_and_survives_zero_mad(spark):
    assert anomaly.fit_envelopes(frame(spark, GRID, *_bucket_rows(19, float)), ["x"]).count() == 0
    e = anomaly.fit_envelopes(frame(spark, GRID, *_bucket_rows(20, lambda i: 1.0 if i else 5.0)), ["x"]).first()
    assert e.median == 1.0 and e.sigma == pytest.approx(0.894427, abs=1e-6)
    flat = anomaly.fit_envelopes(frame(spark, GRID, *_bucket_rows(20, lambda i: 2.0)), ["x"]).first()
    assert flat.sigma == 1.0


def test_rank_ties_share_the_average(spark):
    d = frame(spark, "machine string, ts timestamp, feature string, robust_z double, dev_score double",
              *[("A", t(i), "f", 1.0, v) for i, v in enumerate((1.0, 2.0, 2.0, 4.0))])
    s = [r.score_baseline for r in anomaly.machine_scores(d).orderBy("ts").collect()]
    assert s == [25.0, 62.5, 62.5, 100.0]


def test_oee_edge_cases(spark):
    c = frame(spark, ", ".join(f"{n} double" for n in fx.COMPONENTS),
              (10.0, 10.0, 0.0, 1.0, 2.0, 0.0, 0.0), (10.0, 0.0, 20.0, 9.0, 3.0, 5.0, 9.0), (10.0, 0.0, None, 1.0, 0.0, 5.0, 0.0))
    r = kpi.with_kpis(c).select("A", "P", "Q").collect()
    assert tuple(r[0]) == (0.0, 0.0, 1.0)
    assert tuple(r[1]) == (0.0, 1.0, 0.0)
    assert r[2].A is None and (r[2].P, r[2].Q) == (0.0, 1.0)


def test_malformed_json_gives_null_components(spark):
    o = frame(spark, "unit_uid string, trans_date timestamp, level int, oee double, availability string, performance string, quality string",
              ("u", D0, 1, 0.5, "{oops", None, '{"ProductSum": 4}'))
    u = frame(spark, "uid string, name string", ("u", "A"))
    r = kpi.oee_baseline(o, u).first()
    assert r.WorkTotal is None and r.ProductSum == 4.0 and (r.A, r.P, r.Q) == (0.0, 0.0, None)


def test_classifiers(spark):
    rows = frame(spark, "name string, text string, planned boolean, alarm string",
                 ("cycle_time_ms", "SYSTEM OFFLINE", True, "low air  pressure"), (" ", "Waiting tool", None, None),
                 (None, "Tool change", False, "x"), ("DURUŞ", None, None, "acil"), ("spindle", "Undefined", True, "door"), ("x", "DURUŞ", None, "y"))
    r = rows.select(
        rules.signal_role("name").alias("role"), rules.stop_category("text", "planned").alias("stop"), rules.alarm_category("alarm").alias("alarm")
    ).collect()
    assert [x.role for x in r] == ["cycle_time", "other", "other", "stop_event", "other", "other"]
    assert [x.stop for x in r] == ["CONNECTIVITY", "WAITING_WORK", "PLANNED_BREAK", "OTHER", "PLANNED_BREAK", "UNPLANNED_RUNSTOP"]
    assert [x.alarm for x in r] == ["AIR_PRESSURE", "OTHER_ALARM", "OTHER_ALARM", "EMERGENCY_STOP", "DOOR_INTERLOCK", "OTHER_ALARM"]


def test_unparsable_duration_is_null(spark):
    assert [r.h for r in frame(spark, "d string", ("7200000",), ("n/a",)).select(hours("d").alias("h")).collect()] == [2.0, None]


def test_cascade_splits_on_fixed_buckets_and_folds_repeats(spark):
    al = frame(spark, "machine string, unit_uid string, index int, value string, started_on timestamp, duration_milliseconds double",
               ("A", "u", 0, "DOOR", t(0), 1.0), ("A", "u", 1, "AIR PRESSURE", t(1 / 60), 1.0), ("A", "u", 2, "DOOR", t(1 / 60), 1.0), ("A", "u", 0, "CHUCK", t(2 / 60), 1.0))
    c = rca.cascades(events.alert_events(al)).withColumn("text", rca.chain_text(F.col("chain"))).collect()
    assert [(x.n_alarms, x.root_category, x.text) for x in c] == [(3, "AIR_PRESSURE", "AIR PRESSURE -> DOOR x2")]


def test_overlap_keeps_open_and_long_events(spark):
    w = frame(spark, "id int, machine string, w_start timestamp, w_end timestamp", (1, "A", t(1000), t(1010)), (2, "A", t(6000), t(6010)))
    e = frame(spark, "machine string, source string, category string, name string, start timestamp, end timestamp",
              *[("A", "alert", "X", *x) for x in (("open", t(0), None), ("long", t(1), t(5000)), ("over", t(0), t(984.9)), ("edge", t(900), t(985)),
              ("after", t(1015), None), ("late", t(1015.1), None), ("for ever", t(2), dt.datetime(9999, 12, 31)))], ("B", "alert", "X", "other", t(1000), t(1001)))
    pairs = sorted((r.id, r.name) for r in events.overlapping(w, e, "id").collect())
    assert pairs == [(1, "after"), (1, "edge"), (1, "long")]
    assert sorted((r.id, r.n_open) for r in events.open_before(w, e, "id").collect()) == [(1, 2), (2, 4)]


def test_closed_events_of_any_length_are_paired(spark):
    w = frame(spark, "id int, machine string, w_start timestamp, w_end timestamp", (1, "A", dt.datetime(9000, 1, 1), dt.datetime(9000, 1, 2)), (2, "A", dt.datetime(9999, 6, 1), dt.datetime(9999, 6, 2)))
    e = frame(spark, "machine string, name string, start timestamp, end timestamp", ("A", "ages", dt.datetime(1, 2, 1), dt.datetime(9999, 1, 1)))
    assert [(r.id, r.name) for r in events.overlapping(w, e, "id").collect()] == [(1, "ages")]


def test_clusters_follow_chains(spark):
    p = frame(spark, "a string, b string, r double", *[(f"M{i}", f"M{i+1}", 0.9) for i in range(9)], ("X", "Y", 0.8), ("Y", "M0", 0.1))
    got = {r.machine: r.cluster for r in cross.clusters(p, 0.5).collect()}
    assert {got[f"M{i}"] for i in range(10)} == {"M0"} and got["X"] == got["Y"] == "X"


def test_pair_moments_in_machine_groups(spark):
    import random

    rng = random.Random(1)
    rows = [(f"M{m}", h, rng.random()) for m in range(9) for h in range(30) if rng.random() < 0.8]
    df = frame(spark, "machine string, h long, score double", *rows)
    one, many = ({(r.a, r.b): tuple(round(x, 9) for x in r[2:]) for r in cross.pair_moments(df, 7, n).collect()} for n in (512, 2))
    assert one == many and len(one) == 36


def test_chronological_split_has_no_leakage(spark):
    rows = frame(spark, "machine string, ts timestamp, y int", *[("A", t(i), i % 2) for i in range(11)])
    s = predict.chrono_split(rows, 0.6)
    assert s.where("part = 'train'").count() == 6 and predict.leakage(s).count() == 0


def test_model_learns_a_planted_signal(spark):
    from millwright.operators import metrics, models

    rows = frame(spark, "machine string, ts timestamp, y int, x double, z double",
                 *[("A", t(i), int((i * 7) % 10 > 5), float((i * 7) % 10) if i % 9 else None, 1.0) for i in range(200)])
    s = models.train_and_score(predict.chrono_split(rows, 0.6), ["x", "z"], "logreg")
    assert metrics.roc_auc(s, ["machine"]).first().roc_auc > 0.9


def test_rules_by_literal_cases(spark):
    """Written out here, apart from the rule tables, so that a wrong table cannot stay green."""
    alarms = {
        "AIR PRESSURE FAILED!": "AIR_PRESSURE", "EMERGENCY STOP.": "EMERGENCY_STOP", "DOOR INTERLOCK ALARM.": "DOOR_INTERLOCK",
        "Z AXIS NEED  ZERO RETURN !": "AXIS_ZERO_RETURN", " LUBE OIL LAST.": "LUBE_OIL", "CHUCK UNCLAMP.": "CHUCK", "MOTOR OVERLOAD": "MOTOR_OVERLOAD",
        "x axis over travel": "OVERTRAVEL", "ILLEGAL G CODE": "PROGRAM_ERROR", "UNKNOWN 7": "OTHER_ALARM", None: "OTHER_ALARM",
    }
    got = {r.v: r.c for r in frame(spark, "v string", *[(k,) for k in alarms]).select("v", rules.alarm_category("v").alias("c")).collect()}
    assert got == alarms
    assert rules.RECOVERY_SHARE["AIR_PRESSURE"] == 0.8 and rules.RECOVERY_SHARE["CONNECTIVITY"] == 0.0
    assert rules.FACILITY_CAUSE["CONNECTIVITY"] == "FACILITY_NETWORK" and rules.FACILITY_CAUSE["AIR_PRESSURE"] == "FACILITY_AIR"
    ranked = sorted(rules.CAUSAL_RANK, key=rules.CAUSAL_RANK.get)
    assert ranked[:3] == ["AIR_PRESSURE", "LUBE_OIL", "MOTOR_OVERLOAD"] and ranked[-2:] == ["EMERGENCY_STOP", "OTHER_ALARM"]
