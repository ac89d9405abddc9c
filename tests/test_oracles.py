"""Registered plans against their SQL oracles; MILLWRIGHT_ALL=1 runs every key."""

import os

import compare
import pytest

from millwright.plans import all_queries

FOLDER = "/root/testdata/sf0.01"
FAST = [
    "machine_master", "signal_map", "oee_baseline", "oee_recompute", "stop_pareto", "reason_hours_median", "feature_grid",
    "rolling_stats", "stop_recency", "supervised_dataset", "asof_forward", "interval_flag", "interval_overlap", "risk_episodes",
    "score_rank_pct", "stop_match", "alarm_cascade", "root_cause_card", "recurrence", "synchronization_test", "fit_envelope",
    "deviation_score", "event_pr", "coupling", "coupling_clusters", "pr_curve", "confusion_metrics", "robust_znorm",
    "scenario_w1", "scenario_run", "scenario_catalog", "operating_point", "threshold_sweep", "stream_cascade",
    "ewma", "stream_ewma", "stream_feature_grid", "stream_episodes", "median_impute_scale", "model_logreg_rows", "src_csv", "src_parquet",
    "src_artifact_csv_json",
]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    return compare.duck(FOLDER)


@pytest.mark.parametrize("key", sorted(all_queries()[0]) if os.environ.get("MILLWRIGHT_ALL") else FAST)
def test_plan_equals_oracle(spark, con, key):
    message, good = compare.check(spark, con, key, FOLDER)
    assert good, message


def test_every_oracle_belongs_to_a_plan():
    plans, oracles = all_queries()
    assert set(oracles) <= set(plans)
    assert len(plans) > 150
