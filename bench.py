"""Headline timings, one JSON line. Each query is timed end to end from the raw tables.

BENCH_SF_DIR selects the data folder, BENCH_CPUS the local cores; arguments name other queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "oee_baseline", "scenario_range", "stop_pareto", "event_stream", "feature_grid", "stop_recency", "asof_forward",
    "interval_flag", "machine_score", "risk_episodes", "synchronization_test", "root_cause_card", "pr_curve",
    "threshold_sweep",
]


def main(names: list[str]) -> None:
    from millwright.plans import all_queries
    from millwright.plans.fixtures import forget

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    plans = all_queries()[0]
    spark.read.parquet(f"{folder}/events.parquet").selectExpr("count(ts)").collect()
    times = {}
    for name in names or HEADLINE:
        forget()  # no stage written by an earlier query is reused
        start = time.perf_counter()
        plans[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
