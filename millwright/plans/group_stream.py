"""Streaming forms of the operators, drained over the events table as an arriving file."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import rules
from ..streaming import jobs
from .fixtures import _SPARK, VIEWS
from .registry import query, shared
from . import views


def _arriving(p, *names):
    """Plant views over the events file read as a stream, under names of their own."""
    spark = p.spark
    jobs.read_files(spark, f"{p.folder}/events.parquet*", p.table("events").schema).createOrReplaceTempView("_mw_live_events")
    out = None
    for n in ("ev", *names):
        text = re.sub(r"\b(events|ev|fx_\w+)\b(?=\s|$)", r"_mw_live_\1", VIEWS[n].format(**_SPARK))
        out = spark.sql(text)
        out.createOrReplaceTempView(f"_mw_live_{n}")
    for n in ("events", "ev", *names):
        spark.catalog.dropTempView(f"_mw_live_{n}")
    return out


@query("stream_feature_grid", """
SELECT machine, b AS ts, count(*) AS n_samples, avg(v) FILTER (role='cycle_time') AS cycle_time_mean,
  avg(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (role='run_state') AS run_state_duty FROM o_tel GROUP BY 1,2""", "cycle_time_mean run_state_duty")
def _(p):
    t = _arriving(p, "fx_telemetry")
    r = views.roles(p).select("readingdef_uid", "machine", F.col("canonical_role").alias("role"))
    end = jobs.Closing(p.spark)
    return jobs.drain(jobs.feature_grid(end.over(t.join(r, "readingdef_uid"), "time"), "1 hour"), "stream-grid", end)


shared("o_live_sess", """
SELECT machine, min(ts) AS window_start, max(ts) AS window_end, max(risk)*100 AS peak_score, count(*) AS n_buckets FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts - prev) > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY machine ORDER BY ts, event_id) AS s FROM (
    SELECT *, lag(ts) OVER (PARTITION BY machine ORDER BY ts, event_id) AS prev FROM fx_scored WHERE risk >= 0.6)) GROUP BY machine, s""")


@query("stream_episodes", "SELECT * FROM o_live_sess", "peak_score")
def _(p):
    e = _arriving(p).where("m < 10")
    s = e.select("machine", "ts", F.pmod(F.col("k") * 37 + 11, F.lit(101)).cast("double").alias("score"))
    end = jobs.Closing(p.spark)
    # the closing row has no machine; its score lets it pass the threshold and reach the watermark
    s = end.over(s, "ts").withColumn("score", F.when(F.col("machine").isNull(), F.lit(100.0)).otherwise(F.col("score")))
    return jobs.drain(jobs.episodes(s, 60.0, "1 hour"), "stream-episodes", end)


@query("stream_cascade", "SELECT machine, bucket_start, n_alarms, root_alarm, root_category FROM o_casc")
def _(p):
    a = _arriving(p, "fx_alerts")
    a = a.select("machine", F.col("started_on").alias("start"), F.trim("value").alias("label"), rules.alarm_category("value").alias("category"))
    end = jobs.Closing(p.spark)
    return jobs.drain(jobs.cascades(end.over(a, "start")), "stream-cascade", end)


@query("stream_dedup", 'SELECT DISTINCT machine, started_on AS "start" FROM fx_stops')
def _(p):
    s = _arriving(p, "fx_stops").select("machine", F.col("started_on").alias("start"))
    return jobs.drain(jobs.dedup_stops(s), "stream-dedup")


@query("stream_ewma", """
SELECT machine, ts, event_id, sum(risk*pow(0.95::DOUBLE, -rn)) OVER w / sum(pow(0.95::DOUBLE, -rn)) OVER w AS ewma FROM (
  SELECT machine, ts, event_id, risk, row_number() OVER (PARTITION BY machine ORDER BY ts, event_id) AS rn FROM fx_scored) WINDOW w AS (PARTITION BY machine ORDER BY rn)""", "ewma")
def _(p):
    e = _arriving(p).where("m < 10")
    s = e.select("machine", "ts", "event_id", (F.pmod(F.col("k") * 37 + 11, F.lit(101)).cast("double") / 100).alias("value"))
    end = jobs.Closing(p.spark)
    return jobs.drain(jobs.ewma(end.over(s, "ts"), delay="1 hour"), "stream-ewma", end, ordered=True)
