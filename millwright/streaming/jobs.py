"""The batch operators on arriving data: watermarked grids, sessions, cascades, drift state, dedup."""

from __future__ import annotations

import uuid
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..session import ensure_checkpoint_dir
from .ordered import Drift, event_time, ordered_state


def read_files(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Files arriving under a path as a stream; the schema is always given, never inferred."""
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


FAR = "9000-01-01 00:00:00"


class Closing:
    """The end of a finite input: one row far ahead that moves the watermark past every open window.

    `over(stream, column)` unions a second file stream that is empty while the input is drained; `drain` then writes the
    row to it and lets the query go on from its checkpoint. The row's own window stays open and is never emitted.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark, self.folder, self.column = spark, f"{spark.sparkContext.getCheckpointDir()}/closing-{uuid.uuid4().hex}", None

    def over(self, stream: DataFrame, column: str) -> DataFrame:
        self.column = column
        self._rows([]).write.parquet(self.folder)
        end = self.spark.readStream.schema(f"`{column}` timestamp").parquet(self.folder)
        return stream.unionByName(end, allowMissingColumns=True)

    def _rows(self, instants: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(x,) for x in instants], "t string").select(F.to_timestamp("t").alias(self.column))

    def close(self) -> None:
        self._rows([FAR]).coalesce(1).write.mode("append").parquet(self.folder)


def drain(stream: DataFrame, name: str, closing: Closing | None = None, ordered: bool = False) -> DataFrame:
    """Process everything available now into a Parquet sink with its own checkpoint, then read the sink.

    In append mode a window is written once the watermark has passed its end. With `closing` the input is taken to be
    finite, and the windows still open at its end are written as well.
    """
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"

    def go() -> None:
        with ordered_state(spark) if ordered else nullcontext():
            q = (
                stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
                .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
            )
        q.awaitTermination()

    go()
    if closing is not None:
        closing.close()
        go()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def feature_grid(readings: DataFrame, freq: str = "60 seconds", delay: str = "10 minutes") -> DataFrame:
    """Bucket statistics per machine; rows later than the watermark are dropped."""
    v = F.col("value")
    return (
        readings.withWatermark("time", delay).groupBy("machine", F.window("time", freq).alias("w")).agg(
            F.count(F.lit(1)).alias("n_samples"),
            F.avg(F.when(F.col("role") == "cycle_time", v)).alias("cycle_time_mean"),
            F.avg(F.when(F.col("role") == "run_state", F.when(v > 0, 1.0).otherwise(0.0))).alias("run_state_duty"),
        ).select("machine", F.col("w.start").alias("ts"), "n_samples", "cycle_time_mean", "run_state_duty")
    )


def episodes(scores: DataFrame, thresh: float, gap: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of scores at or above the threshold."""
    hot = scores.where(F.col("score") >= thresh).withWatermark("ts", delay)
    return hot.groupBy("machine", F.session_window("ts", gap).alias("w")).agg(
        F.min("ts").alias("window_start"), F.max("ts").alias("window_end"), F.max("score").alias("peak_score"),
        F.count(F.lit(1)).alias("n_buckets"),
    ).drop("w")


def cascades(alerts: DataFrame, tol: str = "2 seconds", min_size: int = 2, delay: str = "10 minutes") -> DataFrame:
    """Alarm buckets of at least two alarms with their most upstream alarm."""
    item = F.struct(rules.causal_rank("category").alias("rank"), "label", "category")
    g = alerts.withWatermark("start", delay).groupBy("machine", F.window("start", tol).alias("w")).agg(
        F.count(F.lit(1)).alias("n_alarms"), F.min(item).alias("root")
    )
    return g.where(F.col("n_alarms") >= min_size).select(
        "machine", F.col("w.start").alias("bucket_start"), "n_alarms", F.col("root.label").alias("root_alarm"),
        F.col("root.category").alias("root_category"),
    )


def dedup_stops(stops: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """First record of each (machine, start); the state of a key is dropped after the delay."""
    return stops.withWatermark("start", delay).dropDuplicatesWithinWatermark(["machine", "start"])


def ewma(rows: DataFrame, alpha: float = 0.05, delay: str = "10 minutes", forget_s: int | None = None) -> DataFrame:
    """Drift average per machine in event time, whatever files and triggers the rows arrive in; a NULL only decays.

    Rows wait in state until the watermark has passed them, then leave in the order of time and event id, so the answer is
    that of the batch form over all rows that were not late. Later rows are dropped, as in the other jobs here, and rows
    without a time are never due. The state of a machine is two doubles and the rows of the last `delay`; with `forget_s`
    the average of a machine silent for that long in event time starts anew. Needs `ordered_state` around the start.
    """
    timed = rows.where(F.col("ts").isNotNull()).select(
        "machine", event_time(F.unix_micros("ts")).alias("at"), F.unix_micros("ts").alias("us"), F.col("event_id").isNotNull().cast("tinyint").alias("named"),
        F.coalesce("event_id", F.lit(0).cast("bigint")).alias("event_id"), F.col("value").cast("double").alias("value"),
    ).withWatermark("at", delay)
    out = timed.groupBy("machine").transformWithStateInPandas(
        statefulProcessor=Drift(alpha, forget_s), outputStructType=Drift.OUT, outputMode="Append", timeMode="EventTime",
    )
    average = F.when(F.col("known"), F.coalesce("ewma", F.lit(float("nan"))))
    return out.select(
        "machine", F.timestamp_micros("us").alias("ts"), F.when(F.col("named"), F.col("event_id")).alias("event_id"), average.alias("ewma")
    )
