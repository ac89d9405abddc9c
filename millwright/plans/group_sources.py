"""Sources: given tables written in each format under the checkpoint folder, read back and compared with the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources import tables
from . import views
from .registry import query


def _folder(p, name: str) -> str:
    ensure_checkpoint_dir(p.spark)
    return f"{p.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _numbered(df: DataFrame, folder: str, table: str, encoding: str) -> None:
    """Two parts `<table>_001.csv`, `<table>_002.csv`; a name that ends in .csv is a folder of part files to Spark."""
    tables.allow_charsets(df.sparkSession, encoding)
    for i in (1, 2):
        part = df.where(F.pmod(F.xxhash64(*df.columns), F.lit(2)) == i - 1)
        part.write.option("header", True).option("encoding", encoding).option("escape", '"').option("quoteAll", True).csv(f"{folder}/{table}_00{i}.csv")


@query("src_csv", """
SELECT 'u' || CAST(unit AS VARCHAR) AS unit_uid, trim(value) AS value, CAST(index AS INTEGER) AS index, is_array, started_on FROM (
  SELECT user_id % 12 AS unit, event_type || ' "quoted", ' || chr(10) || 'Duruş İş ' || CAST(event_id % 7 AS VARCHAR) AS value, event_id % 3 AS index,
    event_id % 2 = 0 AS is_array, CAST(ts AS TIMESTAMP) AS started_on FROM events)""")
def _(p):
    """Alarm rows with quotes, line breaks and a national code page through numbered CSV parts."""
    ev = p.table("events")
    text = F.concat(F.col("event_type"), F.lit(' "quoted", \nDuruş İş '), (F.col("event_id") % 7).cast("string"))
    rows = ev.select(
        F.concat(F.lit("u"), (F.col("user_id") % 12).cast("string")).alias("unit_uid"), text.alias("value"), (F.col("event_id") % 3).cast("int").alias("index"),
        F.when(F.col("event_id") % 2 == 0, "t").otherwise("f").alias("is_array"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSSXXX").alias("started_on"),
    )
    folder = _folder(p, "csv")
    _numbered(rows, folder, "alert", tables.TURKISH_CODEPAGE)
    return tables.read_csv(p.spark, folder, "alert", tables.SCHEMAS["alert"])


@query("src_parquet", "SELECT machine, started_on, ended_on, duration_milliseconds FROM fx_stops", "duration_milliseconds")
def _(p):
    """Stops written as Parquet by machine and read back."""
    rows, folder = p.stops.select("machine", "started_on", "ended_on", "duration_milliseconds"), _folder(p, "parquet")
    tables.write_parquet(rows, folder, ("machine",))
    return tables.read_parquet(p.spark, folder).select(rows.columns)


@query("src_artifact_csv_json", """
SELECT machine, trans_date, CAST(UnPlannedStop AS DOUBLE) AS csv_stop, CAST(UnPlannedStop AS DOUBLE) AS json_stop, CAST(ProductSum AS BIGINT) AS products
FROM fx_oee_components""", "csv_stop json_stop")
def _(p):
    """Daily components as a CSV and as a JSON artifact, both read again and joined."""
    rows = p.oee_components.select("machine", "trans_date", F.col("UnPlannedStop").cast("double").alias("stop"), F.col("ProductSum").cast("bigint").alias("products"))
    as_csv, as_json = _folder(p, "csv"), _folder(p, "json")
    tables.write_csv(rows, as_csv)
    tables.write_json_rows(rows, as_json)
    schema = "machine STRING, trans_date TIMESTAMP, stop DOUBLE, products BIGINT"
    one = p.spark.read.schema(schema).option("header", True).csv(as_csv).select("machine", "trans_date", F.col("stop").alias("csv_stop"))
    two = p.spark.read.schema(schema).json(as_json).select("machine", "trans_date", F.col("stop").alias("json_stop"), "products")
    return one.join(two, ["machine", "trans_date"])


@query("telemetry_by_day", """
SELECT r.machine, r.canonical_role AS role, t.readingdef_uid, t.time, t.value
FROM fx_telemetry t JOIN o_roles r USING (readingdef_uid) WHERE t.time IS NOT NULL AND EXISTS (
  SELECT 1 FROM fx_stops s WHERE s.machine = r.machine AND NOT s.is_planned AND s.started_on < TIMESTAMP '2024-01-05 00:00:00'
    AND s.duration_milliseconds < 4 * 3600000 AND t.time >= s.started_on AND t.time <= COALESCE(s.ended_on, s.started_on))""", "value")
def _(p):
    """Readings during the shorter unplanned stops of the first days, from telemetry ingested by date; other dates stay unread."""
    folder = _folder(p, "by-day")
    tables.write_by_day(tables.feature_scan(p.telemetry, views.roles(p)), folder)
    stops = p.stops.where("NOT is_planned AND started_on < TIMESTAMP '2024-01-05 00:00:00' AND duration_milliseconds < 4 * 3600000")
    return tables.window_rows(p.spark, folder, stops, ["machine"])
