"""Readers and writers: explicit schemas, tolerant casts, filtered telemetry scans."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import in_any_interval

# Columns whose text is a 't'/'f' boolean, and columns that hold UTC instants.
BOOLEAN_COLUMNS = [
    "purge", "sync", "remove", "is_enabled", "is_planned", "is_unit_on", "is_test_prod", "exclude_from_oee",
    "is_online", "is_array", "is_stock", "is_work_order", "is_deleted", "enabled", "is_expression",
    "is_manual_entry", "is_simulation", "is_potential_anomaly", "has_machine_opcode",
    "calculate_oee_with_stock", "system_offline_is_planned",
]
INSTANT_COLUMNS = [
    "started_on", "ended_on", "trans_date", "slice_on", "received_on", "heartbeat_on", "inserted_on", "time",
    "source_utc_timestamp", "server_utc_timestamp", "last_update_date", "started_on_system", "local_data_day",
]

# Column types of the logical tables; everything else is read as text.
SCHEMAS = {
    "unit": "uid STRING, name STRING, device_uid STRING, is_enabled BOOLEAN",
    "device": "uid STRING, collector_type_name STRING",
    "monitor_unit": "id INT, unit_uid STRING",
    "monitor_reading_def": "readingdef_uid STRING, readingdef_name STRING, external_signal_type STRING, "
    "external_signal_category STRING, si_unit STRING, unit_id INT",
    "mes_reading_def": "uid STRING, display_text STRING, signal_type STRING, signal_category STRING, "
    "unit_uid STRING, instance_id STRING, exclude_from_oee BOOLEAN",
    "oee_summary": "unit_uid STRING, trans_date TIMESTAMP, level INT, oee DOUBLE, availability STRING, "
    "performance STRING, quality STRING",
    "stoppage_slice": "id STRING, unit_uid STRING, reading_def_uid STRING, started_on TIMESTAMP, "
    "ended_on TIMESTAMP, duration_milliseconds DOUBLE, is_planned BOOLEAN, exclude_from_oee BOOLEAN, "
    "is_test_prod BOOLEAN",
    "alert": "unit_uid STRING, value STRING, reading_def_uid STRING, index INT, is_array BOOLEAN, "
    "started_on TIMESTAMP, ended_on TIMESTAMP, duration_milliseconds DOUBLE",
    "status": "instance_id STRING, is_online BOOLEAN, started_on TIMESTAMP, ended_on TIMESTAMP, "
    "duration_milliseconds DOUBLE",
    "counter_slice": "id STRING, unit_uid STRING, signal_type STRING, triggered_by STRING, value DOUBLE",
    "workorder": "unit_uid STRING, started_on TIMESTAMP, is_stock BOOLEAN, is_work_order BOOLEAN, "
    "stock_cycle DOUBLE, order_no STRING",
    "telemetry": "time TIMESTAMP, readingdef_uid STRING, value DOUBLE, index INT, instance_id STRING",
    "telemetry_string": "time TIMESTAMP, readingdef_uid STRING, value STRING, index INT, instance_id STRING",
}

TURKISH_CODEPAGE = "windows-1254"


# Tables whose text may hold line breaks; the others stay splittable.
MULTILINE = {"alert", "mes_reading_def", "monitor_reading_def", "unit", "device", "telemetry_string", "oee_summary"}


def _header(spark: SparkSession, path: str, encoding: str) -> list[str]:
    """Names in the first line; quoted names may hold commas."""
    line = spark.read.option("encoding", encoding).text(path).limit(1).collect()
    return [c.strip().lstrip("\ufeff") for c in next(csv.reader([line[0][0]]))] if line else []


def allow_charsets(spark: SparkSession, encoding: str) -> None:
    """Let Spark read and write a code page beyond the few it knows by itself."""
    if encoding.lower() not in ("utf-8", "us-ascii", "iso-8859-1", "utf-16", "utf-16be", "utf-16le", "utf-32"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def coerce(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Text to typed columns; a value that does not parse becomes NULL, never an error."""
    types = types or {}
    cols = []
    for c in df.columns:
        want = types.get(c.lower()) or (
            "boolean" if c in BOOLEAN_COLUMNS else "timestamp" if c in INSTANT_COLUMNS else None
        )
        x = F.col(f"`{c}`")
        if want == "boolean":
            # only the four known spellings are booleans
            x = F.when(x.isin("t", "true", "True"), True).when(x.isin("f", "false", "False"), False)
        elif want == "double":
            y = x.try_cast("double")
            x = F.when(~F.isnan(y), y)
        elif want:
            x = x.try_cast(want)
        cols.append(x.alias(c))
    return df.select(*cols)


def read_csv(
    spark: SparkSession, folder: str, table: str, schema: str | None = None, *, encoding: str = TURKISH_CODEPAGE,
    multiline: bool | None = None, typed: bool = True,
) -> DataFrame:
    """One logical table from `<table>_NNN.csv` parts, else `<table>.csv`.

    Columns are taken by header name. Only the tables of MULTILINE are read as one record stream per file, unless
    `multiline` says otherwise; large files of the others are split over tasks.
    """
    if multiline is None:
        multiline = table in MULTILINE
    allow_charsets(spark, encoding)
    parts = sorted(_list(spark, f"{folder}/{table}_[0-9][0-9][0-9].csv"))
    paths = parts or [f"{folder}/{table}.csv"]
    names = _header(spark, paths[0], encoding)
    text = ", ".join(f"`{n}` STRING" for n in names)
    df = (
        spark.read.schema(text).option("header", True).option("encoding", encoding)
        .option("multiLine", multiline).option("escape", '"').option("enforceSchema", False).csv(paths)
    )
    if not typed:
        return df
    want = {}
    for item in (schema or "").split(","):
        if item.strip():
            n, t = item.split()
            want[n.strip("`").lower()] = t.lower()
    return coerce(df, want)


def _list(spark: SparkSession, pattern: str) -> list[str]:
    """Names behind a glob, by the file system that Spark itself reads the path from."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [str(s.getPath()) for s in (found or [])]


def telemetry_window(
    telemetry: DataFrame, *, start=None, end=None, uids: DataFrame | Iterable[str] | None = None,
    columns: Sequence[str] = ("time", "readingdef_uid", "value", "index", "instance_id"),
) -> DataFrame:
    """Readings of chosen signals in [start, end], both ends included; naive bounds are UTC.

    The time predicate reaches the file scan; a uid frame filters through a semi join.
    """
    df = telemetry
    if start is not None:
        df = df.where(F.col("time") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col("time") <= F.lit(end).cast("timestamp"))
    if isinstance(uids, DataFrame):
        df = df.join(uids.select("readingdef_uid"), "readingdef_uid", "left_semi")
    elif uids is not None:
        df = df.where(F.col("readingdef_uid").isin(*list(uids)))
    return df.select(*[c for c in columns if c in df.columns])


def feature_scan(telemetry: DataFrame, roles: DataFrame) -> DataFrame:
    """Readings of feature signals tagged with machine and role; unparsable instants are dropped, values kept NULL."""
    v = F.col("value").try_cast("double")
    return (
        telemetry.where(F.col("time").isNotNull())
        .join(roles.select("readingdef_uid", "machine", F.col("canonical_role").alias("role")), "readingdef_uid")
        .select("machine", "role", "readingdef_uid", "time", F.when(~F.isnan(v), v).alias("value"))
    )


def utc_day(ts: str) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_micros(ts) / 86_400_000_000).cast("int"))


def write_by_day(df: DataFrame, path: str, ts: str = "time", file_rows: int = 5_000_000) -> None:
    """Ingest into one partition `day` (UTC) per date. Days are balanced by size: small ones share a task, a large one is
    split over several, so neither many tiny files nor one huge one comes out. Rows without an instant keep a partition."""
    by_day = df.withColumn("day", utc_day(ts)).hint("rebalance", F.col("day"))
    by_day.write.mode("overwrite").option("maxRecordsPerFile", file_rows).partitionBy("day").parquet(path)


def days_of(spark: SparkSession, path: str) -> list[str]:
    """Dates that a table written by `write_by_day` has, from its folder names alone."""
    return sorted(d for d in (x.rsplit("day=", 1)[1] for x in _list(spark, f"{path}/day=*")) if d[:2] != "__")


def scan_days(spark: SparkSession, path: str, windows: DataFrame, start: str = "started_on", end: str = "ended_on") -> DataFrame:
    """Rows of the dates that some window touches; files of other dates are not opened.

    The dates reach the scan as a dynamic partition filter. The sent side is at most one row for each date of the table,
    wherever the windows end; a missing end or one before the start stands for the start.
    """
    table, days = spark.read.parquet(path), days_of(spark, path)
    if not days:
        return table.limit(0)
    first, last = F.lit(days[0]).cast("date"), F.lit(days[-1]).cast("date")
    low, high = utc_day(start), F.greatest(utc_day(start), F.coalesce(utc_day(end), utc_day(start)))
    met = windows.select(low.alias("__a"), high.alias("__z")).where((F.col("__a") <= last) & (F.col("__z") >= first)).distinct()
    touched = met.select(F.explode(F.sequence(F.greatest("__a", first), F.least("__z", last))).alias("day")).distinct()
    return table.join(F.broadcast(touched), "day", "left_semi")


def window_rows(spark: SparkSession, path: str, windows: DataFrame, by: Sequence[str], ts: str = "time", start: str = "started_on", end: str = "ended_on") -> DataFrame:
    """Rows that lie in a closed window of their key, each once however many windows hold it, without reading other dates."""
    near = scan_days(spark, path, windows.where(F.col(start).isNotNull()), start, end)
    inside = in_any_interval(near, windows, by, F.unix_micros(ts), F.unix_micros(start), F.unix_micros(end), out="__in")
    return inside.where("__in").drop("__in", "day")


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(path)


def write_json_rows(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document per row, nested columns included."""
    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value")).write.mode(mode).text(path)
