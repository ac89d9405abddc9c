"""CSV, Parquet and JSON round trips with the data's known quirks."""

import datetime as dt

from pyspark.sql import functions as F

from millwright.sources import tables

UTC = dt.timezone.utc


def test_numbered_parts_codepage_booleans_and_line_breaks(spark, tmp_path):
    head = "uid,display_text,exclude_from_oee,instance_id,unit_uid\n"
    (tmp_path / "mes_reading_def_001.csv").write_bytes((head + 'a,"Duruş\nikinci satır",t,i1,u1\n').encode("cp1254"))
    (tmp_path / "mes_reading_def_002.csv").write_bytes((head + "b,İş Bekliyor,f,i1,u1\nc,x,maybe,,u1\n").encode("cp1254"))
    (tmp_path / "mes_reading_def.csv").write_text(head + "wrong,file,t,i,u\n")
    r = tables.read_csv(spark, str(tmp_path), "mes_reading_def", tables.SCHEMAS["mes_reading_def"]).orderBy("uid").collect()
    assert [x.uid for x in r] == ["a", "b", "c"]
    assert r[0].display_text == "Duruş\nikinci satır" and r[1].display_text == "İş Bekliyor"
    assert [x.exclude_from_oee for x in r] == [True, False, None]


def test_bad_values_become_null_and_single_file_is_used(spark, tmp_path):
    (tmp_path / "status.csv").write_text(
        "instance_id,is_online,started_on,ended_on,duration_milliseconds\n"
        "i1,f,2026-01-01 00:00:00+00,not a date,12.5\ni1,t,2026-01-01T01:00:00Z,,abc\n"
    )
    r = tables.read_csv(spark, str(tmp_path), "status", tables.SCHEMAS["status"]).orderBy("started_on").collect()
    assert [x.is_online for x in r] == [False, True]
    assert r[0].ended_on is None and r[0].duration_milliseconds == 12.5 and r[1].duration_milliseconds is None
    raw = tables.read_csv(spark, str(tmp_path), "status", typed=False)
    assert dict(raw.dtypes)["is_online"] == "string"


def test_telemetry_window_is_inclusive_and_prunes_the_scan(spark, tmp_path):
    at = lambda m: dt.datetime(2026, 1, 1, 0, m, tzinfo=UTC)
    df = spark.createDataFrame([(at(m), f"r{m % 2}", float(m), 0, "i") for m in range(10)], tables.SCHEMAS["telemetry"])
    tables.write_parquet(df, str(tmp_path / "t"))
    t = tables.read_parquet(spark, str(tmp_path / "t"))
    w = tables.telemetry_window(t, start="2026-01-01 00:02:00", end="2026-01-01 00:06:00", uids=["r0"], columns=("time", "value"))
    assert sorted(r.value for r in w.collect()) == [2.0, 4.0, 6.0] and w.columns == ["time", "value"]
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(time" in plan and "index" not in plan.split("ReadSchema:")[1].split("\n")[0]
    none = tables.telemetry_window(t, start="2027-01-01 00:00:00")
    assert none.count() == 0 and none.columns == ["time", "readingdef_uid", "value", "index", "instance_id"]
    keys = spark.createDataFrame([("r1",)], "readingdef_uid string")
    assert tables.telemetry_window(t, uids=keys).count() == 5


def test_nested_columns_survive_parquet_and_json(spark, tmp_path):
    df = spark.range(2).select(
        F.when(F.col("id") == 0, "A").otherwise("B").alias("machine"),
        F.array(F.struct(F.lit("x").alias("role"), F.lit(1.5).alias("dev_score"), F.lit("up").alias("direction"))).alias("top_roles"),
    )
    tables.write_parquet(df, str(tmp_path / "p"), ["machine"])
    assert tables.read_parquet(spark, str(tmp_path / "p")).where("machine = 'A'").first().top_roles[0].role == "x"
    tables.write_json_rows(df, str(tmp_path / "j"))
    back = spark.read.schema(df.schema).json(str(tmp_path / "j"))
    assert sorted(r.machine for r in back.collect()) == ["A", "B"] and back.first().top_roles[0].dev_score == 1.5
    tables.write_csv(df.select("machine"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def _files(spark, df):
    """Files that the scan of a partitioned table opened."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    found = [leaves.apply(i) for i in range(leaves.size())]
    return sum(x.metrics().apply("numFiles").value() for x in found if "PartitionFilters: [" in x.toString() and x.metrics().contains("numFiles"))


def test_windows_open_the_files_of_their_dates_only(spark, tmp_path):
    path, start = str(tmp_path / "days"), dt.datetime(2026, 1, 1, 0, 30, tzinfo=UTC)
    at = lambda h: start + dt.timedelta(hours=h)
    rows = [(f"m{h % 3}", at(h), float(h)) for h in range(24 * 20)] + [("m0", None, -1.0)]
    tables.write_by_day(spark.createDataFrame(rows, "machine string, time timestamp, value double"), path)
    assert tables.days_of(spark, path) == [f"2026-01-{d:02d}" for d in range(1, 21)]
    spans = [("m0", at(30), at(40)), ("m0", at(31), at(35)), ("m1", at(47), at(50)), ("m2", at(101), None), ("m1", None, at(5)),
             ("m2", dt.datetime(2025, 1, 1, tzinfo=UTC), dt.datetime(2025, 1, 2, tzinfo=UTC)), ("m2", at(130), at(120))]
    windows = spark.createDataFrame(spans, "machine string, started_on timestamp, ended_on timestamp")
    want = sorted(
        (m, v) for m, t, v in rows if t and any(m == k and a and a <= t <= (z or a) for k, a, z in spans)
    )
    got = tables.window_rows(spark, path, windows, ["machine"])
    assert got.columns == ["machine", "time", "value"]
    assert sorted((r.machine, r.value) for r in got.collect()) == want and len(want) > 5
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        near = tables.scan_days(spark, path, windows.where("started_on is not null"))
        near.collect()
        assert "dynamicpruning" in near._jdf.queryExecution().toString()
        assert 0 < _files(spark, near) <= 5 * 2 < len(list((tmp_path / "days").glob("day=*/*.parquet")))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    far = spark.createDataFrame([("m1", at(470), dt.datetime(9999, 1, 1, tzinfo=UTC))], windows.schema)
    assert {r.value for r in tables.window_rows(spark, path, far, ["machine"]).collect()} == {472.0, 475.0, 478.0}
    assert tables.window_rows(spark, path, windows.limit(0), ["machine"]).count() == 0
