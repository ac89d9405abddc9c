"""Plant-shaped views over the given tables; the same text is read by Spark and by the SQL oracle.

`{twice}` / `{thrice}` expand each row a fixed two or three times (two spellings of one thing).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import stage, utc

TABLES = ("events", "orders", "lineitem")

# The agreed test mapping, one SELECT per logical table.
VIEWS: dict[str, str] = {
    "ev": """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value,
  CAST(regexp_extract(props,'([0-9]+)',1) AS INT) AS k,
  CAST(user_id % 12 AS INT) AS m,
  concat('M', lpad(CAST(user_id % 12 AS STRING),2,'0')) AS machine,
  CAST(round(value*60) AS BIGINT) AS dur_s
FROM events""",
    "fx_unit": """
SELECT DISTINCT concat('u',CAST(m AS STRING)) AS uid, machine AS name,
  concat('d',CAST(m % 3 AS STRING)) AS device_uid, m < 11 AS is_enabled
FROM ev""",
    "fx_device": """
SELECT DISTINCT concat('d',CAST(m % 3 AS STRING)) AS uid,
  CASE m % 3 WHEN 0 THEN 'FanucFocas' WHEN 1 THEN 'MitsubishiCnc' ELSE 'LibPlc' END AS collector_type_name
FROM ev""",
    "fx_monitor_unit": """
SELECT DISTINCT m + 3 AS id, concat('u',CAST(m AS STRING)) AS unit_uid FROM ev WHERE m < 10""",
    "fx_monitor_reading_def": """
SELECT DISTINCT concat('r',CAST(m AS STRING),'-',event_type,'-',CAST(k % 4 AS STRING)) AS readingdef_uid,
  m + 3 AS unit_id,
  CASE event_type WHEN 'click' THEN 'CYCLE_TIME_MS'
    WHEN 'view' THEN CASE WHEN k % 4 = 3 THEN 'NC_MODE' ELSE 'PROGRAM_POSITION_3' END
    WHEN 'purchase' THEN CASE WHEN k % 4 = 3 THEN 'PIECES_PRODUCED_TOTAL' ELSE 'RUN_TIME' END
    WHEN 'signup' THEN 'RUN_STATUS_START' ELSE 'ALM_ARR_MSG' END AS readingdef_name
FROM ev WHERE m < 10""",
    "fx_mes_reading_def": """
SELECT readingdef_uid AS uid, concat('u',CAST(unit_id - 3 AS STRING)) AS unit_uid,
  concat('i',CAST((unit_id - 3) % 3 AS STRING)) AS instance_id,
  concat(readingdef_name,' ',CAST(r.i AS STRING)) AS display_text, false AS exclude_from_oee
FROM fx_monitor_reading_def {twice}""",
    "fx_telemetry": """
SELECT ts AS time, concat('r',CAST(m AS STRING),'-',event_type,'-',CAST(k % 4 AS STRING)) AS readingdef_uid,
  CASE event_type WHEN 'purchase' THEN CAST(event_id AS DOUBLE) WHEN 'signup' THEN CAST(k % 3 AS DOUBLE)
    WHEN 'view' THEN CASE WHEN k % 4 = 3 THEN CAST(k % 8 AS DOUBLE) ELSE value END ELSE value END AS value,
  k % 3 AS index, concat('i',CAST(m % 3 AS STRING)) AS instance_id
FROM ev WHERE event_type <> 'error' AND m < 10 AND NOT (m >= 8 AND event_type = 'click')""",
    "fx_stops": """
SELECT event_id * 2 + r.i AS id, machine, concat('u',CAST(m AS STRING)) AS unit_uid,
  CASE WHEN k % 10 <= 5 THEN 'Not running' WHEN k % 10 = 6 THEN 'System Offline'
    WHEN k % 10 = 7 THEN 'Waiting for work' WHEN k % 10 = 8 THEN 'Tool change'
    ELSE 'Undefined Stoppage' END AS display_text,
  CASE WHEN k % 25 = 13 THEN CAST(NULL AS BOOLEAN) ELSE k % 10 = 8 END AS is_planned,
  ts AS started_on,
  CASE WHEN k % 20 = 3 THEN NULL
    ELSE ts + (CASE WHEN k % 50 = 0 THEN dur_s*60 ELSE dur_s END) * INTERVAL '1' SECOND END AS ended_on,
  CAST((CASE WHEN k % 50 = 0 THEN dur_s*60 ELSE dur_s END) * 1000 AS DOUBLE) / (1 + r.i) AS duration_milliseconds,
  false AS exclude_from_oee
FROM ev {twice} WHERE event_type='error' AND (r.i = 0 OR k % 33 = 0)""",
    "fx_alerts": """
SELECT machine, concat('u',CAST(m AS STRING)) AS unit_uid, r.i AS index, k % 3 > 0 AS is_array,
  ts - (8*k) * INTERVAL '1' SECOND + r.i * INTERVAL '1' SECOND AS started_on,
  CAST(dur_s*1000 AS DOUBLE) AS duration_milliseconds,
  CASE (k + r.i) % 8 WHEN 0 THEN 'AIR PRESSURE FAILED!' WHEN 1 THEN 'Z AXIS NEED  ZERO RETURN !'
    WHEN 2 THEN 'EMERGENCY STOP.' WHEN 3 THEN 'CHUCK UNCLAMP.' WHEN 4 THEN ' LUBE OIL LAST.'
    WHEN 5 THEN 'DOOR INTERLOCK ALARM.' WHEN 6 THEN 'MOTOR OVERLOAD' ELSE 'UNKNOWN 7' END AS value
FROM ev {thrice} WHERE event_type='error' AND k % 4 = 0 AND r.i <= k % 3""",
    "fx_status": """
SELECT concat('i',CAST(k % 3 AS STRING)) AS instance_id, k % 2 = 1 AS is_online, ts AS started_on,
  CASE WHEN k = 0 THEN NULL ELSE ts + dur_s * INTERVAL '1' SECOND END AS ended_on,
  CAST(dur_s*1000 AS DOUBLE) AS duration_milliseconds
FROM ev WHERE event_type='signup' AND k % 10 = 0 OR event_type='signup' AND k % 25 = 1""",
    "fx_oee_components": """
SELECT machine, concat('u',CAST(m AS STRING)) AS unit_uid, date_trunc('day', ts) AS trans_date,
  CAST(86400000 AS BIGINT) AS WorkTotal,
  least(coalesce(sum(CASE WHEN event_type='error' AND k % 10 = 8 THEN dur_s*1000 END),0),43200000) AS PlannedStop,
  least(coalesce(sum(CASE WHEN event_type='error' AND k % 10 <> 8 THEN dur_s*1000 END),0),60000000) AS UnPlannedStop,
  coalesce(sum(CASE WHEN event_type='click' THEN dur_s*1000 END),0) AS WorkingTime,
  3600000*count(CASE WHEN event_type IN ('click','view') THEN 1 END) AS PlannedTime,
  count(CASE WHEN event_type='purchase' THEN 1 END) AS ProductSum,
  count(CASE WHEN event_type='purchase' AND k < 5 THEN 1 END) AS ScrapeSum
FROM ev GROUP BY machine, m, date_trunc('day', ts)""",
    "fx_oee_all": """
SELECT * FROM fx_oee_components UNION ALL
SELECT 'PLANT' AS machine, 'plant' AS unit_uid, trans_date, sum(WorkTotal), sum(PlannedStop),
  sum(UnPlannedStop), sum(WorkingTime), sum(PlannedTime), sum(ProductSum), sum(ScrapeSum)
FROM fx_oee_components GROUP BY trans_date""",
    "fx_oee_daily": """
SELECT unit_uid, trans_date, CASE WHEN machine = 'PLANT' THEN 0 ELSE 1 END AS level,
  CAST(CAST(UnPlannedStop AS BIGINT) % 7 - 1 AS DOUBLE) AS oee,
  concat('{{"A":',CAST(CAST(UnPlannedStop AS BIGINT) % 7 - 1 AS STRING),',"WorkTotal":',
    CAST(CAST(WorkTotal AS BIGINT) AS STRING),',"PlannedStop":',CAST(CAST(PlannedStop AS BIGINT) AS STRING),
    ',"UnPlannedStop":',CAST(CAST(UnPlannedStop AS BIGINT) AS STRING),'}}') AS availability,
  concat('{{"WorkingTime":',CAST(CAST(WorkingTime AS BIGINT) AS STRING),',"PlannedTime":',
    CAST(CAST(PlannedTime AS BIGINT) AS STRING),'}}') AS performance,
  concat('{{"ProductSum":',CAST(ProductSum AS STRING),',"ScrapeSum":',CAST(ScrapeSum AS STRING),'}}') AS quality
FROM fx_oee_all""",
    "fx_telemetry_string": """
SELECT ts AS time, concat('r',CAST(m AS STRING),'-text-',CAST(k % 2 AS STRING)) AS readingdef_uid,
  concat('PRG-',CAST(k AS STRING)) AS value
FROM ev WHERE event_type = 'signup' AND m < 10""",
    "fx_counter_slice": """
SELECT event_id AS id, concat('u',CAST(m AS STRING)) AS unit_uid,
  CASE WHEN k % 2 = 0 THEN 'COUNT' ELSE 'STOCK_CYCLE' END AS signal_type,
  CASE WHEN k % 7 = 0 THEN NULL ELSE concat('t',CAST(k % 3 AS STRING)) END AS triggered_by, k % 5 AS value
FROM ev WHERE event_type = 'purchase'""",
    "fx_workorder": """
SELECT concat('u',CAST(o_custkey % 12 AS STRING)) AS unit_uid, CAST(o_orderdate AS TIMESTAMP) AS started_on,
  o_orderstatus <> 'P' AS is_stock, o_orderstatus = 'P' AS is_work_order,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS stock_cycle, o_orderpriority AS order_no
FROM orders""",
    "fx_oee_large": """
SELECT concat('S',CAST(l_suppkey AS STRING)) AS machine,
  date_trunc('month', CAST(l_shipdate AS TIMESTAMP)) AS trans_date, CAST(2592000000 AS BIGINT) AS WorkTotal,
  least(CAST(sum(round(l_discount*100))*3600000 AS BIGINT),1000000000) AS PlannedStop,
  least(CAST(sum(round(l_tax*100))*7200000 AS BIGINT),2000000000) AS UnPlannedStop,
  CAST(sum(l_quantity)*600000 AS BIGINT) AS WorkingTime, CAST(count(*)*18000000 AS BIGINT) AS PlannedTime,
  CAST(sum(l_quantity) AS BIGINT) AS ProductSum,
  CAST(coalesce(sum(CASE WHEN l_returnflag='R' THEN l_quantity END),0) AS BIGINT) AS ScrapeSum
FROM lineitem GROUP BY l_suppkey, date_trunc('month', CAST(l_shipdate AS TIMESTAMP))""",
    # The event stream scored with a fixed pseudo-risk; `y` is the true future label.
    "fx_scored": """
SELECT e.event_id, e.machine, e.ts, CAST((e.k*37+11) % 101 AS DOUBLE)/100 AS risk,
  CASE WHEN EXISTS (SELECT 1 FROM fx_stops s WHERE s.machine=e.machine
    AND s.display_text IN ('Not running','Undefined Stoppage') AND s.duration_milliseconds >= 900000
    AND s.started_on > e.ts AND s.started_on <= e.ts + INTERVAL '60' MINUTE) THEN 1 ELSE 0 END AS y
FROM ev e WHERE e.m < 10""",
}

_SPARK = {
    "twice": "LATERAL VIEW explode(array(0,1)) r AS i",
    "thrice": "LATERAL VIEW explode(array(0,1,2)) r AS i",
}
_DUCK = {
    "twice": "CROSS JOIN (VALUES (0),(1)) AS r(i)",
    "thrice": "CROSS JOIN (VALUES (0),(1),(2)) AS r(i)",
}
_NAME = re.compile(r"\b(ev|fx_[a-z_]+)\b")


def _needs(name: str) -> list[str]:
    return [n for n in VIEWS if n != name and n in set(_NAME.findall(VIEWS[name]))]


def ctes(sql: str, extra: dict[str, str] | None = None) -> str:
    """Oracle text: every view the statement reaches becomes a WITH entry, dependencies first."""
    extra = extra or {}
    order: list[str] = []

    def visit(text: str) -> None:
        words = set(re.findall(r"\b[a-z_][a-z_0-9]*\b", text))
        for n in [*VIEWS, *extra]:
            if n in words and n not in order:
                body = VIEWS.get(n) or extra[n]
                if body is not text:
                    visit(body)
                    if n not in order:
                        order.append(n)

    visit(sql)
    parts = []
    for n in order:
        body = VIEWS[n].format(**_DUCK) if n in VIEWS else extra[n]
        parts.append(f"{n} AS ({body.strip()})")
    body = sql.strip()
    if body.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join([*parts, body.removeprefix("WITH RECURSIVE ")])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


class Plant:
    """Lazily built logical tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = utc(spark)
        self.folder = folder.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def memo(self, key: str, build) -> DataFrame:
        """Reuse one analysed frame for every plan that starts from it."""
        if key not in self._frames:
            self._frames[key] = build()
        return self._frames[key]

    def __getattr__(self, short: str) -> DataFrame:
        name = short if short == "ev" else f"fx_{short}"
        if short.startswith("_") or name not in VIEWS:
            raise AttributeError(short)
        return self.view(name)

    def view(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name == "fx_scored":
                self._frames[name] = self._scored()
            else:
                text = VIEWS[name].format(**_SPARK)
                used = {t: self.table(t) for t in TABLES if re.search(rf"\b{t}\b", text)} | {dep: self.view(dep) for dep in _needs(name)}
                for n, frame in used.items():  # names that a user's own views do not meet
                    frame.createOrReplaceTempView(f"_mw_{n}")
                    text = re.sub(rf"\b{n}\b(?=[\s)]|$)", f"_mw_{n}", text)
                self._frames[name] = self.spark.sql(text)
                for n in used:
                    self.spark.catalog.dropTempView(f"_mw_{n}")
        return self._frames[name]

    def _scored(self) -> DataFrame:
        """Same rows as the view text, with the label found by an as-of join instead of EXISTS.

        Scored risk is a table every consumer starts from, so it is written once.
        """
        from pyspark.sql import functions as F

        from ..operators.predict import future_label

        ev = self.view("ev").where("m < 10")
        risk = (F.pmod(F.col("k") * 37 + 11, F.lit(101))).cast("double") / 100
        rows = ev.select("event_id", "machine", "ts", risk.alias("risk"))
        stops = self.view("fx_stops").where(
            "display_text IN ('Not running','Undefined Stoppage') AND duration_milliseconds >= 900000"
        )
        stops = stops.select("machine", F.col("started_on").alias("start"))
        return stage(future_label(rows, stops, horizon_min=60), "risk")


_PLANTS: dict[tuple, Plant] = {}


def _state(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of what lies in the folder, by the file system that Spark reads it from."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in found))


def plant(spark: SparkSession, folder: str) -> Plant:
    """The views of a folder, built anew when its files have changed."""
    key = (id(spark), folder, _state(spark, folder))
    if key not in _PLANTS or _PLANTS[key].spark is not spark:
        _PLANTS.clear()
        _PLANTS[key] = Plant(spark, folder)
    utc(spark)
    return _PLANTS[key]


def forget() -> None:
    """Drop analysed frames and staged tables, so the next plan starts from the raw tables."""
    _PLANTS.clear()
