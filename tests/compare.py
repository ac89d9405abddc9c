"""Compare registered queries with their SQL oracles in DuckDB, ignoring row order.

Usage: python tests/compare.py [--sf 0.01] [key ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

ROOT = "/root/testdata"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet'")
    return con


def canon(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(v)
    if hasattr(v, "item"):
        return canon(v.item())
    if isinstance(v, pd.Timestamp):
        return v.tz_localize(None).isoformat() if v.tzinfo else v.isoformat()
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def rows(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    data = [tuple(canon(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False, name=None)]
    return cols, sorted(data, key=lambda r: tuple((x is None, str(type(x).__name__ == "str"), str(x)) for x in r))


def same(a, b, tol=2e-6):
    if isinstance(a, bool) or isinstance(b, bool):
        return a == b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return abs(a - b) <= tol * max(1.0, abs(a), abs(b)) * 1e-3 or a == b
    return a == b


def check(spark, con, key, folder):
    from millwright.plans import all_queries

    q, o = all_queries()
    t0 = time.time()
    got = q[key](spark, folder).toPandas()
    dt = time.time() - t0
    if key not in o:
        return f"rows {len(got):6d} {dt:6.1f}s (no oracle)", len(got) > 0
    t1 = time.time()
    want = con.execute(o[key]).df()
    do = time.time() - t1
    gc, gr = rows(got)
    wc, wr = rows(want)
    if gc != wc:
        return f"COLUMNS {gc} vs {wc}", False
    if len(gr) != len(wr):
        return f"ROWCOUNT {len(gr)} vs {len(wr)}", False
    exact = gr == wr
    if not exact:
        bad = [(x, y) for x, y in zip(gr, wr) if x != y]
        near = all(all(same(a, b) for a, b in zip(x, y)) for x, y in bad)
        msg = f"{'NEAR' if near else 'DIFF'} {len(bad)}/{len(gr)} cols={gc}\n    spark {bad[0][0]}\n    duck  {bad[0][1]}"
        return msg, False
    return f"ok {len(gr):6d} rows spark {dt:5.1f}s duck {do:5.1f}s", len(gr) > 0


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("millwright-check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    from millwright.plans import all_queries

    folder = f"{ROOT}/sf{sf}"
    keys = argv or list(all_queries()[0])
    spark, con = session(), duck(folder)
    failed = []
    for k in keys:
        try:
            msg, ok = check(spark, con, k, folder)
        except Exception as e:  # report and go on
            msg, ok = f"ERROR {type(e).__name__}: {str(e)[:1500]}", False
        if not ok:
            failed.append(k)
        print(f"{k:28s} {msg}", flush=True)
    print(f"{len(keys) - len(failed)}/{len(keys)} good; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
