"""The scan primitives against brute force on random data with a hot key, ties and tiny slices."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millwright.functions.timex import us
from millwright.operators import scan

T0 = pd.Timestamp("2026-01-01")


def random_rows(seed, n, span_s=7200, step_s=30):
    """One machine owns most rows; instants repeat."""
    r = np.random.default_rng(seed)
    m = np.where(r.random(n) < 0.6, "HOT", np.array(["A", "B"])[r.integers(0, 2, n)])
    t = T0 + pd.to_timedelta(r.integers(0, span_s // step_s, n) * step_s, unit="s")
    return pd.DataFrame({"machine": m, "ts": t, "v": np.round(r.normal(size=n), 2), "id": np.arange(n)})


@pytest.mark.parametrize("direction,exact", [("backward", True), ("backward", False), ("forward", True), ("forward", False)])
def test_asof_matches_brute_force(spark, direction, exact):
    left, right = random_rows(1, 120), random_rows(2, 60)
    right["s"] = right["ts"]
    got = scan.asof(
        spark.createDataFrame(left), spark.createDataFrame(right[["machine", "s", "id"]]), ["machine"], us("ts"), us("s"), ["id"],
        direction=direction, exact=exact, tolerance_us=600_000_000, slice_s=300,
    ).select("id", "hit.t", F.col("hit.id").alias("rid")).toPandas().set_index("id")
    assert len(got) == len(left)
    for row in left.itertuples():
        c = right[right.machine == row.machine]
        if direction == "backward":
            c = c[(c.s <= row.ts) if exact else (c.s < row.ts)].sort_values(["s", "id"]).tail(1)
        else:
            c = c[(c.s >= row.ts) if exact else (c.s > row.ts)].sort_values(["s", "id"]).head(1)
        if len(c) and abs((c.s.iloc[0] - row.ts).total_seconds()) <= 600:
            assert got.loc[row.id, "rid"] == c.id.iloc[0]
        else:
            assert pd.isna(got.loc[row.id, "rid"])


def test_interval_flag_matches_brute_force(spark):
    p, iv = random_rows(3, 150), random_rows(4, 25)
    iv["e"] = iv["ts"] + pd.to_timedelta(np.arange(25) * 11 % 400, unit="s")
    iv.loc[iv.index % 5 == 0, "e"] = pd.NaT
    got = scan.in_any_interval(
        spark.createDataFrame(p), spark.createDataFrame(iv[["machine", "ts", "e"]].rename(columns={"ts": "s"})), ["machine"],
        us("ts"), us("s"), us("e"), slice_s=200,
    ).toPandas().set_index("id").inside
    for row in p.itertuples():
        c = iv[iv.machine == row.machine]
        assert got[row.id] == bool(((c.ts <= row.ts) & (c.e.fillna(c.ts) >= row.ts)).any())


@pytest.mark.parametrize("strict", [True, False])
def test_range_max_matches_brute_force(spark, strict):
    q, s = random_rows(5, 100), random_rows(6, 200)
    got = scan.range_max(
        spark.createDataFrame(q[["machine", "ts", "id"]]), spark.createDataFrame(s), ["machine"], us("ts"), us("ts"), F.col("v"),
        600_000_000, strict=strict,
    ).toPandas().set_index("id").peak
    for row in q.itertuples():
        lo = row.ts - pd.Timedelta("10min")
        c = s[s.machine == row.machine]
        c = c[(c.ts > lo) & (c.ts < row.ts)] if strict else c[(c.ts >= lo) & (c.ts <= row.ts)]
        assert (pd.isna(got[row.id]) and c.empty) or got[row.id] == c.v.max()


def test_islands_cross_slices(spark):
    rows = random_rows(7, 80, span_s=20000, step_s=60)
    got = scan.islands(spark.createDataFrame(rows), ["machine"], "ts", 300_000_000, slice_s=120).toPandas()
    for m, g in rows.sort_values("ts").groupby("machine"):
        want = (g.ts.diff() > pd.Timedelta("5min")).cumsum() + 1
        have = got[got.machine == m].set_index("id").island
        assert (have[g.id].to_numpy() == want.to_numpy()).all()


def test_percentiles_and_ranks(spark):
    rows = random_rows(8, 300)
    df = spark.createDataFrame(rows)
    q = scan.percentiles(df, ["machine"], "v", {"a": 0.05, "b": 0.5, "c": 0.95}, count="n").toPandas().set_index("machine")
    for m, g in rows.groupby("machine"):
        assert np.allclose(q.loc[m, ["a", "b", "c"]].astype(float), np.percentile(g.v, [5, 50, 95]))
        assert q.loc[m, "n"] == len(g)
    r = scan.rank_share(df, ["machine"], "v").toPandas().set_index("id").pct
    want = rows.groupby("machine").v.rank(pct=True)
    assert np.allclose(r[rows.id].to_numpy(), want.to_numpy())
    assert scan.percentiles(df, [], "v", {"m": 0.5}).first()["m"] == pytest.approx(float(np.median(rows.v)))


@pytest.mark.parametrize("block", [8, 64, 4096])
def test_ewma_matches_pandas(spark, block):
    rows = random_rows(9, 200)
    rows.loc[rows.index % 6 == 0, "v"] = np.nan
    df = spark.createDataFrame(rows).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    n = scan.row_index(df, ["machine"], "ts", ties=("id",), slice_s=300)
    got = scan.ewma(n, ["machine"], "rn", "v", 0.05, block=block).toPandas()
    for m, g in rows.sort_values(["ts", "id"]).groupby("machine"):
        want = g.v.ewm(alpha=0.05).mean()
        have = got[got.machine == m].set_index("id").ewma[g.id]
        assert np.allclose(have.to_numpy(dtype=float), want.to_numpy(), equal_nan=True)


def test_row_index_and_overall(spark):
    rows = random_rows(10, 150)
    got = scan.row_index(spark.createDataFrame(rows), ["machine"], "ts", ties=("id",), slice_s=60, overall={"size": ("count", F.lit(1))}).toPandas()
    for m, g in rows.sort_values(["ts", "id"]).groupby("machine"):
        have = got[got.machine == m].set_index("id")
        assert have.rn[g.id].tolist() == list(range(1, len(g) + 1))
        assert (have["size"] == len(g)).all()


def test_rolling_blocks_equal_pandas(spark):
    from millwright.operators.predict import rolling_stats

    rows = random_rows(11, 400).drop_duplicates(["machine", "ts"])
    rows.loc[rows.index % 7 == 0, "v"] = np.nan
    df = spark.createDataFrame(rows).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = rolling_stats(df, ["v"], 5, 20, block=20).toPandas()
    for m, g in rows.sort_values("ts").groupby("machine"):
        have = got[got.machine == m].set_index("id").loc[g.id]
        for col, want in (
            ("v__roll_mean", g.v.rolling(5, min_periods=3).mean()), ("v__roll_std", g.v.rolling(5, min_periods=3).std()),
            ("v__slope", g.v - g.v.shift(5)), ("v__long_mean", g.v.rolling(20, min_periods=5).mean()),
        ):
            assert np.allclose(have[col].to_numpy(dtype=float), want.to_numpy(), equal_nan=True, atol=1e-7), col


def test_hot_key_is_spread_over_tasks(spark):
    """A single machine's running total is computed by many (key, slice) groups, not one."""
    rows = spark.range(0, 20000).select(F.lit("HOT").alias("machine"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit(1).alias("x"))
    out = scan.row_index(rows, ["machine"], "ts", slice_s=86400)
    assert out.agg(F.max("rn")).first()[0] == 20000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__sl" in plan
    sizes = rows.groupBy("machine", F.floor(F.unix_micros("ts") / 86_400_000_000)).count().agg(F.max("count")).first()[0]
    assert sizes <= 1440


@pytest.mark.parametrize("alpha", [0.01, 0.05, 0.3, 0.5, 0.9])
def test_ewma_of_long_rows_and_null_runs(spark, alpha):
    """The recursion at the default block, with NULL runs over several blocks at the start, inside and at the end."""
    n = 30_000
    x = np.where(np.arange(n) % 3 > 0, np.round(np.random.default_rng(4).normal(size=n), 3) + 5, np.nan)
    x[:50] = x[200:14_000] = x[16_000:16_500] = x[25_000:] = np.nan
    want, num, den, q = [], 0.0, 0.0, 1 - alpha
    last = None
    for v in x:
        num, den = num * q, den * q
        if not np.isnan(v):
            num, den = num + v, den + 1
            last = num / den
        want.append(last)
    df = spark.createDataFrame(pd.DataFrame({"machine": "A", "rn": np.arange(1, n + 1), "v": x})).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = scan.ewma(df, ["machine"], "rn", "v", alpha).orderBy("rn").toPandas().ewma
    have = np.array([np.nan if v is None else v for v in want], float)
    assert got.isna().tolist() == np.isnan(have).tolist()
    assert np.nanmax(np.abs(got.to_numpy() - have)) < 1e-9


def test_ewma_refuses_other_weights(spark):
    with pytest.raises(ValueError):
        scan.ewma(spark.createDataFrame([("A", 1, 1.0)], "machine string, rn int, v double"), ["machine"], "rn", "v", 1.0)


def test_narrow_values_spread_over_slices(spark):
    """A million distinct values in [100, 101) are cut into even slices, and their percentiles stay exact."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("A").alias("k"), (100 + F.col("id") / n).alias("v"))
    sizes = scan.value_slices(df, ["k"], "v", 64).groupBy("__slice").count().toPandas()["count"]
    assert len(sizes) == 64 and sizes.max() < 3 * n / 64
    got = scan.percentiles(df, ["k"], "v", {"p25": 0.25, "p50": 0.5}, count="n").first()
    assert got.n == n and got.p25 == pytest.approx(100 + (n - 1) / 4 / n) and got.p50 == pytest.approx(100 + (n - 1) / 2 / n)
