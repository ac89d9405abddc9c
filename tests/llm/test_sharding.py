"""Jump hashing against the plain loop, and the law that a further shard takes rows only into itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwright.llm import sharding


def plain(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 8, 1000])
def test_jump_equals_the_plain_loop(shards):
    keys = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2)
    before = keys.copy()
    assert sharding.jump(keys, shards).tolist() == [plain(int(k), shards) for k in before]
    assert (keys == before).all()


def test_slots_and_growth(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 50).alias("size"), F.lit("x").alias("slot")).repartition(5)
    got = sharding.shard(df, ["doc_id"], 8, 9, size=F.col("size")).toPandas()
    assert len(got) == 3000 and got.columns.tolist().count("slot") == 1
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
        assert 250 < len(g) < 500
    moved = got[got["shard"] != got["grown_shard"]]
    assert (moved["grown_shard"] == 8).all() and 200 < len(moved) < 470
    again = sharding.shard(df.repartition(2), ["doc_id"], 8, size=F.col("size")).toPandas().set_index("doc_id")
    assert (again.loc[got["doc_id"], "shard"].to_numpy() == got["shard"].to_numpy()).all()


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(None, 1), (None, 2), (7, 1), (7, 1), (7, 1), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, size long")
    got = sharding.shard(df, ["doc_id"], 4, size=F.col("size")).toPandas()
    assert len(got) == 6 and got[got["doc_id"] == 7]["shard"].nunique() == 1 and got[got["doc_id"].isna()]["shard"].nunique() == 1
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert sharding.shard(df.limit(0), ["doc_id"], 4).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(df, ["doc_id"], 0)


def test_working_names_do_not_clash(spark):
    df, names = spark.range(300).select(F.col("id").alias("doc_id")), ["_h", "_b", "_i", "_s", "_r", "_n", "_before", "c0", "c1"]
    for n in names:
        df = df.withColumn(n, F.lit(n))
    got = sharding.shard(df, ["doc_id"], 4, 5, size=F.col("doc_id") % 7)
    assert got.columns == ["doc_id", *names, "shard", "grown_shard", "slot"]
    rows = got.collect()
    assert len(rows) == 300 and all(r[n] == n for r in rows for n in names)
    want = sharding.shard(df.select("doc_id"), ["doc_id"], 4, 5).select("doc_id", "shard", "grown_shard").collect()
    assert sorted((r.doc_id, r.shard, r.grown_shard) for r in rows) == sorted(map(tuple, want))
