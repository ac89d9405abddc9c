"""Shards by jump consistent hashing: no ring table, and a further shard takes rows only into itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered

BUCKETS = 4096
"""Slots are numbered in this many hash ranges per shard, so no shard is sorted in one task."""


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, all keys at once; the rounds needed grow with the logarithm of `shards`."""
    key = keys.astype(np.uint64)
    shard = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.float64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = ahead[live].astype(np.int64)
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead[live] = np.floor((shard[live] + 1) * (2147483648.0 / ((key[live] >> np.uint64(33)).astype(np.float64) + 1)))
        live = live[ahead[live] < shards]
    return shard


def jump_column(key: Column, shards: int) -> Column:
    """`key`: a non-null long column."""

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64, copy=True).view(np.uint64), shards).astype(np.int32))

    return of(key)


def shard(df: DataFrame, keys: list[str], shards: int, grown: int | None = None, size: Column | None = None) -> DataFrame:
    """`df` with shard, slot and, if `grown` is given, grown_shard.

    The shard depends on the key columns and the shard count alone: null is a key of its own, equal keys meet. Slots are
    gapless from 0 in a shard. They are numbered inside hash ranges (BUCKETS for each shard) whose counts are then added
    up; the range is drawn from the key and from `size`, so the rows of a repeated key with different sizes spread.
    Rows that agree in key and size are numbered in any order. An empty table stays empty. Columns of `df` named like an
    added one are replaced, others are carried whatever their names.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    if size is not None:
        df = df.withColumn("slot", size)  # replaced below
    carried, names = numbered(df, "shard", "grown_shard")
    keys = [F.col(f"c{names.index(k)}") for k in keys]
    added = {"shard": jump_column(F.col("_h"), shards)}
    if grown is not None:
        added["grown_shard"] = jump_column(F.col("_h"), grown)
    spread = [F.col("_h"), *([] if size is None else [F.col(f"c{names.index('slot')}")])]
    placed = (
        carried.withColumn("_h", F.xxhash64(*keys)).withColumns(added)
        .withColumn("_b", F.pmod(F.xxhash64(*spread), F.lit(BUCKETS)).cast("int"))
    )
    counts = placed.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(
        F.col("shard").alias("_s"), F.col("_b").alias("_r"),
        (F.sum("_n").over(Window.partitionBy("shard").orderBy("_b")) - F.col("_n")).alias("_before"),
    )
    order = Window.partitionBy("shard", "_b").orderBy(*spread, *keys)
    out = placed.withColumn("_i", F.row_number().over(order)).join(
        before, (F.col("shard") == F.col("_s")) & (F.col("_b") == F.col("_r"))
    )
    old = [(f"c{i}", n) for i, n in enumerate(names) if n.lower() != "slot"]
    return out.select(
        *[F.col(c).alias(n) for c, n in old], *added, (F.col("_before") + F.col("_i") - 1).alias("slot"),
    )
