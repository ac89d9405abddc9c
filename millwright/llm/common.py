"""Shared helpers: reading tables, staging between steps, bounded slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.session import stage

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SLICE_BYTES = 1 << 20
"""Text bytes that a task works on at once; a longer single text is its own slice."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and go on from the table; the shuffle files behind it are released at once."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return stage(df, name)
    finally:
        spark.conf.set(CLEANUP, before)


def numbered(df: DataFrame, *added: str) -> tuple[DataFrame, list[str]]:
    """`df` without the columns `added`, the others renamed c0, c1, ... so that no working column clashes, and their names."""
    names = [n for n in df.columns if n.lower() not in added]
    return df.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)]), names


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches where `column` reaches `limit` bytes, so that working memory does not follow the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(text_buffer(batch.column(column))[1])
        group = np.concatenate(([0], np.cumsum(sizes)[:-1])) // limit
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets into them; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the half-open ranges, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
