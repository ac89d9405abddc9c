"""Query registry: each entry is a Spark plan over one data folder plus, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixtures import ctes, plant

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHARED: dict[str, str] = {}
"""Named oracle sub-queries (plain SQL text) that several oracles build upon."""


def shared(name: str, sql: str) -> None:
    SHARED[name] = sql


def tidy(df: DataFrame) -> DataFrame:
    """Output contract: doubles to 6 decimals (never -0.0), instants as zone-free UTC timestamps.

    Rounding goes through 8 decimals first so that a value on a rounding boundary does not depend on
    the order in which an average was summed.
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(F.round(c.cast("double"), 8), 6) + F.lit(0.0)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def rnd(x: str, digits: int) -> str:
    """Half-up rounding in exact decimals (DuckDB rounds doubles by scaling, which misses decimal ties)."""
    return f"CAST(round(CAST({x} AS DECIMAL(30,8)), {digits}) AS DOUBLE)"


def rnd_even(x: str, digits: int) -> str:
    """Half-even rounding in exact decimals."""
    y = f"(CAST({x} AS DECIMAL(28,8)) * {10 ** digits})"
    return (
        f"(CAST(CASE WHEN {y} - floor({y}) > 0.5 THEN floor({y}) + 1 WHEN {y} - floor({y}) < 0.5 THEN floor({y}) "
        f"WHEN CAST(floor({y}) AS HUGEINT) % 2 = 0 THEN floor({y}) ELSE floor({y}) + 1 END AS DOUBLE) / {10 ** digits})"
    )


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register `fn(plant) -> DataFrame`; `doubles` names the oracle columns to round."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(plant(spark, sf_dir)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            body = sql.strip()
            if doubles:
                repl = ", ".join(
                    f"{rnd(c, 6)} + 0.0::DOUBLE AS {c}" for c in doubles.split()
                )
                body = f"SELECT * REPLACE ({repl}) FROM (\n{body}\n) AS answer"
            ORACLES[name] = body
        return fn

    return wrap


def oracle_texts() -> dict[str, str]:
    """Complete statements: each oracle with the views and shared sub-queries it reaches."""
    return {name: ctes(body, SHARED) for name, body in ORACLES.items()}
