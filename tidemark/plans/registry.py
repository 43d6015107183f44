"""Registry of queries with their DuckDB SQL, and what the query modules share."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where SQL can express it."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[to_digits(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def to_digits(value: Column, digits: int) -> Column:
    """Halves away from zero as in SQL, which looks at the scaled double; ``F.round`` looks at its shortest decimal."""
    scaled = value * 10.0**digits
    return F.when(F.abs(scaled) < math.inf, F.round(scaled) / 10.0**digits).otherwise(value)


def micros(ts: str) -> Column:
    """Microseconds since 2024-01-01, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))
