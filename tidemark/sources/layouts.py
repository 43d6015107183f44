"""Layouts of stored tables that spare later reads: files along a Morton curve with a manifest, and buckets by join keys.

A Morton code interleaves the bits of several columns, so each file of a table that is cut along it is
a small box in all of them; the manifest holds each file's box, and a scan opens only files whose box
meets the asked one. Row groups are pruned further by Parquet's own statistics, as rows are sorted.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Box = Mapping[str, tuple[Any, Any]]


def morton(parts: list[Column], bits: int) -> Column:
    """Whole numbers of so many bits each, interleaved to one long; ``bits * len(parts)`` is at most 63."""
    if bits * len(parts) > 63:
        raise ValueError("a code has 63 bits at most")
    one = [F.shiftleft(F.shiftright(p, i).bitwiseAND(F.lit(1)).cast("long"), i * len(parts) + d) for i in range(bits) for d, p in enumerate(parts)]
    return reduce(lambda a, b: a.bitwiseOR(b), one)


def _number(df: DataFrame, name: str) -> Column:
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(name)).cast("double")
    return F.col(name).cast("double")


def write_z_ordered(df: DataFrame, path: str, columns: list[str], files: int, bits: int = 10) -> None:
    """``df`` as about so many Parquet files along the Morton curve of numeric or time columns, with their manifest.

    Bounds are one row of aggregates. Files are ranges of (code, hash of the row), so rows of one code may
    fill many files. Missing values stand with the least ones; values that are no number with the greatest.
    """
    number = {c: F.when(~F.isnan(_number(df, c)), _number(df, c)) for c in columns}
    bounds = df.agg(*[f(number[c]).alias(f"{n}{k}") for k, c in enumerate(columns) for n, f in (("a", F.min), ("b", F.max))]).first()
    top = (1 << bits) - 1
    cells = []
    for k, c in enumerate(columns):
        low, high = bounds[f"a{k}"] or 0.0, bounds[f"b{k}"] or 0.0
        share = (number[c] - low) / ((high - low) or 1.0)
        cells.append(F.when(F.isnan(_number(df, c)), top).otherwise(F.coalesce(F.floor(share * top), F.lit(0))).cast("int"))
    coded = df.withColumn("_z", morton(cells, bits)).withColumn("_h", F.xxhash64(*[F.col(c) for c in df.columns]))
    coded.repartitionByRange(files, "_z", "_h").sortWithinPartitions("_z").drop("_z", "_h").write.mode("overwrite").parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    boxes = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("least", F.min), ("most", F.max))]
    found = stored.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("n"), *boxes)
    found.write.mode("overwrite").parquet(f"{path}/manifest")


def _meets(box: Box) -> Column:
    tests = [(F.col(f"most_{c}") >= F.lit(low)) & (F.col(f"least_{c}") <= F.lit(high)) for c, (low, high) in box.items()]
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def z_scan(spark: SparkSession, path: str, box: Box) -> DataFrame:
    """Rows inside the box, both bounds included; files whose own box does not meet it are not opened.

    The names of the files that are read pass through the driver, as with any scan.
    """
    names = sorted(r.file for r in spark.read.parquet(f"{path}/manifest").where(_meets(box)).select("file").collect())
    whole = spark.read.parquet(f"{path}/rows")
    rows = spark.read.schema(whole.schema).parquet(*names) if names else whole.where(F.lit(False))
    for c, (low, high) in box.items():
        rows = rows.where(F.col(c).between(F.lit(low), F.lit(high)))
    return rows


def z_cost(spark: SparkSession, path: str, box: Box) -> DataFrame:
    """``(files, files_read, bytes, bytes_read)`` of a scan of the box, from the manifest."""
    read = _meets(box)
    return spark.read.parquet(f"{path}/manifest").agg(
        F.count("*").alias("files"), F.count_if(read).alias("files_read"), F.sum("bytes").alias("bytes"), F.coalesce(F.sum(F.when(read, F.col("bytes"))), F.lit(0)).alias("bytes_read"))


def write_bucketed(df: DataFrame, name: str, path: str, keys: list[str], buckets: int, unique: bool = False) -> None:
    """``df`` as the table ``name`` in buckets by ``keys``, one sorted file a bucket; with ``unique`` a repeated key is an error.

    The check reads the buckets as they are, so it shuffles nothing; keys with a null are not compared.
    """
    df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    if unique:
        twice = df.sparkSession.table(name).dropna(subset=keys).groupBy(*keys).count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"key of {name} is not unique: {', '.join(f'{k}={twice[0][k]}' for k in keys)}")


def bucketed_join(spark: SparkSession, left: str, right: str, keys: list[str], how: str = "left") -> DataFrame:
    """Join of two tables with the same buckets by ``keys``: buckets are merged side by side, without a shuffle."""
    return spark.table(left).join(spark.table(right).hint("merge"), keys, how)
