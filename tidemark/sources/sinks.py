"""Sinks: day partitions, ordered result tables, restart snapshots and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_days(df: DataFrame, path: str, date: str, parquet: bool = True) -> None:
    """Rows by (year, doy) folders, Parquet or gzipped CSV; only the days that ``df`` has are replaced."""
    dated = df.withColumn("year", F.year(date)).withColumn("doy", F.dayofyear(date)).repartition("year", "doy")
    writer = dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "doy")
    if parquet:
        writer.parquet(path)
    else:
        writer.option("header", True).option("compression", "gzip").csv(path)


def write_result(df: DataFrame, path: str, order: list[str | Column]) -> None:
    """An ordered CSV table with a header, as range partitions in order of their file names; null is an empty cell.

    The order is explicit and no single task gets the table, so it may be of any size.
    """
    df.orderBy(*order).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_snapshot(df: DataFrame, path: str, keys: list[str]) -> None:
    """A restart point: the partitions of ``keys`` in ``df`` replace their own, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def manifest(df: DataFrame, title: str, columns: list[str]) -> DataFrame:
    """``(line)``: the text of a report, a heading and then ``column: n / nulls / least / most`` for each column.

    The figures are one aggregation, so the text is a few rows whatever the table's size.
    """
    figures = df.agg(F.count("*").alias("n"), *[
        f for i, c in enumerate(columns) for f in (F.count(c).alias(f"k{i}"), F.min(c).cast("string").alias(f"a{i}"), F.max(c).cast("string").alias(f"b{i}"))])
    lines = [F.lit(title), F.concat(F.lit("rows: "), F.col("n").cast("string"))]
    for i, c in enumerate(columns):
        part = [F.coalesce(x.cast("string"), F.lit("-")) for x in (F.col(f"k{i}"), F.col("n") - F.col(f"k{i}"), F.col(f"a{i}"), F.col(f"b{i}"))]
        lines.append(F.concat(F.lit(f"{c}: "), F.concat_ws(" / ", *part)))
    return figures.select(F.explode(F.array(*lines)).alias("line"))


def write_manifest(df: DataFrame, path: str, title: str, columns: list[str]) -> None:
    manifest(df, title, columns).write.mode("overwrite").text(path)
