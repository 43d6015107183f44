"""Restart by a log of finished units (days, months): written aside, published by one row, read only if published.

A unit's table is written to a folder of its own; only when that write is done does a row of the log name
it. The log is a Parquet table to which each publication appends one file, which Spark puts in place
as a whole. So a stopped run leaves what was published before, and writing a unit again replaces it at
once. Folders that no row names are leftovers of stopped or replaced runs.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "unit string, at long, folder string"


def write_aside(df: DataFrame, root: str, unit: str) -> str:
    """Write the unit's rows to a new folder, which nobody reads yet; gives its name."""
    folder = f"{unit}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/data/{folder}")
    return folder


def publish(spark: SparkSession, root: str, unit: str, folder: str) -> None:
    """Make a written folder the unit's table."""
    spark.createDataFrame([(unit, time.time_ns(), folder)], LOG).coalesce(1).write.mode("append").parquet(f"{root}/log")


def commit(df: DataFrame, root: str, unit: str) -> None:
    publish(df.sparkSession, root, unit, write_aside(df, root, unit))


def log(spark: SparkSession, root: str) -> DataFrame:
    """``(unit, folder)``: what is published last for each unit; nothing where there is no log yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/log")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "unit string, folder string")
    return spark.read.schema(LOG).parquet(f"{root}/log").groupBy("unit").agg(F.max_by("folder", "at").alias("folder"))


def committed(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The rows of all published units; the names of their folders, one for each unit, pass through the driver."""
    folders = sorted(r.folder for r in log(spark, root).select("folder").collect())
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/data/{f}" for f in folders])


def unfinished(units: DataFrame, root: str) -> DataFrame:
    """The ``units`` (a column ``unit``) that are not published: what a run that goes on has to do."""
    return units.join(log(units.sparkSession, root).select("unit"), "unit", "left_anti")
