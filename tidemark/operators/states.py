"""Mergeable states of paired statistics: a row for each group and day, merged to longer spans without a scan of rows.

A state holds moments and a KLL sketch of the residuals, a few kilobytes whatever the day's rows. Count,
bias, MAE, RMSE, deviation and correlation of a merged state are those of all its rows; quantiles are of
rank error ``RANK_ERROR`` at most, with a chance of 0.99. States are stored by month; a day is replaced by
writing its month's states anew, from the states of the other days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .selection import finite

#: Size of a sketch, and the rank error of a quantile that it stands for.
SKETCH = 400
RANK_ERROR = 0.01


def day_states(rows: DataFrame, keys: list[str], day: str, method: str, reference: str) -> DataFrame:
    """``(keys, day, state columns)`` of the rows that have both values, finite."""
    m, r = F.col(method), F.col(reference)
    res = m - r
    n = F.count("*")
    return rows.where(finite(m) & finite(r)).groupBy(*keys, F.col(day).alias("day")).agg(
        n.alias("n"), F.avg(res).alias("mean_res"), F.avg(m).alias("mean_m"), F.avg(r).alias("mean_r"), F.sum(F.abs(res)).alias("abs_res"),
        (F.var_pop(res) * n).alias("ss_res"), (F.var_pop(m) * n).alias("ss_m"), (F.var_pop(r) * n).alias("ss_r"), (F.covar_pop(m, r) * n).alias("ss_mr"),
        F.kll_sketch_agg_double(res, F.lit(SKETCH)).alias("sketch"))


def merge(states: DataFrame, keys: list[str]) -> DataFrame:
    """One state for each of ``keys``, of all days that have them.

    Sums of squares are those within the days and those of the days' means about the common mean, which
    is known first (a window over the days of a group), so large values lose no digits.
    """
    n, whole = F.sum("n"), Window.partitionBy(*keys)
    means = ("mean_res", "mean_m", "mean_r")
    off = {f"_{c}": F.col(c) - F.sum(F.col("n") * F.col(c)).over(whole) / n.over(whole) for c in means}
    mean = lambda c: F.sum(F.col("n") * F.col(c)) / n
    about = lambda ss, a, b: F.sum(ss) + F.sum(F.col("n") * F.col(f"_{a}") * F.col(f"_{b}"))
    return states.withColumns(off).groupBy(*keys).agg(
        n.alias("n"), *[mean(c).alias(c) for c in means], F.sum("abs_res").alias("abs_res"),
        about("ss_res", "mean_res", "mean_res").alias("ss_res"), about("ss_m", "mean_m", "mean_m").alias("ss_m"), about("ss_r", "mean_r", "mean_r").alias("ss_r"),
        about("ss_mr", "mean_m", "mean_r").alias("ss_mr"), F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("sketch"))


def statistics(states: DataFrame, keys: list[str], quantiles: dict[str, float] | None = None) -> DataFrame:
    """``(keys, n, bias, mae, rmse, std, r)`` of states, and quantiles of the residuals by name."""
    at = {} if quantiles is None else quantiles
    variance = F.greatest(F.lit(0.0), F.col("ss_res")) / F.col("n")
    r = F.try_divide(F.col("ss_mr"), F.nullif(F.sqrt(F.greatest(F.lit(0.0), F.col("ss_m") * F.col("ss_r"))), F.lit(0.0)))
    return states.select(
        *keys, "n", F.col("mean_res").alias("bias"), (F.col("abs_res") / F.col("n")).alias("mae"), F.sqrt(variance + F.col("mean_res") * F.col("mean_res")).alias("rmse"), F.sqrt(variance).alias("std"), r.alias("r"),
        *[F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in at.items()])


def _by_month(states: DataFrame) -> DataFrame:
    return states.withColumns({"year": F.year("day"), "month": F.month("day")})


def store(states: DataFrame, path: str) -> None:
    """Write day states as a table; what was there goes."""
    _by_month(states).repartition("year", "month").write.mode("overwrite").partitionBy("year", "month").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def replace_days(states: DataFrame, path: str) -> None:
    """Put the days of ``states`` in the place of the stored ones; other days and other months stay as they are.

    The months concerned are written aside first and then take the place of the old ones, partition by
    partition, so a stopped run leaves each month old or new.
    """
    spark = states.sparkSession
    new = _by_month(states)
    months = new.select("year", "month").distinct()
    days = new.select(F.col("day").alias("new_day")).distinct()
    kept = stored(spark, path).join(months, ["year", "month"], "left_semi").join(days, F.col("day") == F.col("new_day"), "left_anti")
    aside = f"{path.rstrip('/')}-aside"
    kept.unionByName(new).write.mode("overwrite").parquet(aside)
    spark.read.parquet(aside).repartition("year", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path)
