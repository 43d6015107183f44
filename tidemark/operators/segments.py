"""Ordered series: differences, gaps, robust jumps, arcs and their edges. All by series, all windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order(series: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*series).orderBy(*order)


def gap_segments(df: DataFrame, series: list[str], order: list[str], time: str, longest: float) -> DataFrame:
    """Adds ``dt`` and ``segment_id``: a step that is null, not positive or over ``longest`` starts one."""
    w = in_order(series, order)
    dt = F.col(time) - F.lag(time).over(w)
    starts = F.coalesce(((F.col("dt") <= 0) | (F.col("dt") > longest)).cast("int"), F.lit(1))
    return df.withColumn("dt", dt).withColumn("segment_id", F.sum(starts).over(w) - 1)


def nominal_step(df: DataFrame, series: list[str], order: list[str], time: str) -> DataFrame:
    """Median positive step and its inverse for each series."""
    steps = df.withColumn("dt", F.col(time) - F.lag(time).over(in_order(series, order)))
    step = F.percentile(F.when(F.col("dt") > 0, F.col("dt")), 0.5)
    return steps.groupBy(*series).agg(step.alias("step"), F.try_divide(F.lit(1.0), step).alias("rate"))


def mad_jumps(df: DataFrame, series: list[str], order: list[str], value: str, floor: float, factor: float = 12.0, least: int = 10) -> DataFrame:
    """Adds ``diff``, ``limit`` and ``jump``: |diff - median| over max(floor, factor * 1.4826 * MAD).

    A series with fewer than ``least`` differences has the floor alone as its limit.
    """
    d = df.withColumn("diff", F.col(value) - F.lag(value).over(in_order(series, order)))
    own = Window.partitionBy(*series)
    d = d.withColumn("mid", F.percentile("diff", 0.5).over(own)).withColumn("n_diff", F.count("diff").over(own))
    d = d.withColumn("mad", F.percentile(F.abs(F.col("diff") - F.col("mid")), 0.5).over(own))
    limit = F.when(F.col("n_diff") >= least, F.greatest(F.lit(floor), factor * 1.4826 * F.col("mad"))).otherwise(F.lit(floor))
    d = d.withColumn("limit", limit)
    return d.withColumn("jump", F.coalesce(F.abs(F.col("diff") - F.col("mid")) > F.col("limit"), F.lit(False))).drop("mid", "mad", "n_diff")


def second_difference(df: DataFrame, series: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``diff2`` = x[t] - 2 x[t-1] + x[t-2]."""
    w = in_order(series, order)
    return df.withColumn("diff2", F.col(value) - 2 * F.lag(value, 1).over(w) + F.lag(value, 2).over(w))


def edge_distance(df: DataFrame, segment: list[str], time: str, guard: float) -> DataFrame:
    """Adds ``edge`` = distance to the nearer end of the segment, and ``near_edge`` (guard included)."""
    own = Window.partitionBy(*segment)
    edge = F.least(F.col(time) - F.min(time).over(own), F.max(time).over(own) - F.col(time))
    return df.withColumn("edge", edge).withColumn("near_edge", F.coalesce(F.col("edge") <= guard, F.lit(True)))


def window_sigma(df: DataFrame, keys: list[str], value: str, expected: int, share: float) -> DataFrame:
    """Population deviation of a window, null unless ``ceil(expected * share)`` values are there."""
    n = F.count(value)
    return df.groupBy(*keys).agg(n.alias("n"), F.when(n >= F.ceil(F.lit(expected * share)), F.stddev_pop(value)).alias("sigma"))


def normalised_intensity(value: Column) -> Column:
    """sqrt(max(0, E[x^2] - E[x]^2)) / E[x]"""
    mean = F.avg(value)
    return F.try_divide(F.sqrt(F.greatest(F.lit(0.0), F.avg(value * value) - mean * mean)), mean)


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("place = 1").drop("place")


def sticky(df: DataFrame, series: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the first value that is not null so far: learned once, then fixed."""
    w = in_order(series, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.first(value, ignorenulls=True).over(w))
