"""Running results over one long series, in time buckets: buckets side by side, then carries over bucket totals.

A window over a series keeps the series in one task. Here windows run within buckets of time; what
a bucket needs of those before it (the last time, the segments begun so far) and, for the ends of
segments, of those around it, comes from a window over one row a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_segments(df: DataFrame, series: list[str], time: str, ties: list[str], width: float, longest: float, flag: Column | None = None, guard: float | None = None) -> DataFrame:
    """Adds ``dt``, ``segment_id`` from 0, ``segment_begin`` and ``segment_end``, and with ``guard`` ``edge`` and ``near_edge``.

    As ``segments.gap_segments`` and ``edge_distance``, with rows ordered by ``time`` and then ``ties``:
    a step that is null, not positive or over ``longest`` starts a segment, and so does a row with
    ``flag``. ``width`` is the time of a bucket; choose it so that a bucket fits a task. Rows without a
    time come first in their series, in a bucket of their own, and have no ends.
    """
    order = [F.col(time), *map(F.col, ties)]
    d = df.withColumn("_bucket", F.floor(F.col(time) / width)).withColumn("_flag", F.coalesce(flag, F.lit(False)) if flag is not None else F.lit(False))
    inner = Window.partitionBy(*series, "_bucket").orderBy(*order)
    d = d.withColumn("_place", F.row_number().over(inner)).withColumn("_before", F.lag(time).over(inner))
    step = F.col(time) - F.col("_before")
    starts = F.coalesce((step <= 0) | (step > longest), F.lit(True)) | F.col("_flag")
    # the first row of a bucket is judged when the bucket before it is known
    d = d.withColumn("_local", F.sum(F.when(F.col("_place") == 1, 0).otherwise(starts.cast("int"))).over(inner))

    # one row for each bucket and each segment in it
    parts = d.groupBy(*series, "_bucket", "_local").agg(
        F.min(time).alias("_first"), F.max(time).alias("_last"), F.min(F.struct("_place", "_flag"))["_flag"].alias("_first_flag"))
    buckets = parts.groupBy(*series, "_bucket").agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.max("_local").alias("_inside"), F.min_by("_first_flag", "_local").alias("_first_flag"))
    across = Window.partitionBy(*series).orderBy("_bucket")
    gap = F.col("_first") - F.lag("_last").over(across)
    begins = F.coalesce((gap <= 0) | (gap > longest), F.lit(True)) | F.col("_first_flag")
    upto = across.rowsBetween(Window.unboundedPreceding, 0)
    buckets = buckets.withColumn("_previous", F.lag("_last").over(across)).withColumn("_begins", begins.cast("int"))
    buckets = buckets.withColumn("_carry", F.sum(F.col("_begins") + F.col("_inside")).over(upto) - F.col("_inside") - 1)
    carries = buckets.select(*series, "_bucket", "_carry", "_previous")

    numbered = _met(parts, carries, [*series, "_bucket"]).withColumn("_segment", F.col("_carry") + F.col("_local"))
    # a segment's ends over the buckets it passes: one row a bucket
    own = Window.partitionBy(*series, "_segment")
    ends = numbered.select(*series, "_bucket", "_local", "_segment", "_previous", F.min("_first").over(own).alias("segment_begin"), F.max("_last").over(own).alias("segment_end"))
    out = _met(d, ends, [*series, "_bucket", "_local"])
    before = F.when(F.col("_place") == 1, F.col("_previous")).otherwise(F.col("_before"))
    out = out.withColumn("dt", F.col(time) - before).withColumn("segment_id", F.col("_segment").cast("long"))
    made = ["dt", "segment_id", "segment_begin", "segment_end"]
    if guard is not None:
        out = out.withColumn("edge", F.least(F.col(time) - F.col("segment_begin"), F.col("segment_end") - F.col(time)))
        out = out.withColumn("near_edge", F.coalesce(F.col("edge") <= guard, F.lit(True)))
        made += ["edge", "near_edge"]
    return out.select(*df.columns, *made)


def _met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Null-safe equality join on keys that ``right`` has once."""
    renamed = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return left.join(renamed, same, "left").drop(*[f"_of_{k}" for k in keys])
