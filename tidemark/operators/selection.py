"""Filters, classifications, checked joins and set operations of the analysis scripts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return F.coalesce(F.abs(value) < math.inf, F.lit(False)) & ~F.isnan(value)


def sentinel_to_null(value: Column, bad: Column) -> Column:
    return F.when(~F.coalesce(bad, F.lit(False)), value)


def elevation_mask(df: DataFrame, elevation: str, cutoff: float = 30.0, signed: bool = True) -> DataFrame:
    """Rows at or above the cutoff; some files have negative angles, whose size counts (``signed=False``)."""
    e = F.col(elevation)
    return df.where((e if signed else F.abs(e)) >= cutoff)


def in_day(ts: Column, day: Column) -> Column:
    """Half-open: from midnight of the day to before the next."""
    return (ts >= day) & (ts < day + F.expr("interval 1 day"))


def in_days_inclusive(ts: Column, first: Column, last: Column) -> Column:
    """From the first midnight to the midnight after the last day, which still belongs to it."""
    return (ts >= first) & (ts <= last + F.expr("interval 1 day"))


def in_box(lat: Column, lon: Column, centre: tuple[float, float], half_lat: float = 5.0, half_lon: float = 10.0) -> Column:
    """A fixed box round a station."""
    return lat.between(centre[0] - half_lat, centre[0] + half_lat) & lon.between(centre[1] - half_lon, centre[1] + half_lon)


def footprint_box(points: DataFrame, margin: float, fallback: tuple[float, float, float, float]) -> DataFrame:
    """One row ``(lat_low, lat_high, lon_low, lon_high)``: the finite points' extent with a margin, clamped to the globe.

    Without a finite point the box is ``fallback``.
    """
    ok = finite(F.col("lat")) & finite(F.col("lon"))
    ends = points.where(ok).agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"))
    clamp = lambda v, m: F.when(v.isNotNull(), F.greatest(F.lit(-m), F.least(F.lit(m), v)))
    sides = [("lat_low", "a", -margin, 90.0), ("lat_high", "b", margin, 90.0), ("lon_low", "c", -margin, 180.0), ("lon_high", "d", margin, 180.0)]
    return ends.select(*[F.coalesce(clamp(F.col(c) + m, most), F.lit(f)).alias(n) for (n, c, m, most), f in zip(sides, fallback, strict=True)])


def within(df: DataFrame, box: DataFrame) -> DataFrame:
    """Rows inside a box of one row, which every task gets."""
    inside = F.col("lat").between(F.col("lat_low"), F.col("lat_high")) & F.col("lon").between(F.col("lon_low"), F.col("lon_high"))
    return df.join(F.broadcast(box), inside).select(df.columns)


def activity_class(kp: Column, dst: Column, symh: Column) -> Column:
    """unknown, storm, quiet or active_nonstorm, the first that fits; the last three need all three values."""
    missing = kp.isNull() | dst.isNull() | symh.isNull()
    storm = (kp >= 5) | (dst <= -50) | (symh <= -50)
    quiet = (kp < 4) & (dst > -30) & (symh > -30)
    return F.when(missing, "unknown").when(storm, "storm").when(quiet, "quiet").otherwise("active_nonstorm")


def quality_flag(*conditions: Column) -> Column:
    """All conditions hold; one that is null does not."""
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def constellation(sv: Column, supported: str = "GRE") -> Column:
    """The system letter of a satellite, null if it is none of the supported ones."""
    letter = F.upper(F.substring(sv, 1, 1))
    return F.when(letter.isin(*supported), letter)


def mapped_name(name: Column, exact: dict[str, str], parts: dict[str, str], otherwise: str) -> Column:
    """A display name: by the whole name first, then by a part of it in any case."""
    out = F.lit(otherwise)
    for part, shown in reversed(parts.items()):
        out = F.when(F.lower(name).contains(part.lower()), shown).otherwise(out)
    for whole, shown in reversed(exact.items()):
        out = F.when(name == whole, shown).otherwise(out)
    return out


def columns_like(df: DataFrame, suffixes: tuple[str, ...] = (), parts: tuple[str, ...] = ()) -> list[str]:
    """Columns that end with one of the suffixes and hold one of the parts, in order."""
    return [c for c in df.columns if (not suffixes or c.endswith(suffixes)) and (not parts or any(p in c for p in parts))]


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    """Columns renamed with a prefix, but for the keys."""
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def checked_many_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join that fails if ``right`` has a key twice; nothing is collected, the check runs with the join."""
    counted = right.withColumn("_times", F.count("*").over(Window.partitionBy(*on)))
    ok = F.assert_true(F.col("_times") <= 1, F.lit("right side is not unique")).isNull()
    return left.join(counted.where(ok).drop("_times"), on, "left")


def checked_one_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join that fails if either side has a key twice."""
    counted = left.withColumn("_times", F.count("*").over(Window.partitionBy(*on)))
    ok = F.assert_true(F.col("_times") <= 1, F.lit("left side is not unique")).isNull()
    return checked_many_to_one(counted.where(ok).drop("_times"), right, on)


def the_row(df: DataFrame, condition: Column) -> DataFrame:
    """The single row that meets the condition; the query fails if there is none or more than one."""
    found = df.where(condition)
    count = found.agg(F.count("*").alias("_found"))
    one = F.assert_true(F.col("_found") == 1, F.concat(F.lit("rows found: "), F.col("_found").cast("string"))).isNull()
    return count.where(one).join(found, how="left").drop("_found")


def down_sample(df: DataFrame, keys: list[str], most: int, order: list[Column]) -> DataFrame:
    """At most ``most`` rows of each key, by a hash order that is the same in every run."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def stable_first(df: DataFrame, keys: list[str], time: str, source: str, line: str) -> DataFrame:
    """Of rows with equal keys and time the first in order of source and line, as a stable sort leaves them."""
    place = F.row_number().over(Window.partitionBy(*keys, time).orderBy(source, line))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def day_union(*days: DataFrame) -> DataFrame:
    """Distinct rows of all sides."""
    out = days[0]
    for d in days[1:]:
        out = out.union(d)
    return out.distinct()


def holds_all(df: DataFrame, key: str, value: str, wanted: list[str]) -> DataFrame:
    """Keys that have every wanted value."""
    have = df.where(F.col(value).isin(wanted)).groupBy(key).agg(F.count_distinct(value).alias("have"))
    return have.where(F.col("have") == len(set(wanted))).select(key)
