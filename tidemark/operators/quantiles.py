"""Exact quantiles of groups of any size, in bounded memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stored

from .selection import finite

#: Equal parts into which a bracket is cut by a pass over the rows.
PARTS = 512
#: A bracket of so many rows at most has its values ordered.
INSIDE = 100_000
#: Passes that cut brackets; each ends at values that occur, so a few do for any finite values.
PASSES = 8
#: Brackets of so many groups at most are broadcast.
GROUPS = 20_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """``(keys, names of at)``: linearly interpolated quantiles of the finite values, as ``percentile`` gives them.

    An aggregate that keeps all values of a group in one task cannot grow with the group. Here each
    wanted rank has a bracket of values, at first from a group's least to its largest. A pass counts
    the rows of its parts and the part with the rank is the next bracket, until few rows are in it;
    these are ordered. Counts alone are shuffled, and each step's brackets are stored, so that every
    row is held against the same ones. ``df`` is read once for each pass: a column that may come out
    otherwise when it is computed again, as a mean of floats, must be stored before.
    """
    rows = df.where(finite(F.col(value))).select(*keys, F.col(value).alias("_v"))
    ends = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    if not keys:
        ends = ends.where("_n > 0")
    places = [F.lit(p) * (F.col("_n") - 1) for p in at.values()]
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in places for f in (F.floor, F.ceil)]))
    state = stored(ends.select(*keys, "_n", F.explode(ranks).alias("_rank"), F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_count"), "_lo", "_hi"), "ranks")
    few = state.select(*keys).distinct().limit(GROUPS + 1).count() <= GROUPS
    for _ in range(PASSES):
        if state.where((F.col("_count") > INSIDE) & (F.col("_lo") < F.col("_hi"))).isEmpty():
            break
        share = F.try_divide(F.col("_v") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2)
        state = _narrowed(rows, state, keys, F.floor(F.coalesce(share, F.lit(0.0)) * PARTS), few)
    state = _narrowed(rows, state, keys, F.col("_v"), few)
    held = F.map_from_entries(F.collect_list(F.struct("_rank", "_lo")))
    found = state.groupBy(*keys).agg(F.first("_n").alias("_n"), held.alias("_held"))
    low, high = ([F.col("_held")[f(x).cast("long")] for x in places] for f in (F.floor, F.ceil))
    return found.select(*keys, *[(a + (b - a) * (x - F.floor(x))).alias(name) for name, x, a, b in zip(at, places, low, high, strict=True)])


def with_quantiles(found: DataFrame, df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """``found``, one row a group of ``keys``, with the exact quantiles of ``df``; a null key is a group like any other."""
    own = exact_quantiles(df, keys, value, at).withColumnsRenamed({k: f"_q{i}" for i, k in enumerate(keys)})
    return found.join(own, _equal(keys, "_q"), "left").select(*found.columns, *at)


def _narrowed(rows: DataFrame, state: DataFrame, keys: list[str], part: Column, few: bool) -> DataFrame:
    """The ranks of ``state`` with their brackets narrowed to one ``part``, which rises with the values."""
    done, wide = state.where(F.col("_lo") >= F.col("_hi")), state.where(F.col("_lo") < F.col("_hi"))
    brackets = wide.groupBy(*keys).agg(F.collect_set(F.struct("_lo", "_hi")).alias("_brackets")).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    met = rows.join(F.broadcast(brackets) if few else brackets, _equal(keys, "_k"))
    own = F.filter("_brackets", lambda b: F.col("_v").between(b["_lo"], b["_hi"]))
    placed = met.select(*keys, "_v", F.explode(own).alias("_b")).select(*keys, "_v", "_b._lo", "_b._hi").withColumn("_part", part)
    counted = placed.groupBy(*keys, "_lo", "_part").agg(F.count("*").alias("_c"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_lo").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
    spans = counted.withColumn("_upto", upto).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)} | {"_lo": "_of"})
    held = spans.join(F.broadcast(wide) if few else wide, _equal(keys, "_k") & (F.col("_lo") == F.col("_of")))
    end = F.col("_below") + F.col("_upto")
    held = held.where((end - F.col("_c") <= F.col("_rank")) & (F.col("_rank") < end))
    held = held.select(*keys, "_n", "_rank", (end - F.col("_c")).alias("_below"), F.col("_c").alias("_count"), F.col("_from").alias("_lo"), F.col("_to").alias("_hi"))
    return stored(done.unionByName(held), "ranks")


def _equal(keys: list[str], prefix: str) -> Column:
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"{prefix}{i}"))
    return same
