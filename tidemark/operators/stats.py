"""Rank statistics, false-discovery control, regression and resampling on distributed tables.

Global order never meets in one task: values are dealt into ranges at approximate quantiles, ranked
there, and shifted by the totals of the ranges before, a row for each range. Equal values are counted
first and are one row throughout. Values that are null or not finite have no rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import finite

#: Fewest ranges; there are as many as shuffle partitions, if these are more.
RANGES = 64
#: Most clusters (years, months) that a bootstrap numbers in one task.
CLUSTERS = 1_000_000


def _ranged(df: DataFrame, value: str) -> DataFrame:
    """Adds ``range_id``; every value of a range is below every value of the next."""
    n = max(RANGES, min(1000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = df.agg(F.percentile_approx(value, [k / n for k in range(1, n)], 20 * n).alias("cuts"))
    return df.crossJoin(F.broadcast(cuts)).withColumn("range_id", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")


def _counted(df: DataFrame, value: str) -> DataFrame:
    """``(value, ties, upto, range_id)`` of each distinct finite value: its rows, and the rows up to it."""
    counts = _ranged(df.where(finite(F.col(value))).groupBy(value).agg(F.count("*").alias("ties")), value)
    totals = counts.groupBy("range_id").agg(F.sum("ties").alias("total"))
    before = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("range_id", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("shift"))
    own = Window.partitionBy("range_id").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("ties").over(own)).join(F.broadcast(shift), "range_id")
    return ranked.select(value, "ties", (F.col("shift") + F.col("upto")).alias("upto"), "range_id")


def rank_table(df: DataFrame, value: str) -> DataFrame:
    """``(of_value, ties, rank)`` of each distinct finite value: the rank from 1, ties at their mean."""
    return _counted(df, value).select(F.col(value).alias("of_value"), "ties", (F.col("upto") - (F.col("ties") - 1) / 2).alias("rank"))


def average_ranks(df: DataFrame, value: str, rank: str) -> DataFrame:
    """Adds the rank of ``value`` from 1, ties at their mean; values that are not finite have none."""
    ranked = rank_table(df, value).select("of_value", F.col("rank").alias(rank))
    return df.join(ranked, F.col(value) == F.col("of_value"), "left").drop("of_value")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, rho) of the rows that have both, finite.

    Each side is ranked by itself from the base table, and rows equal in both values are one row with
    a count, so the base is read three times and neither ranking contains the other.
    """
    both = df.where(finite(F.col(x)) & finite(F.col(y))).select(F.col(x).alias("x"), F.col(y).alias("y"))
    ranks = [rank_table(both.select(c), c).select(F.col("of_value").alias(f"of_{c}"), F.col("rank").alias(f"r{c}")) for c in ("x", "y")]
    counted = both.groupBy("x", "y").agg(F.count("*").alias("n"))
    ranked = counted.join(ranks[0], F.col("x") == F.col("of_x")).join(ranks[1], F.col("y") == F.col("of_y"))
    mean = lambda e: F.sum(F.col("n") * e) / F.sum("n")
    rx, ry = F.col("rx"), F.col("ry")
    middle = (F.sum("n") + 1) / 2
    sums = ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), mean(rx * ry).alias("xy"), mean(rx * rx).alias("xx"), mean(ry * ry).alias("yy"), (middle * middle).alias("m"))
    spread = F.sqrt((F.col("xx") - F.col("m")) * (F.col("yy") - F.col("m")))
    return sums.select("n", F.try_divide(F.col("xy") - F.col("m"), F.nullif(spread, F.lit(0.0))).alias("rho"))


def benjamini_hochberg(df: DataFrame, p: str, key: str) -> DataFrame:
    """(key, p, q): p m / rank over the finite p, made monotone from the largest rank down, at most 1; other p have null q.

    Equal p have one q, that of the last of them, so distinct p are ranked; each range is passed once
    from its largest p down, and takes the smallest of the ranges above it.
    """
    known = _counted(df.select(p), p)
    m = known.agg(F.sum("ties").alias("m"))
    raw = known.join(F.broadcast(m)).withColumn("raw", F.col(p) * F.col("m") / F.col("upto"))
    lows = raw.groupBy("range_id").agg(F.min("raw").alias("low"))
    later = lows.select("range_id", F.min("low").over(Window.orderBy(F.desc("range_id")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    down = Window.partitionBy("range_id").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.min("raw").over(down), F.coalesce("later", F.lit(1.0)))
    found = raw.join(F.broadcast(later), "range_id").select(F.col(p).alias("of_p"), q.alias("q"))
    return df.select(key, p).join(found, F.col(p) == F.col("of_p"), "left").drop("of_p")


def ols_two(df: DataFrame, y: str, x1: str, x2: str, keys: list[str]) -> DataFrame:
    """Intercept, slopes and R2 of y on two predictors, by centred normal equations; null if singular."""
    c = lambda a, b: F.covar_pop(a, b)
    s = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(y).alias("my"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), c(x1, x1).alias("s11"), c(x2, x2).alias("s22"),
        c(x1, x2).alias("s12"), c(x1, y).alias("s1y"), c(x2, y).alias("s2y"), c(y, y).alias("syy"))
    det = F.nullif(F.expr("s11 * s22 - s12 * s12"), F.lit(0.0))
    s = s.withColumn("b1", F.expr("s22 * s1y - s12 * s2y") / det).withColumn("b2", F.expr("s11 * s2y - s12 * s1y") / det)
    return s.select(*keys, "n", F.expr("my - b1 * m1 - b2 * m2").alias("b0"), "b1", "b2", F.try_divide(F.expr("b1 * s1y + b2 * s2y"), F.nullif(F.col("syy"), F.lit(0.0))).alias("r2"))


def mann_whitney_u(df: DataFrame, value: str, group: str, one: str) -> DataFrame:
    """U of the rows whose group is ``one`` against all others."""
    ranked = average_ranks(df.where(finite(F.col(value))), value, "rank")
    mine = F.col(group) == one
    n1 = F.count_if(mine)
    return ranked.agg(n1.alias("n1"), (F.count("*") - n1).alias("n2"), (F.sum(F.when(mine, F.col("rank"))) - n1 * (n1 + 1) / 2).alias("u"))


def welch_t(df: DataFrame, value: str, group: str, one: str, two: str) -> DataFrame:
    """Welch's t and degrees of freedom of two groups."""
    a, b = (F.when(F.col(group) == g, F.col(value)) for g in (one, two))
    s = df.agg(F.count(a).alias("na"), F.count(b).alias("nb"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"))
    return s.select("na", "nb", F.expr("(ma - mb) / sqrt(va / na + vb / nb)").alias("t"),
                    F.expr("power(va / na + vb / nb, 2) / (power(va / na, 2) / (na - 1) + power(vb / nb, 2) / (nb - 1))").alias("df"))


def mixed_pick(rep: Column, slot: Column, n: Column, seed: int) -> Column:
    """A draw from 0 to n - 1: the first 15 hex digits of the md5 of 'rep/slot/seed', mod n."""
    digits = F.substring(F.md5(F.concat_ws("/", rep.cast("string"), slot.cast("string"), F.lit(str(seed)))), 1, 15)
    return F.conv(digits, 16, 10).cast("long") % n


def cluster_bootstrap(clusters: DataFrame, cluster: str, total: str, count: str, reps: int, seed: int) -> DataFrame:
    """Mean and percentile interval of sum(total) / sum(count) over resampled clusters.

    Each (rep, slot) draws a cluster with replacement, by a hash that any engine can compute. Clusters
    are aggregates, ``CLUSTERS`` of them at most; reps x clusters rows are made in parallel.
    """
    numbered = clusters.withColumn("idx", F.row_number().over(Window.orderBy(cluster)) - 1)
    numbered = numbered.where(F.assert_true(F.col("idx") < CLUSTERS, F.lit("too many clusters")).isNull())
    n = clusters.agg(F.count("*").alias("n"))
    draws = clusters.sparkSession.range(reps).withColumnRenamed("id", "rep").crossJoin(F.broadcast(n)).where("n > 0")
    draws = draws.select("rep", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("slot"))
    picked = draws.withColumn("idx", mixed_pick(F.col("rep"), F.col("slot"), F.col("n"), seed)).join(numbered, "idx")
    means = picked.groupBy("rep").agg((F.sum(total) / F.sum(count)).alias("mean"))
    return means.agg(F.count("*").alias("reps"), F.avg("mean").alias("mean"), F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
