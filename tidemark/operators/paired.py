"""Paired statistics: residuals of a method against a reference, by group, day and pooled level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles
from .selection import finite

QUANTILES = {"median": 0.5, "p05": 0.05, "p95": 0.95}
METRICS = ("bias", "mae", "rmse", "std", "median", "p05", "p95", "r")


def bundle(method: Column, reference: Column) -> list[Column]:
    """n, bias, MAE, RMSE, population deviation, median, 5th and 95th percentile of the residual, and r.

    Rows without two finite values don't count; without any the metrics are null; r is null where a side
    is constant or there are fewer than two rows.
    """
    both = finite(method) & finite(reference)
    m, r = F.when(both, method), F.when(both, reference)
    res = m - r
    spread = F.stddev_pop(m) * F.stddev_pop(r)
    return [
        F.count(res).alias("n"), F.avg(res).alias("bias"), F.avg(F.abs(res)).alias("mae"), F.sqrt(F.avg(res * res)).alias("rmse"),
        F.stddev_pop(res).alias("std"), F.percentile(res, 0.5).alias("median"), F.percentile(res, 0.05).alias("p05"),
        F.percentile(res, 0.95).alias("p95"), F.when(F.count(res) >= 2, F.try_divide(F.covar_pop(m, r), F.nullif(spread, F.lit(0.0)))).alias("r"),
    ]


def paired_stats(df: DataFrame, keys: list[str], method: str, reference: str) -> DataFrame:
    """The bundle for each group of ``keys``: one shuffle with partial aggregation.

    A task holds the distinct residuals of a group, as days and satellites have them.
    """
    return df.groupBy(*keys).agg(*bundle(F.col(method), F.col(reference)))


def pooled_stats(df: DataFrame, keys: list[str], method: str, reference: str) -> DataFrame:
    """The same for groups that grow with the data, as years: the quantiles are found without holding a group."""
    both = finite(F.col(method)) & finite(F.col(reference))
    residual = df.select(*keys, F.when(both, F.col(method) - F.col(reference)).alias("_res"))
    moments = [c for c in bundle(F.col(method), F.col(reference)) if "percentile" not in str(c)]
    found = df.groupBy(*keys).agg(*moments).withColumnsRenamed({k: f"_m{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(f"_m{i}").eqNullSafe(F.col(k))
    joined = found.join(exact_quantiles(residual, keys, "_res", QUANTILES), same, "left")
    return joined.select(*[F.col(f"_m{i}").alias(k) for i, k in enumerate(keys)], "n", *METRICS)


def equal_day(daily: DataFrame, keys: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Mean and median over days of each daily metric; a day without pairs does not count."""
    aggs = [f for m in metrics for f in (F.avg(m).alias(f"mean_{m}"), F.percentile(m, 0.5).alias(f"median_{m}"))]
    return daily.where("n > 0").groupBy(*keys).agg(F.count("*").alias("n_days"), *aggs)


def match_fraction(candidates: DataFrame, matches: DataFrame, on: str, keys: list[str]) -> DataFrame:
    """Rows, matched rows and their ratio by group; ``matches`` may repeat a key."""
    found = matches.select(F.col(on)).distinct().withColumn("hit", F.lit(1))
    joined = candidates.join(found, on, "left")
    n, hit = F.count("*"), F.count("hit")
    return joined.groupBy(*keys).agg(n.alias("n_candidates"), hit.alias("n_matched"), F.try_divide(hit, n).alias("fraction"))


def strict_common(df: DataFrame, day: str, reference: str, wanted: int) -> DataFrame:
    """Rows of the days on which ``wanted`` distinct references have data."""
    days = df.groupBy(day).agg(F.count_distinct(reference).alias("have")).where(F.col("have") == wanted).select(day)
    return df.join(days, day, "left_semi")


def weighted_summary(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean and weighted population variance."""
    w, x = F.col(weight), F.col(value)
    mean = F.try_divide(F.sum(w * x), F.sum(w))
    return df.groupBy(*keys).agg(mean.alias("weighted_mean"), (F.try_divide(F.sum(w * x * x), F.sum(w)) - mean * mean).alias("weighted_var"), F.sum(w).alias("weight"))
