"""Correlation grids, linear models, group tests and bootstraps on daily master tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.probability import normal_p, sign_test_p, student_t_p

from .selection import finite
from .stats import mixed_pick, rank_table

LEAST_CORRELATION, LEAST_REGRESSION, LEAST_WEIGHTED, LEAST_SLOPE = 4, 8, 12, 8
_SOLVED = T.StructType([T.StructField(n, t) for n, t in (("beta", T.ArrayType(T.DoubleType())), ("se", T.ArrayType(T.DoubleType())), ("sse", T.DoubleType()), ("sst", T.DoubleType()))])


def grid_pairs(df: DataFrame, outcomes: list[str], predictors: list[str], keep: list[str]) -> DataFrame:
    """Long form ``(keep, outcome, predictor, y, x)`` of the rows where both are finite."""
    pairs = [F.struct(F.lit(o).alias("outcome"), F.lit(p).alias("predictor"), F.col(o).cast("double").alias("y"), F.col(p).cast("double").alias("x")) for o in outcomes for p in predictors]
    long = df.select(*keep, F.explode(F.array(*pairs)).alias("g")).select(*keep, "g.*")
    return long.where(finite(F.col("x")) & finite(F.col("y")))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation with n - 2 degrees of freedom."""
    t = r * F.sqrt((n - 2) / F.greatest(F.lit(1e-300), 1 - r * r))
    return student_t_p(t.cast("double"), (n - 2).cast("double"))


def correlation_table(pairs: DataFrame, keys: list[str], least: int = LEAST_CORRELATION) -> DataFrame:
    """(keys, n, pearson_r, pearson_p, spearman_rho, spearman_p) of long pairs ``(x, y)``.

    Null below ``least`` rows or where a side is constant. A group is ranked in one task: it has a
    row for each day; ``stats.spearman`` ranks tables without such a bound.
    """
    own = Window.partitionBy(*keys)
    rank = lambda c: F.rank().over(own.orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2
    ranked = pairs.withColumn("rx", rank("x")).withColumn("ry", rank("y"))

    def r(a: str, b: str) -> Column:
        value = F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))
        return F.when(F.count("*") >= least, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))

    found = ranked.groupBy(*keys).agg(F.count("*").alias("n"), r("x", "y").alias("pearson_r"), r("rx", "ry").alias("spearman_rho"))
    return found.withColumn("pearson_p", correlation_p(F.col("pearson_r"), F.col("n"))).withColumn("spearman_p", correlation_p(F.col("spearman_rho"), F.col("n")))


@F.arrow_udf(_SOLVED)
def _solve(sums: pa.Array) -> pa.Array:
    """Coefficients of one row of sums each: weight, rows, then first and second moments of regressors and outcome."""
    out = []
    for row in sums.to_pylist():
        total, n, *rest = row
        size = int((np.sqrt(9 + 8 * len(rest)) - 3) / 2)
        first, second = np.array(rest[:size]), np.zeros((size, size))
        second[np.triu_indices(size)] = rest[size:]
        second = np.triu(second) + np.triu(second, 1).T
        mean = first / total
        s = second - np.outer(first, first) / total
        xx, xy, yy = s[:-1, :-1], s[:-1, -1], s[-1, -1]
        scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
        scaled = xx / np.outer(scale, scale)
        if np.linalg.matrix_rank(scaled, tol=1e-10) < size - 1:
            out.append(None)
            continue
        inverse = np.linalg.inv(scaled) / np.outer(scale, scale)
        beta = inverse @ xy
        sse = max(float(yy - beta @ xy), 0.0)
        sigma2 = sse / (n - size) if n > size else float("nan")
        se = np.sqrt(sigma2 * np.r_[1 / total + mean[:-1] @ inverse @ mean[:-1], np.diag(inverse)])
        out.append({"beta": [float(mean[-1] - beta @ mean[:-1]), *beta.tolist()], "se": se.tolist(), "sse": sse, "sst": float(yy)})
    kind = pa.struct([("beta", pa.list_(pa.float64())), ("se", pa.list_(pa.float64())), ("sse", pa.float64()), ("sst", pa.float64())])
    return pa.array(out, kind)


def linear_fit(df: DataFrame, y: str, xs: list[str], keys: list[str], weight: str | None = None, least: int = LEAST_REGRESSION) -> DataFrame:
    """(keys, n, total, fit) by weighted normal equations; no row below ``max(least, p + 2)`` rows or if singular.

    The sums are one aggregation in the JVM; only they, a row for each key, are solved in numpy.
    """
    cols = [*xs, y]
    w = F.col(weight) if weight else F.lit(1.0)
    good = df
    for c in cols:
        good = good.where(finite(F.col(c).cast("double")))
    sums = [F.sum(w), F.count("*").cast("double")] + [F.sum(w * F.col(c)) for c in cols] + [F.sum(w * F.col(a) * F.col(b)) for k, a in enumerate(cols) for b in cols[k:]]
    found = good.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(w).alias("total"), F.array(*sums).alias("sums"))
    found = found.where(F.col("n") >= max(least, len(xs) + 3))
    return found.withColumn("fit", _solve("sums")).where("fit is not null").drop("sums")


def linear_model(df: DataFrame, y: str, xs: list[str], keys: list[str], weight: str | None = None, least: int = LEAST_REGRESSION) -> DataFrame:
    """(keys, n, r2, rmse, term, coefficient, std_error, t_stat, p_value) of a regression with intercept."""
    fit = linear_fit(df, y, xs, keys, weight, least)
    names = F.array(*map(F.lit, ["intercept", *xs]))
    terms = F.explode(F.arrays_zip(names.alias("term"), F.col("fit.beta").alias("coefficient"), F.col("fit.se").alias("std_error")))
    r2 = 1 - F.try_divide(F.col("fit.sse"), F.nullif(F.col("fit.sst"), F.lit(0.0)))
    long = fit.select(*keys, "n", r2.alias("r2"), F.sqrt(F.col("fit.sse") / F.col("total")).alias("rmse"), terms.alias("t")).select(*keys, "n", "r2", "rmse", "t.*")
    t = F.try_divide(F.col("coefficient"), F.nullif(F.col("std_error"), F.lit(0.0)))
    return long.withColumn("t_stat", t).withColumn("p_value", student_t_p("t_stat", (F.col("n") - len(xs) - 1).cast("double")))


def with_residuals(df: DataFrame, y: str, xs: list[str], keys: list[str], **settings: object) -> DataFrame:
    """``df`` with ``y_fitted`` and ``y_residual``; null where a value is missing or the key has no model.

    There is one row of coefficients for each key.
    """
    fit = linear_fit(df, y, xs, keys, **settings).select(*keys, F.col("fit.beta").alias("_beta"))
    joined = df.join(fit, keys, "left") if keys else df.join(F.broadcast(fit), how="left")
    ok = F.lit(True)
    for c in [*xs, y]:
        ok = ok & finite(F.col(c).cast("double"))
    fitted = F.col("_beta")[0]
    for k, c in enumerate(xs):
        fitted = fitted + F.col("_beta")[k + 1] * F.col(c)
    out = joined.withColumn(f"{y}_fitted", F.when(ok, fitted))
    return out.withColumn(f"{y}_residual", F.when(ok, F.col(y) - F.col(f"{y}_fitted"))).drop("_beta")


def equal_weights(df: DataFrame, cluster: str, name: str) -> DataFrame:
    """Adds 1 / rows of the cluster, brought to mean 1; clusters (years) are few, their sizes are joined back."""
    sizes = df.groupBy(cluster).agg(F.count("*").alias("_rows"))
    total = sizes.agg(F.sum("_rows").alias("_all"), F.count("*").alias("_clusters"))
    factors = sizes.join(F.broadcast(total)).select(F.col(cluster).alias("_cluster"), (F.col("_all") / F.col("_clusters") / F.col("_rows")).alias(name))
    return df.join(factors, F.col(cluster).eqNullSafe(F.col("_cluster"))).drop("_cluster")


def group_tests(df: DataFrame, value: str, group: str, one: str, two: str) -> DataFrame:
    """One row: sizes, means, Welch's t with its p, Mann-Whitney's U of ``one`` with its two-sided p.

    p of U is the normal one with ties and continuity corrected; tests are null below two rows a group.
    """
    rows = df.where(F.col(group).isin(one, two) & finite(F.col(value).cast("double"))).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    ranks = rank_table(rows, "v").select("of_value", "ties", "rank")
    counts = rows.groupBy("v").agg(F.count_if(F.col("g") == one).alias("a"))
    by_value = counts.join(ranks, F.col("v") == F.col("of_value"))
    sums = by_value.agg(F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum(F.pow("ties", F.lit(3.0)) - F.col("ties")).alias("tied"))
    a, b = (F.when(F.col("g") == x, F.col("v")) for x in (one, two))
    moments = rows.agg(F.count(a).alias("na"), F.count(b).alias("nb"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"))
    both = moments.join(F.broadcast(sums))
    enough = (F.col("na") >= 2) & (F.col("nb") >= 2)
    t = F.expr("try_divide(ma - mb, sqrt(va / na + vb / nb))")
    df_ = F.expr("try_divide(power(va / na + vb / nb, 2), power(va / na, 2) / (na - 1) + power(vb / nb, 2) / (nb - 1))")
    s = both.where(enough).withColumn("t", t).withColumn("df", df_).withColumn("u", F.expr("r1 - na * (na + 1) / 2D"))
    sigma = F.expr("sqrt(na * nb / 12D * ((na + nb + 1) - tied / ((na + nb) * (na + nb - 1))))")
    z = F.try_divide(F.greatest(F.lit(0.0), F.abs(F.col("u") - F.col("na") * F.col("nb") / 2) - 0.5), F.nullif(sigma, F.lit(0.0)))
    return s.select("na", "nb", "ma", "mb", "t", "df", student_t_p("t", "df").alias("welch_p"), "u", normal_p(z).alias("mannwhitney_p"))


def yearly_contrasts(df: DataFrame, year: str, klass: str, metrics: list[str], one: str = "storm", two: str = "quiet") -> DataFrame:
    """(year, metric, n of both, difference of means and of medians) of the years that have both classes."""
    long = df.where(F.col(klass).isin(one, two)).select(F.col(year).alias("year"), F.col(klass).alias("k"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select("year", "k", "x.*").where(finite(F.col("v")))
    a, b = (F.when(F.col("k") == g, F.col("v")) for g in (one, two))
    found = long.groupBy("year", "metric").agg(
        F.count(a).alias(f"{one}_n"), F.count(b).alias(f"{two}_n"), (F.avg(a) - F.avg(b)).alias("mean_difference"), (F.percentile(a, 0.5) - F.percentile(b, 0.5)).alias("median_difference"))
    return found.where((F.col(f"{one}_n") >= 1) & (F.col(f"{two}_n") >= 1))


def contrast_summary(contrasts: DataFrame) -> DataFrame:
    """Equal-year means and medians of the contrasts, their signs and the exact sign test, by metric."""
    d, m = F.col("mean_difference"), F.col("median_difference")
    found = contrasts.groupBy("metric").agg(
        F.count_distinct("year").alias("n_years"), F.array_join(F.array_sort(F.collect_set(F.col("year").cast("string"))), ",").alias("years"),
        F.avg(d).alias("mean_of_means"), F.percentile(d, 0.5).alias("median_of_means"), F.avg(m).alias("mean_of_medians"), F.percentile(m, 0.5).alias("median_of_medians"),
        F.count_if(d > 0).alias("n_positive"), F.count_if(d < 0).alias("n_negative"))
    return found.withColumn("sign_p", sign_test_p("n_positive", F.col("n_positive") + F.col("n_negative")))


# --- slopes and their bootstraps ------------------------------------------------------------------

_MOMENTS = {"n": "count(1)", "sx": "sum(x)", "sy": "sum(y)", "sxx": "sum(x * x)", "sxy": "sum(x * y)"}


def year_moments(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """n and sums of x, y, xx, xy of long pairs by keys: all that a slope needs."""
    return pairs.groupBy(*keys).agg(*[F.expr(e).alias(name) for name, e in _MOMENTS.items()])


def equal_cluster_slope(moments: DataFrame, keys: list[str], least: int = LEAST_SLOPE) -> DataFrame:
    """(keys, slope) where every row of ``moments`` is a cluster of weight one.

    Null below ``least`` rows in all, below two clusters or without spread of x.
    """
    mean = lambda c: F.sum(F.col(c) / F.col("n"))
    s = moments.groupBy(*keys).agg(F.count("*").alias("k"), F.sum("n").alias("rows"), *[mean(c).alias(c) for c in ("sx", "sy", "sxx", "sxy")])
    spread = F.expr("sxx - sx * sx / k")
    slope = F.when((F.col("rows") >= least) & (F.col("k") >= 2) & (spread > 0), F.expr("sxy - sx * sy / k") / spread)
    return s.select(*keys, slope.alias("slope"))


def cluster_slopes(moments: DataFrame, keys: list[str], cluster: str, reps: int, seed: int) -> DataFrame:
    """(keys, rep, slope) with clusters drawn with replacement, each draw a cluster of its own.

    ``moments`` has a row for each key and cluster; all keys share the draws.
    """
    spark = moments.sparkSession
    names = moments.select(F.col(cluster).alias("_name")).distinct().withColumn("_idx", F.row_number().over(Window.orderBy("_name")) - 1)
    n = names.agg(F.count("*").alias("_n"))
    slots = spark.range(reps).withColumnRenamed("id", "rep").join(F.broadcast(n)).where("_n > 0")
    slots = slots.select("rep", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("slot"))
    drawn = slots.withColumn("_idx", mixed_pick(F.col("rep"), F.col("slot"), F.col("_n"), seed)).join(names, "_idx").select("rep", "slot", "_name")
    met = drawn.join(moments, F.col("_name") == F.col(cluster))
    return equal_cluster_slope(met, [*keys, "rep"])


def block_days(spark: object, years: list[int], reps: int, seed: int, block: int = 7) -> DataFrame:
    """(rep, year, date): circular blocks of calendar days within each year, cut to the year's length; days repeat."""
    reps_years = spark.range(reps).withColumnRenamed("id", "rep").withColumn("year", F.explode(F.array(*map(F.lit, years))))
    days = F.datediff(F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)), F.make_date("year", F.lit(1), F.lit(1)))
    slots = reps_years.withColumn("days", days).withColumn("slot", F.explode(F.sequence(F.lit(0), F.ceil(F.col("days") / block).cast("int") - 1)))
    start = mixed_pick(F.col("rep"), F.concat_ws("-", F.col("year").cast("string"), F.col("slot").cast("string")), F.col("days"), seed)
    dealt = slots.withColumn("start", start).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).where(F.col("slot") * block + F.col("k") < F.col("days"))
    return dealt.select("rep", "year", F.date_add(F.make_date("year", F.lit(1), F.lit(1)), ((F.col("start") + F.col("k")) % F.col("days")).cast("int")).alias("date"))


def block_slopes(pairs: DataFrame, keys: list[str], date: str, years: list[int], reps: int, seed: int, block: int = 7) -> DataFrame:
    """(keys, rep, slope) over resampled days; all keys share the days, each year is a cluster."""
    drawn = block_days(pairs.sparkSession, years, reps, seed, block).groupBy("rep", "year", F.col("date").alias("_date")).agg(F.count("*").alias("times"))
    by_day = year_moments(pairs, [*keys, date])
    met = drawn.join(by_day, F.col("_date") == F.col(date))
    moments = met.groupBy(*keys, "rep", "year").agg(*[F.sum(F.col("times") * F.col(c)).alias(c) for c in _MOMENTS])
    return equal_cluster_slope(moments, [*keys, "rep"])


def percentile_interval(slopes: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """(keys, low, high, valid) at 2.5 and 97.5 percent of the finite slopes."""
    return slopes.groupBy(*keys).agg(F.percentile("slope", 0.025).alias(f"{prefix}_low"), F.percentile("slope", 0.975).alias(f"{prefix}_high"), F.count("slope").alias(f"{prefix}_valid"))


def interval_sign(low: Column, high: Column) -> Column:
    """1 above zero, -1 below, 0 around it or unknown."""
    return F.when(low > 0, 1).when(high < 0, -1).otherwise(0)


def lagged_tests(master: DataFrame, date: str, outcomes: list[str], predictors: list[str], lags: list[int], years: list[int], reps: int, seed: int) -> DataFrame:
    """The whole grid (outcome, predictor, lag): correlations, slope, both bootstrap intervals, robust flag and sign.

    A predictor of lag L is that of the calendar day L days before; one frame holds all tests.
    """
    days = master.select(F.col(date).alias("date"), *outcomes)
    shifted = master.select(F.explode(F.array(*map(F.lit, lags))).alias("lag"), F.col(date).alias("_from"), *[F.col(p) for p in predictors])
    shifted = shifted.select("lag", F.date_add("_from", F.col("lag")).alias("date"), *predictors)
    pairs = grid_pairs(days.join(shifted, "date"), outcomes, predictors, ["date", "lag"]).withColumn("year", F.year("date"))
    keys = ["outcome", "predictor", "lag"]
    by_year = year_moments(pairs, [*keys, "year"])
    found = correlation_table(pairs, keys, LEAST_SLOPE).join(equal_cluster_slope(by_year, keys), keys, "left")
    found = found.join(percentile_interval(cluster_slopes(by_year, keys, "year", reps, seed), keys, "cluster"), keys, "left")
    found = found.join(percentile_interval(block_slopes(pairs, keys, "date", years, reps, seed), keys, "block"), keys, "left")
    one, two = (interval_sign(F.col(f"{p}_low"), F.col(f"{p}_high")) for p in ("cluster", "block"))
    robust = (one != 0) & (one == two)
    return found.withColumn("robust", robust).withColumn("sign", F.when(robust, one).otherwise(0))


def best_lags(tests: DataFrame) -> DataFrame:
    """For each outcome and predictor the lag that is robust, then of largest rho, then of largest slope."""
    order = [F.desc("robust"), F.desc(F.abs("spearman_rho")), F.desc(F.abs("slope")), F.col("lag")]
    return tests.withColumn("_place", F.row_number().over(Window.partitionBy("outcome", "predictor").orderBy(*order))).where("_place = 1").drop("_place")
