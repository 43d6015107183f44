"""Queries of daily, monthly and yearly summaries at two levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import align, paired
from tidemark.operators.quantiles import with_quantiles

from .registry import query, rounded, table

_PAIRS = """with pairs as (select l_returnflag, l_linestatus, year(l_shipdate)::int as ship_year, l_shipdate::date as ship_day, l_quantity, l_extendedprice / l_quantity as m, p_retailprice as r from lineitem join part on l_partkey = p_partkey)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), "l_returnflag", "l_linestatus", F.year("l_shipdate").alias("ship_year"), F.to_date("l_shipdate").alias("ship_day"), "l_quantity", (F.col("l_extendedprice") / F.col("l_quantity")).alias("m"))
    return line.join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("r")), "p_partkey")


@query(f"""{_PAIRS} select ship_day, count(*) as n, round(avg(m - r) + 1.3e-8, 5) as bias, round(avg(m) + 1.3e-8, 5) as mean_m, round(median(m) + 1.3e-8, 5) as median_m, round(avg(r) + 1.3e-8, 5) as mean_r, round(median(r) + 1.3e-8, 5) as median_r from pairs group by all""")
def daily_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily bundle with mean and median of either side."""
    both = [(F.avg("m") + 1.3e-8).alias("mean_m"), (F.percentile("m", 0.5) + 1.3e-8).alias("median_m"), (F.avg("r") + 1.3e-8).alias("mean_r"), (F.percentile("r", 0.5) + 1.3e-8).alias("median_r")]
    return rounded(pairs(spark, sf_dir).groupBy("ship_day").agg(F.count("*").alias("n"), (F.avg(F.col("m") - F.col("r")) + 1.3e-8).alias("bias"), *both), 5)


_MATCH = """l as (select user_id, ts::date as day, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 1000000 as t from events where event_type = 'click' group by all), r as (select user_id, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 1000000 as u, min(value) as y from events where event_type = 'view' group by all),
 j as (select l.user_id, l.day, l.t, abs(u - t) as gap, y, row_number() over (partition by l.user_id, l.t order by abs(u - t), u) as k from l join r on l.user_id = r.user_id and abs(u - t) <= 21600), m as (select l.day, j.gap, j.y from l left join j on j.user_id = l.user_id and j.t = l.t and k = 1)"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.floor(F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) / 1_000_000).alias("t")
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'click'").select("user_id", F.to_date("ts").alias("day"), seconds).distinct()
    right = events.where("event_type = 'view'").groupBy("user_id", seconds).agg(F.min("value").alias("y"))
    return align.nearest_time(left, right, "t", 21_600, ["user_id"], "y")


@query(f"with {_MATCH} select day, count(*) as n_candidates, count(gap) as n_matched, round(count(gap) / count(*), 6) as fraction, round(median(gap), 6) as median_gap, round(median(y), 6) as median_value from m group by all")
def daily_match_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, hit = F.count("*"), F.count("gap")
    return rounded(_matched(spark, sf_dir).groupBy("day").agg(
        n.alias("n_candidates"), hit.alias("n_matched"), F.try_divide(hit, n).alias("fraction"), F.percentile("gap", 0.5).alias("median_gap"), F.percentile("y", 0.5).alias("median_value")))


@query(f"with {_MATCH}, d as (select day, count(*) as c, count(gap) as n from m group by all) select sum(n)::bigint as n_matched, sum(c)::bigint as n_candidates, round(sum(n) / nullif(sum(c), 0), 6) as overall, round(median(n / c), 6) as median_daily, count(*) as n_days from d")
def overall_match_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of sums, guarded against zero, beside the median of the daily ratios."""
    daily = _matched(spark, sf_dir).groupBy("day").agg(F.count("*").alias("c"), F.count("gap").alias("n"))
    return rounded(daily.agg(
        F.sum("n").alias("n_matched"), F.sum("c").alias("n_candidates"), F.try_divide(F.sum("n"), F.sum("c")).alias("overall"), F.percentile(F.try_divide("n", "c"), 0.5).alias("median_daily"), F.count("*").alias("n_days")))


_RAW = "count(*) as n, avg(m - r) as bias, avg(abs(m - r)) as mae, sqrt(avg((m - r) * (m - r))) as rmse"


@query(f"""{_PAIRS}, daily as (select l_returnflag, ship_day, {_RAW} from pairs group by all), whole as (select ship_day from daily group by ship_day having count(distinct l_returnflag) = 3)
 select l_returnflag, year(ship_day)::int as ship_year, count(*) as n_days, round(avg(bias), 5) as mean_bias, round(median(bias), 5) as median_bias, round(avg(rmse), 5) as mean_rmse, round(median(rmse), 5) as median_rmse from daily where ship_day in (from whole) group by all""")
def strict_common_equal_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that have every reference, then means and medians of the daily metrics by year."""
    daily = paired.paired_stats(pairs(spark, sf_dir), ["l_returnflag", "ship_day"], "m", "r").select("l_returnflag", "ship_day", "n", "bias", "rmse")
    common = paired.strict_common(daily, "ship_day", "l_returnflag", 3).withColumn("ship_year", F.year("ship_day"))
    return rounded(paired.equal_day(common, ["l_returnflag", "ship_year"], ("bias", "rmse")), 5)


_TEN = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "net", "charge", "unit", "levy", "rebate"]
_DERIVED = {"net": "l_extendedprice * (1 - l_discount)", "charge": "l_extendedprice * (1 - l_discount) * (1 + l_tax)", "unit": "l_extendedprice / l_quantity", "levy": "l_extendedprice * l_tax", "rebate": "l_extendedprice * l_discount"}
_SCALED = "select date_trunc('month', l_shipdate)::date as month, " + ", ".join(f"{_DERIVED.get(c, c)}::double as {c}" for c in _TEN) + " from lineitem"


@query(f"with v as ({_SCALED}) " + " union all ".join(f"select month, '{c}' as metric, count({c}) as n, round(avg({c}), 3) as mean, round(median({c}) + 1.3e-8, 3) as median, round(stddev_pop({c}), 3) as std from v group by all" for c in _TEN))
def column_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median, deviation and count of ten columns, unpivoted; medians of groups of any size."""
    v = table(spark, sf_dir, "lineitem").select(F.trunc("l_shipdate", "month").alias("month"), *[F.expr(_DERIVED.get(c, c)).cast("double").alias(c) for c in _TEN])
    long = v.unpivot(["month"], _TEN, "metric", "v")
    moments = long.groupBy("month", "metric").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return rounded(with_quantiles(moments, long, ["month", "metric"], "v", {"median": 0.5}).withColumn("median", F.col("median") + 1.3e-8), 3)


_TYPES = ("click", "error", "view")


@query("""with s as (select unnest(generate_series(date_trunc('week', min(ts))::timestamp, max(ts), interval 7 day))::date as week from events), d as (select event_type, ts::date as day, avg(value) as v, count(distinct hour(ts)) as hours from events where not (event_type = 'error' and value < 20) group by all),
 w as (select event_type, date_trunc('week', day)::date as week, avg(v) as mean, count(*) as days, sum(hours) as hours from d group by all)
 select s.week, """ + ", ".join(f"round(max(mean) filter (where event_type = '{t}'), 6) as {t}, max(days) filter (where event_type = '{t}') as {t}_days, (max(hours) filter (where event_type = '{t}'))::bigint as {t}_hours" for t in _TYPES) + " from s left join w on w.week = s.week group by s.week")
def available_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series on its own valid hours: daily means, then those of the period, on a spine without holes."""
    events = table(spark, sf_dir, "events").where("event_type in ('click', 'error', 'view') and not (event_type = 'error' and value < 20)")
    daily = events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"), F.count_distinct(F.hour("ts")).alias("hours"))
    weekly = daily.groupBy(F.trunc("day", "week").alias("week")).pivot("event_type", list(_TYPES)).agg(F.avg("v").alias("mean"), F.count("v").alias("days"), F.sum("hours").alias("hours"))
    spine = table(spark, sf_dir, "events").agg(*[F.to_date(F.date_trunc("week", f("ts"))).alias(n) for f, n in ((F.min, "a"), (F.max, "b"))])
    spine = spine.select(F.explode(F.expr("sequence(a, b, interval 7 day)")).alias("week"))
    named = {f"{t}_mean": t for t in _TYPES}
    return rounded(spine.join(weekly, "week", "left").withColumnsRenamed(named))


@query("""with d as (select ts::date as day, avg(value) filter (where event_type = 'view') as a, avg(value) filter (where event_type = 'click') as b, avg(value) filter (where event_type = 'error') as c from events group by all),
 w as (select date_trunc('week', day)::date as week, count(*) as n_days, avg(a - b) as ab, avg(a - c) as ac, avg(b - c) as bc, median(a - b) as mab from d where a is not null and b is not null and c is not null group by all)
 select week, n_days, round(ab, 6) as view_click, round(ac, 6) as view_error, round(bc, 6) as click_error, round(mab, 6) as median_view_click from w""")
def product_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of strict daily means between products, averaged by period."""
    daily = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).pivot("event_type", list(_TYPES)).agg(F.avg("value")).dropna()
    diff = lambda a, b: F.col(a) - F.col(b)
    return rounded(daily.groupBy(F.trunc("day", "week").alias("week")).agg(
        F.count("*").alias("n_days"), F.avg(diff("view", "click")).alias("view_click"), F.avg(diff("view", "error")).alias("view_error"), F.avg(diff("click", "error")).alias("click_error"), F.percentile(diff("view", "click"), 0.5).alias("median_view_click")))


_DAY = """with d as (select o_orderdate::date as day, avg(o_totalprice) as price, count(*)::double as orders, avg(o_custkey % 97) as cust from orders group by all), c as (select *, case when day_of_year % 5 = 0 then 'storm' when day_of_year % 5 < 3 then 'quiet' else 'active' end as class from (select *, dayofyear(day) as day_of_year from d))"""
_COLUMNS = ["price", "orders", "cust"]


@query(_DAY + " select year(day)::int as year, count(*) as n, count(*) filter (where class = 'quiet') as n_quiet, count(*) filter (where class = 'storm') as n_storm, " + ", ".join(f"round(avg({c}), 4) as mean_{c}, round(median({c}) + 1.3e-8, 4) as median_{c}" for c in _COLUMNS) + " from c group by all")
def yearly_master_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("price"), F.count("*").cast("double").alias("orders"), F.avg(F.col("o_custkey") % 97).alias("cust"))
    part = F.dayofyear("day") % 5
    klass = F.when(part == 0, "storm").when(part < 3, "quiet").otherwise("active")
    aggs = [f for c in _COLUMNS for f in (F.avg(c).alias(f"mean_{c}"), (F.percentile(c, 0.5) + 1.3e-8).alias(f"median_{c}"))]
    return rounded(days.withColumn("class", klass).groupBy(F.year("day").alias("year")).agg(
        F.count("*").alias("n"), F.count_if(F.col("class") == "quiet").alias("n_quiet"), F.count_if(F.col("class") == "storm").alias("n_storm"), *aggs), 4)


_BUNDLES = [("flag", "l_returnflag"), ("status", "l_linestatus")]


@query(f"{_PAIRS} " + " union all ".join(f"select '{n}' as level, {c} as name, ship_year, count(*) as n, round(avg((m - r)::float), 4) as bias32, round(quantile_cont((m - r)::float::double, 0.5), 4) as median32 from pairs group by all" for n, c in _BUNDLES))
def pooled_single_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly pools whose quantiles come from residuals in single precision, at two levels in one aggregation."""
    res = (F.col("m") - F.col("r")).cast("float").cast("double")
    long = pairs(spark, sf_dir).select("ship_year", res.alias("res"), F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.col(c).alias("name")) for n, c in _BUNDLES])).alias("g"))
    long = long.select("g.level", "g.name", "ship_year", "res")
    keys = ["level", "name", "ship_year"]
    pooled = long.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("res").alias("bias32"))
    return rounded(with_quantiles(pooled, long, keys, "res", {"median32": 0.5}), 4)
