"""Catalogue of the reference's operators bound to the driver tables, each with its DuckDB SQL.

Series are ``events`` by user or type, pairs are ``lineitem`` with ``part`` (unit price against list
price), days are dates of orders. Floats are rounded once, in the last projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import align, paired, segments, stats
from tidemark.operators.quantiles import with_quantiles

from .registry import ORACLES, QUERIES, micros, query, rounded, table

# --- paired statistics --------------------------------------------------------------------------


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_shipdate", (F.col("l_extendedprice") / F.col("l_quantity")).alias("method"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("reference"))
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select("l_returnflag", "l_shipdate", F.year("l_shipdate").alias("ship_year"), F.to_date("l_shipdate").alias("ship_day"), "method", "reference")


_PAIRS = """with pairs as (select l_returnflag, year(l_shipdate)::int as ship_year, l_shipdate::date as ship_day,
  l_extendedprice / l_quantity as method, p_retailprice as reference, l_extendedprice / l_quantity - p_retailprice as res
  from lineitem join part on l_partkey = p_partkey)"""
_BUNDLE = """count(*) as n, {r}avg(res){e} as bias, {r}avg(abs(res)){e} as mae, {r}sqrt(avg(res * res)){e} as rmse, {r}stddev_pop(res){e} as std,
  {r}median(res){e} as median, {r}quantile_cont(res, 0.05){e} as p05, {r}quantile_cont(res, 0.95){e} as p95,
  {r}case when count(*) >= 2 then covar_pop(method, reference) / nullif(stddev_pop(method) * stddev_pop(reference), 0) end{e} as r"""
_RAW, _ROUND = _BUNDLE.format(r="", e=""), _BUNDLE.format(r="round(", e=", 6)")
#: Daily percentiles of decimal prices often lie on a half of the last digit; both engines leave it by this much.
NUDGE = 1.3e-8


@query(f"{_PAIRS} select l_returnflag, ship_year, {_ROUND} from pairs group by all")
def paired_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(paired.pooled_stats(pairs(spark, sf_dir), ["l_returnflag", "ship_year"], "method", "reference"))


@query(f"{_PAIRS} select ship_day, {_BUNDLE.format(r='round(', e=f' + {NUDGE}, 6)')} from pairs group by all")
def paired_stats_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = paired.paired_stats(pairs(spark, sf_dir), ["ship_day"], "method", "reference")
    return daily.select("ship_day", "n", *[F.round(F.col(m) + NUDGE, 6).alias(m) for m in paired.METRICS])


@query(f"{_PAIRS} select ship_year, {_ROUND} from pairs group by all")
def point_weighted_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(paired.pooled_stats(pairs(spark, sf_dir), ["ship_year"], "method", "reference"))


_DAILY = f"{_PAIRS}, daily as (select l_returnflag, ship_day, {_RAW} from pairs group by all)"
_EQUAL = ", ".join(f"round(avg({m}), 5) as mean_{m}, round(median({m}), 5) as median_{m}" for m in paired.METRICS)


@query(f"{_DAILY} select l_returnflag, year(ship_day)::int as ship_year, count(*) as n_days, {_EQUAL} from daily group by all")
def equal_day_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = paired.paired_stats(pairs(spark, sf_dir), ["l_returnflag", "ship_day"], "method", "reference").withColumn("ship_year", F.year("ship_day"))
    return rounded(paired.equal_day(daily, ["l_returnflag", "ship_year"]), 5)


@query(f"{_DAILY} select date_trunc('month', ship_day)::date as ship_month, count(*) as n_days, {_EQUAL} from daily group by all")
def equal_day_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = paired.paired_stats(pairs(spark, sf_dir), ["l_returnflag", "ship_day"], "method", "reference").withColumn("ship_month", F.trunc("ship_day", "month"))
    return rounded(paired.equal_day(daily, ["ship_month"]), 5)


@query("""select year(o_orderdate)::int as order_year, count(*) as n_candidates, count(l_orderkey) as n_matched, round(count(l_orderkey) / count(*), 6) as fraction
 from orders left join (select distinct l_orderkey from lineitem) on o_orderkey = l_orderkey group by all""")
def match_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("order_year"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return rounded(paired.match_fraction(orders, lines, "o_orderkey", ["order_year"]))


@query("""with d as (select o_orderdate::date as day, o_orderpriority, o_totalprice from orders),
 full_days as (select day from d group by day having count(distinct o_orderpriority) = 5)
 select o_orderpriority, count(*) as n, count(distinct day) as n_days, round(avg(o_totalprice), 4) as mean_price from d where day in (select day from full_days) group by all""")
def strict_common_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), "o_orderpriority", "o_totalprice")
    common = paired.strict_common(days, "day", "o_orderpriority", 5)
    return rounded(common.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("day").alias("n_days"), F.avg("o_totalprice").alias("mean_price")), 4)


@query("""select o_orderpriority, round(sum(o_totalprice * w) / sum(w), 4) as weighted_mean, round(sum(w), 4) as weight
 from (select o_orderpriority, o_totalprice, 1.0 / count(*) over (partition by year(o_orderdate)) as w from orders) group by all""")
def wls_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("order_year", F.year("o_orderdate"))
    sizes = orders.groupBy("order_year").agg((1.0 / F.count("*")).alias("w"))
    found = paired.weighted_summary(orders.join(sizes, "order_year"), ["o_orderpriority"], "o_totalprice", "w")
    return rounded(found.select("o_orderpriority", "weighted_mean", "weight"), 4)


# --- tables of days -----------------------------------------------------------------------------

TYPES = ("click", "error", "purchase", "signup", "view")
_PIVOT = "with d as (select ts::date as day, " + ", ".join(f"avg(value) filter (where event_type = '{t}') as {t}" for t in TYPES) + " from events group by all)"


def pivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type", "value")
    return days.groupBy("day").pivot("event_type", list(TYPES)).agg(F.avg("value"))


@query(_PIVOT + " select day, " + ", ".join(f"round({t}, 6) as {t}" for t in TYPES) + " from d where " + " and ".join(f"{t} is not null" for t in TYPES))
def strict_common_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pivoted(spark, sf_dir).dropna())


_COUPLES = [(a, b) for k, a in enumerate(TYPES) for b in TYPES[k + 1 :]]


@query(_PIVOT + " " + " union all ".join(f"select '{a}-{b}' as pair, count({a} - {b}) as n, round(avg({a} - {b}), 6) as mean_diff from d" for a, b in _COUPLES))
def pairwise_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs_of = F.explode(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("pair"), (F.col(a) - F.col(b)).alias("diff")) for a, b in _COUPLES]))
    long = pivoted(spark, sf_dir).select(pairs_of.alias("x")).select("x.*")
    return rounded(long.groupBy("pair").agg(F.count("diff").alias("n"), F.avg("diff").alias("mean_diff")))


@query("""with d as (select o_orderdate::date as day, avg(o_totalprice) as v from orders group by all)
 select date_trunc('month', day)::date as month, count(*) as n_days, round(avg(v), 4) as mean, round(median(v), 4) as median,
 round(case when count(*) >= 2 then stddev_samp(v) end, 4) as std, round(case when count(*) >= 2 then stddev_samp(v) / sqrt(count(*)) end, 4) as sem from d group by all""")
def monthly_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("v"))
    n, std = F.count("*"), F.stddev_samp("v")
    return rounded(daily.groupBy(F.trunc("day", "month").alias("month")).agg(
        n.alias("n_days"), F.avg("v").alias("mean"), F.percentile("v", 0.5).alias("median"), F.when(n >= 2, std).alias("std"), F.when(n >= 2, std / F.sqrt(n)).alias("sem")), 4)


@query("""with m as (select date_trunc('month', o_orderdate)::date as month, count(*) as n from orders where o_orderstatus = 'P' and month(o_orderdate) <> 7 group by all)
 select s.month::date as month, m.n from (select unnest(generate_series((select min(month)::timestamp from m), (select max(month)::timestamp from m), interval 1 month)) as month) s left join m on m.month = s.month::date""")
def monthly_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "P") & (F.month("o_orderdate") != 7))
    return align.month_spine(orders.groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("n")), "month")


@query("""select event_type, date_trunc('week', ts)::date as week, count(distinct ts::date) as n_days, count(*) as n, round(avg(value), 6) as mean from events group by all""")
def available_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    return rounded(events.groupBy("event_type", F.trunc("day", "week").alias("week")).agg(F.count_distinct("day").alias("n_days"), F.count("*").alias("n"), F.avg("value").alias("mean")))


@query("select year(o_orderdate)::int as order_year, " + ", ".join(f"count(distinct o_orderdate::date) filter (where month(o_orderdate) = {m}) as m{m:02d}" for m in range(1, 13)) + " from orders group by all")
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().withColumn("m", F.month("day"))
    wide = days.groupBy(F.year("day").alias("order_year")).pivot("m", list(range(1, 13))).count().fillna(0)
    return wide.select("order_year", *[F.col(f"`{m}`").alias(f"m{m:02d}") for m in range(1, 13)])


@query("""select event_type, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 7200000000 as bin, count(*) as n, round(median(value), 6) as median from events group by all""")
def bin_median_2h(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("bin", F.floor(micros("ts") / 7_200_000_000))
    counts = events.groupBy("event_type", "bin").agg(F.count("*").alias("n"))
    return rounded(with_quantiles(counts, events, ["event_type", "bin"], "value", {"median": 0.5}))


@query("""select ts::date as day, round(max(value), 6) as most, round(min(value), 6) as least, round(avg(value), 6) as mean, round(median(value), 6) as median,
 round(stddev_pop(value), 6) as std, count(distinct hour(ts)) as valid_hours from events group by all""")
def daily_index_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = "value"
    return rounded(table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.max(v).alias("most"), F.min(v).alias("least"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.stddev_pop(v).alias("std"), F.count_distinct(F.hour("ts")).alias("valid_hours")))


@query("""select l_partkey, l_suppkey, count(*) as n, round(median(l_extendedprice), 4) as price from lineitem group by all""")
def duplicate_bin_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.percentile("l_extendedprice", 0.5).alias("price")), 4)


_DAYS = "with d as (select ts::date as day, sum(value) as v from events group by all)"


def daily_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))


@query(_DAYS + " select d.day, round(d.v, 4) as v, round(a.v, 4) as v_lag1, round(b.v, 4) as v_lag2 from d left join d a on a.day = d.day - 1 left join d b on b.day = d.day - 2")
def calendar_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(align.calendar_lag(daily_sum(spark, sf_dir), "day", "v", [1, 2]), 4)


def classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return daily_sum(spark, sf_dir).withColumn("class", F.when(v >= 18_000, "storm").when(v >= 15_000, "active").otherwise("quiet"))


_CLASS = _DAYS + ", c as (select *, case when v >= 18000 then 'storm' when v >= 15000 then 'active' else 'quiet' end as class from d)"


@query(_CLASS + " select day, class from c")
def activity_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classed(spark, sf_dir).select("day", "class")


@query(_CLASS + " select class, count(*) as n, round(avg(v), 4) as mean, round(median(v), 4) as median, round(stddev_pop(v), 4) as std from c group by all")
def class_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(classed(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.percentile("v", 0.5).alias("median"), F.stddev_pop("v").alias("std")), 4)


_HARMONIC = [(k, f) for k in (1, 2) for f in ("sin", "cos")]


@query("select o_orderdate::date as day, count(*) as n, " + ", ".join(f"round({f}({2 * k} * pi() * dayofyear(o_orderdate::date) / 365.25), 6) as {f}{k}" for k, f in _HARMONIC) + " from orders group by o_orderdate::date")
def harmonics(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    angle = lambda k: 2 * k * F.pi() * F.dayofyear("day") / 365.25
    return rounded(daily.select("day", "n", *[getattr(F, f)(angle(k)).alias(f"{f}{k}") for k, f in _HARMONIC]))


# --- alignment ----------------------------------------------------------------------------------


@query("""with b as (select epoch_us(ts) - epoch_us(timestamp '2024-01-01') as et from events), h as (select unnest(range(min(et) // 3600000000, max(et) // 3600000000 + 1)) * 3600000000 as t from b), e as (select epoch_us(ts) - epoch_us(timestamp '2024-01-01') as et, value from events where event_type = 'view'),
 j as (select h.t, e.et, e.value, row_number() over (partition by h.t order by abs(e.et - h.t), e.et, e.value) as k from h join e on abs(e.et - h.t) <= 900000000)
 select h.t, j.et as matched_time, j.value, abs(j.et - h.t) as gap from h left join j on h.t = j.t and k = 1""")
def asof_nearest_tol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view nearest to each full hour from the first event to the last."""
    hour = lambda x: F.floor(x(micros("ts")) / 3_600_000_000)
    hours = table(spark, sf_dir, "events").agg(hour(F.min).alias("a"), hour(F.max).alias("b")).select(F.explode(F.sequence("a", "b")).alias("t")).select((F.col("t") * 3_600_000_000).alias("t"))
    events = table(spark, sf_dir, "events").where("event_type = 'view'").select(micros("ts").alias("t"), "value")
    return align.nearest_time(hours, events, "t", 900_000_000, [], "value")


@query("""with l as (select distinct user_id, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 60000000 as t from events where event_type = 'click'),
 e as (select user_id, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 60000000 as et, value from events where event_type = 'purchase'),
 j as (select l.*, e.et, e.value, row_number() over (partition by l.user_id, l.t order by abs(e.et - l.t), e.et, e.value) as k from l join e on e.user_id = l.user_id and abs(e.et - l.t) <= 720)
 select l.user_id, l.t, j.et as matched_time, j.value, abs(j.et - l.t) as gap from l left join j on j.user_id = l.user_id and j.t = l.t and k = 1""")
def nearest_time_tie_earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("t", F.floor(micros("ts") / 60_000_000))
    left = events.where("event_type = 'click'").select("user_id", "t").distinct()
    return align.nearest_time(left, events.where("event_type = 'purchase'").select("user_id", "t", "value"), "t", 720, ["user_id"], "value")


def _place(key: str, a: int, b: int) -> list[Column]:
    return [((F.col(key) * a) % 801 / 10.0 - 40).alias("lat"), ((F.col(key) * b) % 1201 / 10.0 - 60).alias("lon")]


_POINTS = """with p as (select c_custkey, (c_custkey * 37) % 801 / 10.0 - 40 as lat, (c_custkey * 53) % 1201 / 10.0 - 60 as lon, (c_custkey * 29) % 241 / 10.0 as t from customer)"""


@query(_POINTS + """, c as (select s_suppkey, (s_suppkey * 61) % 801 / 10.0 - 40 as clat, (s_suppkey * 97) % 1201 / 10.0 - 60 as clon from supplier),
 j as (select c_custkey, s_suppkey, clat, clon, 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(clat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clon - lon) / 2), 2)))) as km from p, c)
 select c_custkey, s_suppkey, round(km, 6) as km from (select *, row_number() over (partition by c_custkey order by km, clat, clon, s_suppkey) as k from j where km <= 300) where k = 1""")
def nearest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "customer").select("c_custkey", *_place("c_custkey", 37, 53))
    cells = table(spark, sf_dir, "supplier").select("s_suppkey", *_place("s_suppkey", 61, 97))
    return rounded(align.nearest_cell(points, cells, "c_custkey", "s_suppkey", 300.0))


_GRID = """, g as (select i, j, k, case when (i + j + k) % 17 = 0 then null else (i * 7 + j * 13 + k * 5) % 11 + 0.5 end as v
 from (select unnest(range(0, 17)) as i), (select unnest(range(0, 13)) as j), (select unnest(range(0, 13)) as k)),
 f as (select c_custkey, least(floor((lat + 40) / 5), 15)::bigint as i, least(floor((lon + 60) / 10), 11)::bigint as j, least(floor(t / 2), 11)::bigint as k, lat, lon, t from p),
 w as (select c_custkey, i + a as i, j + b as j, k + c as k,
  (case when a = 1 then (lat + 40) / 5 - i else 1 - ((lat + 40) / 5 - i) end) * (case when b = 1 then (lon + 60) / 10 - j else 1 - ((lon + 60) / 10 - j) end) * (case when c = 1 then t / 2 - k else 1 - (t / 2 - k) end) as w
  from f, (select unnest([0, 1]) as a), (select unnest([0, 1]) as b), (select unnest([0, 1]) as c))"""


@query(_POINTS + _GRID + " select c_custkey, round(case when count(v) = 8 then sum(w * v) end, 6) as value from w join g using (i, j, k) group by all")
def grid_time_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "customer").select("c_custkey", *_place("c_custkey", 37, 53), ((F.col("c_custkey") * 29) % 241 / 10.0).alias("t"))
    i, j, k = (F.col(c) for c in "ijk")
    ids = spark.range(17 * 13 * 13).select(F.floor(F.col("id") / 169).alias("i"), F.floor(F.col("id") / 13 % 13).alias("j"), (F.col("id") % 13).alias("k"))
    grid = ids.withColumn("node_value", F.when((i + j + k) % 17 != 0, (i * 7 + j * 13 + k * 5) % 11 + 0.5))
    return rounded(align.grid_interpolate(points, grid, "c_custkey", (-40.0, 5.0, 17), (-60.0, 10.0, 13), (0.0, 2.0, 13)))


@query(_POINTS + " select c_mktsegment, count(*) as n, round(avg(c_acctbal), 6) as mean from p join customer using (c_custkey) where lat between -10 and 10 and lon between -30 and 30 group by all")
def region_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal", *_place("c_custkey", 37, 53))
    return rounded(points.where("lat between -10 and 10 and lon between -30 and 30").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean")))


# --- ordered series -----------------------------------------------------------------------------

_SERIES = "with s as (select user_id, event_id, value, event_type, ((epoch_us(ts) - epoch_us(timestamp '2024-01-01'))::double / 1e6) as t from events)"
_ORDER = "(partition by user_id order by t, event_id)"
USER, ORDER = ["user_id"], ["t", "event_id"]


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type", (micros("ts").cast("double") / 1e6).alias("t"))


@query(_SERIES + f", d as (select user_id, t - lag(t) over {_ORDER} as dt from s) select user_id, round(median(dt) filter (where dt > 0), 4) as step, round(1.0 / median(dt) filter (where dt > 0), 8) as rate from d group by all")
def sample_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segments.nominal_step(series(spark, sf_dir), USER, ORDER, "t")
    return found.select("user_id", F.round("step", 4).alias("step"), F.round("rate", 8).alias("rate"))


_SEG = _SERIES + f""", d as (select *, t - lag(t) over {_ORDER} as dt from s),
 g as (select *, sum(case when dt is null or dt <= 0 or dt > 86400 then 1 else 0 end) over {_ORDER} - 1 as segment_id from d)"""


@query(_SEG + " select user_id, segment_id::bigint as segment_id, count(*) as n, round(max(t) - min(t), 4) as span, round(avg(value), 6) as mean from g group by all")
def gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = segments.gap_segments(series(spark, sf_dir), USER, ORDER, "t", 86_400.0)
    found = cut.groupBy("user_id", "segment_id").agg(F.count("*").alias("n"), F.round(F.max("t") - F.min("t"), 4).alias("span"), F.round(F.avg("value"), 6).alias("mean"))
    return found


@query(_SEG + """, e as (select *, least(t - min(t) over (partition by user_id, segment_id), max(t) over (partition by user_id, segment_id) - t) as edge from g)
 select event_id, segment_id::bigint as segment_id, round(edge, 4) as edge, edge <= 3600 as near_edge from e""")
def segment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = segments.gap_segments(series(spark, sf_dir), USER, ORDER, "t", 86_400.0)
    return segments.edge_distance(cut, ["user_id", "segment_id"], "t", 3600.0).select("event_id", "segment_id", F.round("edge", 4).alias("edge"), "near_edge")


@query(_SERIES + f""", d as (select user_id, event_id, value - lag(value) over {_ORDER} as diff from s), m as (select user_id, median(diff) as mid, count(diff) as n from d group by all),
 a as (select d.user_id, median(abs(diff - mid)) as mad from d join m using (user_id) group by all)
 select user_id, count(*) as n, count(*) filter (where abs(diff - mid) > case when n >= 10 then greatest(5.0, 3 * 1.4826 * mad) else 5.0 end) as jumps from d join m using (user_id) join a using (user_id) group by all""")
def mad_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = segments.mad_jumps(series(spark, sf_dir), USER, ORDER, "value", 5.0, factor=3.0)
    return marked.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("jump").alias("jumps"))


@query(_SERIES + f", d as (select user_id, value - 2 * lag(value, 1) over {_ORDER} + lag(value, 2) over {_ORDER} as diff2 from s) select user_id, count(diff2) as n, count(*) filter (where abs(diff2) > 200) as slips, round(max(abs(diff2)), 6) as most from d group by all")
def second_diff_slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segments.second_difference(series(spark, sf_dir), USER, ORDER, "value").withColumn("a", F.abs("diff2"))
    return rounded(found.groupBy("user_id").agg(F.count("diff2").alias("n"), F.count_if(F.col("a") > 200).alias("slips"), F.max("a").alias("most")))


@query(_SERIES + " select user_id, floor(t / 86400)::bigint as day, count(value) as n, round(case when count(value) >= 3 then stddev_pop(value) end, 6) as sigma from s group by all")
def minute_sigma_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(segments.window_sigma(series(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86_400)), ["user_id", "day"], "value", 4, 0.75))


@query(_SERIES + " select user_id, round(sqrt(greatest(0, avg(value * value) - avg(value) * avg(value))) / nullif(avg(value), 0), 6) as s4 from s where value between 1 and 200 group by all")
def normalised_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = series(spark, sf_dir).where("value between 1 and 200")
    return rounded(kept.groupBy("user_id").agg(segments.normalised_intensity(F.col("value")).alias("s4")))


@query(_SERIES + " select floor(t / 7200)::bigint as win, count(*) filter (where event_type = 'error') as errors, count(*) filter (where value > 100) as jumps, count(*) as n from s group by all")
def window_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir).withColumn("win", F.floor(F.col("t") / 7200))
    return s.groupBy("win").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 100).alias("jumps"), F.count("*").alias("n"))


@query(_SERIES + " select user_id, event_type, event_id, value from s qualify row_number() over (partition by user_id, event_type order by t, event_id) = 1")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.keep_one(series(spark, sf_dir), ["user_id", "event_type"], [F.col("t"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query(_SERIES + " select user_id, event_type, event_id, value from s qualify row_number() over (partition by user_id, event_type order by t desc, event_id desc) = 1")
def dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.keep_one(series(spark, sf_dir), ["user_id", "event_type"], [F.desc("t"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query(_SERIES + ", c as (select user_id, event_type, count(*) as n, round(avg(value), 6) as mean from s group by all) select user_id, event_type, n, mean from c qualify row_number() over (partition by user_id order by n desc, event_type) = 1")
def dedup_most_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = series(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return rounded(segments.keep_one(counts, ["user_id"], [F.desc("n"), F.col("event_type")]))


@query(_SERIES + f""", f as (select *, first_value(case when value > 50 then event_type end ignore nulls) over (partition by user_id order by t, event_id rows between unbounded preceding and current row) as learned from s)
 select user_id, learned, count(*) as n, count(*) filter (where event_type = learned) as same from f group by all""")
def sticky_carrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir).withColumn("seen", F.when(F.col("value") > 50, F.col("event_type")))
    learned = segments.sticky(s, USER, ORDER, "seen", "learned")
    return learned.groupBy("user_id", "learned").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == F.col("learned")).alias("same"))


# --- joins and sets -----------------------------------------------------------------------------


@query("""with a as (select user_id, count(*) as n_error from events where event_type = 'error' and value > 150 group by all), b as (select user_id, count(*) as n_view from events where event_type = 'view' and value > 150 group by all)
 select coalesce(a.user_id, b.user_id) as user_id, n_error, n_view from a full outer join b on a.user_id = b.user_id""")
def outer_merge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("value > 150")
    one, two = (events.where(F.col("event_type") == t).groupBy("user_id").agg(F.count("*").alias(f"n_{t}")) for t in ("error", "view"))
    return one.join(two, "user_id", "full_outer")


@query("select o_orderkey, o_totalprice from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity >= 49)")
def semi_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("select o_orderkey, o_totalprice from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def anti_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_anti").select("o_orderkey", "o_totalprice")


@query("select r_name as name, r_regionkey as region, null::int as nation from region union all select n_name, n_regionkey, n_nationkey from nation")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("region"))
    two = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return one.unionByName(two, allowMissingColumns=True)


# --- statistics ---------------------------------------------------------------------------------


@query("""with r as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as rx, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0 as ry from lineitem)
 select count(*) as n, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) as rho from r""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"))


@query("""with p as (select p_partkey, case when p_partkey % 50 = 0 then null else ((p_partkey * 7919) % 10007 + 1) / 10008.0 end as p from part),
 k as (select *, row_number() over (order by p, p_partkey) as k, count(*) over () as m from p where p is not null),
 q as (select p_partkey, least(1.0, min(p * m / k) over (order by k rows between current row and unbounded following)) as q from k)
 select p.p_partkey, round(p.p, 8) as p, round(q.q, 8) as q from p left join q on p.p_partkey = q.p_partkey""")
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("p_partkey") % 50 != 0, ((F.col("p_partkey") * 7919) % 10007 + 1) / 10008.0)
    return rounded(stats.benjamini_hochberg(table(spark, sf_dir, "part").select("p_partkey", p.alias("p")), "p", "p_partkey"), 8)


_LAGS = " union all ".join(f"select event_type, {n} as lag, count(*) as n, corr(a.v, b.v) as r from d a join d b using (event_type) where b.day = a.day - {n} group by all" for n in range(4))


@query(f"""with d as (select event_type, ts::date as day, avg(value) as v from events group by all), c as ({_LAGS.replace('join d b using (event_type)', 'join d b on a.event_type = b.event_type').replace('select event_type', 'select a.event_type')})
 select event_type, lag, n, round(r, 6) as r from c where lag > 0 qualify row_number() over (partition by event_type order by abs(round(r, 6)) desc, lag) = 1""")
def best_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    shifted = daily.select("event_type", F.col("v").alias("w"), "day", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("lag")).withColumn("day", F.date_add("day", F.col("lag")))
    met = daily.join(shifted, ["event_type", "day"])
    r = F.round(F.try_divide(F.covar_pop("v", "w"), F.nullif(F.stddev_pop("v") * F.stddev_pop("w"), F.lit(0.0))), 6)
    found = met.groupBy("event_type", "lag").agg(F.count("*").alias("n"), r.alias("r"))
    return segments.keep_one(found, ["event_type"], [F.desc(F.abs("r")), F.col("lag")])


@query("""with d as (select o_orderdate::date as day, avg(o_totalprice) as v, count(*) as c from orders group by all), w as (select *, 1.0 / count(*) over (partition by year(day)) as w from d),
 m as (select sum(w * c) / sum(w) as mc, sum(w * v) / sum(w) as mv from w) select round(sum(w * (c - mc) * (v - mv)) / sum(w * (c - mc) * (c - mc)), 4) as slope from w, m""")
def equal_year_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("v"), F.count("*").cast("double").alias("c")).withColumn("y", F.year("day"))
    w = daily.join(daily.groupBy("y").agg((1.0 / F.count("*")).alias("w")), "y")
    s = w.agg(*[F.sum(F.expr(e)).alias(n) for n, e in (("sw", "w"), ("sc", "w * c"), ("sv", "w * v"), ("scv", "w * c * v"), ("scc", "w * c * c"))])
    return rounded(s.select(F.expr("(scv - sc * sv / sw) / (scc - sc * sc / sw)").alias("slope")), 4)


_OLS = ", ".join(f"covar_pop({a}, {b}) as {n}" for n, a, b in (("s11", "x1", "x1"), ("s22", "x2", "x2"), ("s12", "x1", "x2"), ("s1y", "x1", "y"), ("s2y", "x2", "y"), ("syy", "y", "y")))


@query(f"""with v as (select l_returnflag, l_extendedprice as y, l_quantity as x1, l_discount as x2 from lineitem), s as (select l_returnflag, count(*) as n, avg(y) as my, avg(x1) as m1, avg(x2) as m2, {_OLS} from v group by all),
 b as (select *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) as b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) as b2 from s)
 select l_returnflag, n, round(my - b1 * m1 - b2 * m2, 3) as b0, round(b1, 3) as b1, round(b2, 3) as b2, round((b1 * s1y + b2 * s2y) / syy, 6) as r2 from b""")
def ols_two_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.ols_two(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", "l_discount", ["l_returnflag"])
    return found.select("l_returnflag", "n", *[F.round(c, 3).alias(c) for c in ("b0", "b1", "b2")], F.round("r2", 6).alias("r2"))


@query("""with r as (select o_orderstatus, rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice) - 1) / 2.0 as rk from orders)
 select count(*) filter (where o_orderstatus = 'P') as n1, count(*) filter (where o_orderstatus <> 'P') as n2,
 round(sum(rk) filter (where o_orderstatus = 'P') - count(*) filter (where o_orderstatus = 'P') * (count(*) filter (where o_orderstatus = 'P') + 1) / 2.0, 2) as u from r""")
def mann_whitney_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.mann_whitney_u(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderstatus", "P"), 2)


_WELCH = ", ".join(f"count(*) filter (where g = '{g}') as n{k}, avg(v) filter (where g = '{g}') as m{k}, var_samp(v) filter (where g = '{g}') as v{k}" for k, g in (("a", "F"), ("b", "O")))


@query(f"""with s as (select {_WELCH} from (select o_orderstatus as g, o_totalprice as v from orders))
 select na, nb, round((ma - mb) / sqrt(va / na + vb / nb), 6) as t, round(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)), 4) as df from s""")
def welch_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.welch_t(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderstatus", "F", "O")
    return found.select("na", "nb", F.round("t", 6).alias("t"), F.round("df", 4).alias("df"))


@query(f"{_PAIRS} select ship_year, count(*) filter (where res > 0) as n_pos, count(*) filter (where res < 0) as n_neg, count(*) as n from pairs group by all")
def sign_test_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = F.col("method") - F.col("reference")
    return pairs(spark, sf_dir).groupBy("ship_year").agg(F.count_if(res > 0).alias("n_pos"), F.count_if(res < 0).alias("n_neg"), F.count("*").alias("n"))


@query("""with c as (select date_trunc('month', o_orderdate)::date as month, sum(o_totalprice) as total, count(*) as cnt from orders group by all), i as (select *, row_number() over (order by month) - 1 as idx, count(*) over () as n from c),
 r as (select rep, i.total, i.cnt from (select unnest(range(0, 1000)) as rep) x, (select unnest(range(0, (select count(*) from c))) as slot) y join i on i.idx = ('0x' || substr(md5(rep::varchar || '/' || slot::varchar || '/20260822'), 1, 15))::bigint % i.n),
 m as (select rep, sum(total) / sum(cnt) as mean from r group by all) select count(*) as reps, round(avg(mean), 3) as mean, round(quantile_cont(mean, 0.025), 3) as low, round(quantile_cont(mean, 0.975), 3) as high from m""")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("cnt"))
    return rounded(stats.cluster_bootstrap(months, "month", "total", "cnt", 1000, 20_260_822), 3)


@query(f"{_DAILY} select l_returnflag, ship_day, n, round(bias, 6) as bias from daily order by abs(round(bias, 6)) desc, n desc, ship_day, l_returnflag limit 25")
def topk_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = paired.paired_stats(pairs(spark, sf_dir), ["l_returnflag", "ship_day"], "method", "reference").select("l_returnflag", "ship_day", "n", F.round("bias", 6).alias("bias"))
    return daily.orderBy(F.desc(F.abs("bias")), F.desc("n"), "ship_day", "l_returnflag").limit(25)


# the other query modules register theirs
from . import archives, events, files, formats, highrate, layouts, regression, selection, streams, summaries, windows  # noqa: E402,F401

__all__ = ["ORACLES", "QUERIES"]
