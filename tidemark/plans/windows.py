"""Queries of ordered series: gaps, slips, events and detrending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import highrate, segments

from .registry import micros, query, rounded, table

_SERIES = "with s as (select user_id, event_id, value, event_type, (event_id % 16)::int as lli, (epoch_us(ts) - epoch_us(timestamp '2024-01-01'))::double / 1e6 as t from events)"
_ORDER = "(partition by user_id order by t, event_id)"
KEYS, ORDER = ["user_id"], ["t", "event_id"]


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type", (F.col("event_id") % 16).cast("int").alias("lli"), (micros("ts").cast("double") / 1e6).alias("t"))


_GAPS = f"""d as (select *, t - lag(t) over {_ORDER} as dt from s), m as (select user_id, median(dt) filter (where dt > 0) as nominal from d group by all),
 g as (select d.*, coalesce(dt <= 0 or dt > 2.5 * nominal, true) as gap from d join m using (user_id))"""


@query(_SERIES + f", {_GAPS}, k as (select user_id, t, value, sum(gap::int) over {_ORDER} - 1 as segment_id from g) select user_id, segment_id::bigint as segment_id, count(*) as n, round(max(t) - min(t), 4) as span from k group by all")
def relative_gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = highrate.relative_gaps(series(spark, sf_dir), KEYS, ORDER, "t")
    cut = highrate.event_segments(marked, KEYS, ORDER, [F.col("gap")])
    return cut.groupBy("user_id", "segment_id").agg(F.count("*").alias("n"), F.round(F.max("t") - F.min("t"), 4).alias("span"))


_EVENTS = f"""{_GAPS}, f as (select *, coalesce(gap or lli & 1 <> 0 or lli & 2 <> 0 or event_type = 'error' or value > 200, false) as flag, row_number() over {_ORDER} = 1 as head from g),
 k as (select *, sum((flag or head)::int) over {_ORDER} - 1 as segment_id from f)"""


def _event_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = highrate.relative_gaps(series(spark, sf_dir), KEYS, ORDER, "t")
    zero, one, _ = highrate.lli_bits(F.col("lli"))
    return highrate.event_segments(marked, KEYS, ORDER, [F.col("gap"), zero, one, F.col("event_type") == "error", F.col("value") > 200])


@query(_SERIES + f", {_EVENTS} select user_id, count(distinct segment_id) as segments, max(n) as longest from (select user_id, segment_id, count(*) over (partition by user_id, segment_id) as n from k) group by all")
def event_driven_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _event_cut(spark, sf_dir).groupBy("user_id", "segment_id").agg(F.count("*").alias("n"))
    return sizes.groupBy("user_id").agg(F.count("*").alias("segments"), F.max("n").alias("longest"))


@query(_SERIES + f""", d as (select *, value - 2 * lag(value, 1) over {_ORDER} + lag(value, 2) over {_ORDER} as dd from s), m as (select user_id, median(dd) as mid, count(dd) as n from d group by all),
 a as (select d.user_id, median(abs(dd - mid)) as mad from d join m using (user_id) group by all), f as (select d.*, n >= 5 and abs(dd - mid) > greatest(1.0, 2 * 1.4826 * mad) as far from d join m using (user_id) join a using (user_id)),
 l as (select *, coalesce(lead(far) over {_ORDER}, false) as cut, row_number() over {_ORDER} = 1 as head from f), k as (select *, sum((cut or head)::int) over {_ORDER} - 1 as segment_id from l)
 select event_id, segment_id::bigint as segment_id from k""")
def slip_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return highrate.slip_segments(series(spark, sf_dir), KEYS, ORDER, "value", 1.0, 2.0).select("event_id", "segment_id")


@query(_SERIES + f""", {_EVENTS}, e as (select *, least(t - min(t) over (partition by user_id, segment_id), max(t) over (partition by user_id, segment_id) - t) as edge from k)
 select user_id, floor(t / 86400)::bigint as day, count(*) as n, count(*) filter (where lli & 1 <> 0) as lli0, count(*) filter (where lli & 2 <> 0) as lli1, count(*) filter (where value > 150) as jumps, count(*) filter (where event_type = 'error') as epoch_flags,
 round(min(edge), 4) as least_edge, coalesce(min(edge) <= 120, true) as near_edge from e group by all""")
def window_bits_and_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = segments.edge_distance(_event_cut(spark, sf_dir), ["user_id", "segment_id"], "t", 120.0).withColumn("day", F.floor(F.col("t") / 86_400))
    found = highrate.window_events(cut, ["user_id", "day"], F.col("lli"), F.col("value") > 150, (F.col("event_type") == "error").cast("int"), F.col("edge"), 120.0)
    return found.withColumn("least_edge", F.round("least_edge", 4))


@query(_SERIES + """, r as (select user_id, event_id, t, value, regr_slope(value, t) over (partition by user_id) as b, avg(value) over (partition by user_id) as v, avg(t) over (partition by user_id) as m from s)
 select user_id, count(*) as n, round(min(value - v - coalesce(b, 0) * (t - m)), 4) as least, round(max(value - v - coalesce(b, 0) * (t - m)), 4) as most, round(sqrt(avg(pow(value - v - coalesce(b, 0) * (t - m), 2))), 4) as spread from r group by all""")
def linear_detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("detrended")
    found = highrate.detrended(series(spark, sf_dir), KEYS, "t", "value")
    return rounded(found.groupBy("user_id").agg(F.count("*").alias("n"), F.min(d).alias("least"), F.max(d).alias("most"), F.sqrt(F.avg(d * d)).alias("spread")), 4)


@query(_SERIES + """, w as (select user_id, event_type, floor(t / 86400)::bigint as day, count(value) as n, stddev_pop(value) as sigma from s group by all)
 select user_id, event_type, day, n, round(case when n >= ceil(3 * 0.8) then sigma end, 6) as pair_sigma, round(case when n >= floor(3 * 0.8) then sigma end, 6) as single_sigma from w""")
def sigma_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two completeness rules of the window deviation: the pair's rounds up, the single carrier's down."""
    s = series(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86_400))
    keys, n = ["user_id", "event_type", "day"], F.count("value")
    gate = lambda least: F.when(n >= least, F.stddev_pop("value"))
    return rounded(s.groupBy(*keys).agg(n.alias("n"), gate(F.ceil(F.lit(3 * 0.8))).alias("pair_sigma"), gate(F.floor(F.lit(3 * 0.8))).alias("single_sigma")))
