"""Queries of the streaming forms, run over the event file until it is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import new_folder
from tidemark.streaming import windows as st

from .registry import micros, query, rounded, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.file_stream(spark, sf_dir, table(spark, sf_dir, "events").schema, "events.parquet").withColumn("at", F.col("ts").cast("timestamp"))


def _seconds(c: str) -> F.Column:
    return F.unix_seconds(c) - F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))


@query("select floor(((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 60000000) / 60)::bigint * 3600 as start, event_type, count(*) as n, round(avg(value), 6) as mean from events group by all")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = st.tumbling(_events(spark, sf_dir), "at", "1 hour", "2 hours", ["event_type"], [F.count("*").alias("n"), F.avg("value").alias("mean")])
    rows = st.latest(st.run_to_table(windows, new_folder(spark, "tumbling"), "update"), ["window_start", "event_type"])
    return rounded(rows.select(_seconds("window_start").alias("start"), "event_type", "n", "mean"))


_ARCS = """with d as (select user_id, epoch_us(ts) - epoch_us(timestamp '2024-01-01') as t, lag(epoch_us(ts) - epoch_us(timestamp '2024-01-01')) over (partition by user_id order by ts) as p from (select distinct user_id, ts from events)),
 g as (select *, sum(case when p is null or t - p > 43200000000 then 1 else 0 end) over (partition by user_id order by t) - 1 as arc from d)"""


@query(_ARCS + " select user_id::varchar as series, arc::bigint as arc, min(t) as first_us, max(t) as last_us, count(*) as n from g group by all")
def stream_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).withColumn("t", micros("ts"))
    rows = st.run_to_table(st.arcs(events, "user_id", "t", 43_200_000_000), new_folder(spark, "arcs"), "update")
    return st.latest(rows.drop("closed"), ["series", "arc"])


@query("""with d as (select user_id, epoch_us(ts) - epoch_us(timestamp '2024-01-01') as t, value, lag(epoch_us(ts) - epoch_us(timestamp '2024-01-01')) over (partition by user_id order by ts) as p from events),
 g as (select *, sum(case when p is null or t - p >= 43200000000 then 1 else 0 end) over (partition by user_id order by t) - 1 as arc from d) select user_id, min(t) // 1000000 as start, count(*) as n, round(max(value), 6) as most from g group by user_id, arc""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the sessions, with the same function as the stream's."""
    events = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    found = st.sessions(events, "at", "12 hours", "1 hour", ["user_id"], [F.count("*").alias("n"), F.max("value").alias("most")])
    return found.select("user_id", _seconds("arc_start").alias("start"), "n", F.round("most", 6).alias("most"))


@query("""with d as (select user_id, epoch_us(ts) as t, min(value) as value from events group by all), g as (select *, t - lag(t) over (partition by user_id order by t) as dt from d),
 s as (select *, sum(case when dt is null or dt > 86400000000 then 1 else 0 end) over (partition by user_id order by t) as arc from g)
 select user_id::varchar as series, min(t) as arc_begin_us, count(*) as n, case when count(*) >= 60 then count(*) else 0 end as n_filtered, round(sum(value), 4) as total from s group by user_id, arc""")
def stream_closed_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks of events arriving as files; the samples of each arc are filtered and emitted when the watermark has closed it."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("series"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")
    events = events.withColumn("at", F.timestamp_micros("t"))
    path = new_folder(spark, "closing")
    week = F.floor(F.col("t") / (7 * 86_400_000_000))
    last = 0
    for number, (k,) in enumerate(events.select(week).distinct().orderBy(week).collect()):  # one job for each file set that arrives
        events.where(week == k).write.parquet(f"{path}/in/week={number:05d}")
        last = k
    end = spark.range(1).select(F.lit(None).cast("string").alias("series"), F.lit(None).cast("long").alias("t"), F.lit(None).cast("double").alias("value"), F.timestamp_micros(F.lit((last + 60) * 7 * 86_400_000_000)).alias("at"))
    end.write.parquet(f"{path}/in/week=99999")
    stream = st.file_stream(spark, f"{path}/in/*", events.schema)
    with st.state_in_rocksdb(spark, spark.sparkContext.defaultParallelism):
        rows = st.run_to_table(st.closed_arcs(stream, "at", "series", "t", "value", 86_400_000_000, "8 days", 1.0), f"{path}/out", "append")
    return rows.groupBy("series", "arc_begin_us").agg(F.count("*").alias("n"), F.count("filtered").alias("n_filtered"), F.round(F.sum("value"), 4).alias("total"))
