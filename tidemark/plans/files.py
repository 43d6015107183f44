"""Queries that write tables as files and read them back through the readers, and the grid rule of finite corners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import align
from tidemark.session import new_folder
from tidemark.sources import readers, sinks, tables

from .registry import query, rounded, table


@query("select o_orderkey, case when o_orderkey % 7 = 0 then null else o_totalprice end as price, o_orderdate::date as day, null::double as more from orders")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered CSV table with cells that are no numbers, read under a contract with an optional column."""
    path = f"{new_folder(spark, 'csv')}/orders"
    price = F.when(F.col("o_orderkey") % 7 == 0, "bad").otherwise(F.col("o_totalprice").cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", price.alias("price"), F.to_date("o_orderdate").alias("day"), F.lit("x").alias("ignored"))
    sinks.write_result(rows, path, ["o_orderkey"])
    return tables.csv_table(spark, path, {"o_orderkey": "long", "price": "double", "day": "date", "more": "double"}, optional=("more",))


@query("select year(ts)::int as year, dayofyear(ts)::int as doy, count(*) as n, round(sum(case when day(ts) <= 10 then 2 * value else value end), 2) as value from events group by all")
def day_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as partitions; writing the first ten days of each month again replaces these alone."""
    path = f"{new_folder(spark, 'days')}/events"
    events = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "value")
    sinks.write_days(events, path, "day")
    sinks.write_days(events.where("day(day) <= 10").withColumn("value", F.col("value") * 2), path, "day")
    stored = spark.read.schema("day date, value double, year int, doy int").parquet(path)
    return stored.groupBy("year", "doy").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query("""select c_custkey::double as c_custkey, case when c_custkey % 5 = 0 then null else (c_custkey % 90) / 10.0 end::double as kp, case when c_custkey % 8 = 0 then null else -(c_custkey % 300)::double end as dst from customer""")
def sentinel_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of words at white space with its sentinels, written and read back by word number."""
    path = f"{new_folder(spark, 'words')}/indices"
    k = F.col("c_custkey")
    kp, dst = F.when(k % 5 == 0, F.lit(99.0)).otherwise((k % 90) / 10), F.when(k % 8 == 0, F.lit(99999.0)).otherwise(-(k % 300).cast("double"))
    line = F.concat_ws("   ", k.cast("string"), F.lit("word"), kp.cast("string"), dst.cast("string"))
    table(spark, sf_dir, "customer").select(line).write.text(path)
    return readers.word_table(spark, path, {"c_custkey": 1, "kp": 3, "dst": 4}, {"kp": 99, "dst": 99999})


LAT, LON, TIME = [-39 + 4.75 * i + 0.5 * (i % 2) for i in range(17)], [-55 + 9.25 * j + 0.25 * (j % 3) for j in range(13)], [1 + 1.75 * k + 0.25 * (k % 2) for k in range(13)]
_AXES = [(n, axis, f"[{', '.join(f'{x}::double' for x in axis)}]") for n, axis in (("lat", LAT), ("lon", LON), ("t", TIME))]
_AT = ", ".join(f"case when {n} between {a[0]} and {a[-1]} then least(len(list_filter({s}, lambda v: v <= {n})) - 1, {len(a) - 2}) end as {n}_at" for n, a, s in _AXES)
_SHARE = ", ".join(f"({n} - {s}[{n}_at + 1]) / ({s}[{n}_at + 2] - {s}[{n}_at + 1]) as {n}_f" for n, a, s in _AXES)


@query(f"""with p as (select c_custkey, ((c_custkey * 37) % 801 / 10.0 - 40)::double as lat, ((c_custkey * 53) % 1201 / 10.0 - 60)::double as lon, ((c_custkey * 29) % 241 / 10.0)::double as t from customer),
 g as (select i, j, k, case when (i + j + k) % 3 = 0 or k % 6 = 2 then null else (i * 7 + j * 13 + k * 5) % 11 + 0.5 end::double as v from (select unnest(range(0, 17)) as i), (select unnest(range(0, 13)) as j), (select unnest(range(0, 13)) as k)),
 a as (select *, {_AT} from p), f as (select *, {_SHARE} from a),
 w as (select c_custkey, t_f, c, (case when a = 1 then lat_f else 1 - lat_f end) * (case when b = 1 then lon_f else 1 - lon_f end) as w, v
  from f, (select unnest([0, 1]) as a), (select unnest([0, 1]) as b), (select unnest([0, 1]) as c) left join g on g.i = lat_at + a and g.j = lon_at + b and g.k = t_at + c),
 m as (select c_custkey, any_value(t_f) as f, sum(w * v) filter (where c = 0) / nullif(sum(w) filter (where c = 0 and v is not null), 0) as v0, sum(w * v) filter (where c = 1) / nullif(sum(w) filter (where c = 1 and v is not null), 0) as v1 from w group by all)
 select c_custkey, round(coalesce((1 - f) * v0 + f * v1, v0, v1), 6) as value from m""")
def grid_finite_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights over the finite corners, one map where the other has none, nothing outside the axes."""
    c = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(
        "c_custkey", ((c * 37) % 801 / 10.0 - 40).cast("double").alias("lat"), ((c * 53) % 1201 / 10.0 - 60).cast("double").alias("lon"), ((c * 29) % 241 / 10.0).cast("double").alias("t"))
    i, j, k = (F.col(n) for n in "ijk")
    ids = spark.range(17 * 13 * 13).select(F.floor(F.col("id") / 169).alias("i"), F.floor(F.col("id") / 13 % 13).alias("j"), (F.col("id") % 13).alias("k"))
    value = F.when(((i + j + k) % 3 != 0) & (k % 6 != 2), ((i * 7 + j * 13 + k * 5) % 11 + 0.5).cast("double"))
    return rounded(align.grid_interpolate_finite(points, ids.withColumn("node_value", value), "c_custkey", LAT, LON, TIME))
