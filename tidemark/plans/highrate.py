"""Queries of geodesy, carriers, orbits and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geodesy as geo
from tidemark.operators import highrate, long_arcs, scans

from .registry import micros, query, rounded, table

_E2 = 6.69437999014131699613723354004e-3
_STATION = "(c_custkey * 37) % 1781 / 10.0 - 89 as lat, (c_custkey * 53) % 3599 / 10.0 - 179.9 as lon, (c_custkey * 7) % 9000 / 3.0 as h"
_ECEF = f"""p as (select c_custkey, {_STATION} from customer), n as (select *, 6378137.0 / sqrt(1 - {_E2} * pow(sin(radians(lat)), 2)) as nn from p),
 x as (select *, (nn + h) * cos(radians(lat)) * cos(radians(lon)) as x, (nn + h) * cos(radians(lat)) * sin(radians(lon)) as y, (nn * (1 - {_E2}) + h) * sin(radians(lat)) as z from n)"""


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    places = table(spark, sf_dir, "customer").select("c_custkey", ((k * 37) % 1781 / 10.0 - 89).alias("lat"), ((k * 53) % 3599 / 10.0 - 179.9).alias("lon"), ((k * 7) % 9000 / 3.0).alias("h"))
    return places.withColumn("e", geo.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("h"))).select("*", "e.*")


@query(f"with {_ECEF} select c_custkey, round(x, 3) as x, round(y, 3) as y, round(z, 3) as z, round(lat, 7) as lat, round(lon, 7) as lon, round(h, 4) as height from x")
def geodetic_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places to Cartesian coordinates and back; the SQL states the places themselves."""
    back = stations(spark, sf_dir).withColumn("g", geo.ecef_to_geodetic(F.col("x"), F.col("y"), F.col("z")))
    return back.select("c_custkey", *[F.round(c, 3).alias(c) for c in "xyz"], F.round("g.lat", 7).alias("lat"), F.round("g.lon", 7).alias("lon"), F.round("g.height", 4).alias("height"))


@query(f"""with {_ECEF}, d as (select c_custkey, radians(lat) as la, radians(lon) as lo, 2e7 - x as dx, 1e7 - y as dy, 5e6 - z as dz from x),
 e as (select c_custkey, -sin(lo) * dx + cos(lo) * dy as e, -sin(la) * cos(lo) * dx - sin(la) * sin(lo) * dy + cos(la) * dz as n, cos(la) * cos(lo) * dx + cos(la) * sin(lo) * dy + sin(la) * dz as u from d)
 select c_custkey, round(case when degrees(atan2(e, n)) < 0 then degrees(atan2(e, n)) + 360 else degrees(atan2(e, n)) end, 6) as azimuth, round(degrees(atan2(u, sqrt(e * e + n * n))), 6) as elevation from e""")
def azimuth_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    look = geo.azimuth_elevation(F.lit(2e7) - F.col("x"), F.lit(1e7) - F.col("y"), F.lit(5e6) - F.col("z"), F.col("lat"), F.col("lon"))
    return stations(spark, sf_dir).withColumn("a", look).select("c_custkey", F.round("a.azimuth", 6).alias("azimuth"), F.round("a.elevation", 6).alias("elevation"))


@query("""with v as (select c_custkey, (c_custkey * 53) % 1441 - 720 + 0.25 as lon, c_custkey % 366 + 1 as doy, 1980 + c_custkey % 60 as y from customer)
 select c_custkey, ((lon + 180) % 360 + 360) % 360 - 180 as wrapped, ((lon - 20) % 360 + 360) % 360 + 20 as on_grid, case when doy <= dayofyear(make_date(y, 12, 31)) then (make_date(y, 1, 1) + (doy - 1)::int)::date end as day,
 ((make_date(y, 1, 1) - date '1980-01-06') - case when (make_date(y, 1, 1) - date '1980-01-06') % 7 < 0 then 7 + (make_date(y, 1, 1) - date '1980-01-06') % 7 else (make_date(y, 1, 1) - date '1980-01-06') % 7 end) // 7 as gps_week,
 dayofyear(make_date(y, 12, 31)) as year_days, 60000 + c_custkey * 0.125 as mjd, epoch_us(timestamp '1858-11-17' + to_microseconds((c_custkey * 10800000000 + 60000 * 86400000000)::bigint)) // 1000000 as unix_seconds from v""")
def longitudes_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    v = table(spark, sf_dir, "customer").select("c_custkey", ((k * 53) % 1441 - 720 + 0.25).alias("lon"), (k % 366 + 1).alias("doy"), (F.lit(1980) + k % 60).cast("int").alias("y"), (60000 + k * 0.125).cast("double").alias("mjd"))
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), geo.mjd_to_timestamp(F.col("mjd")))
    return v.select(
        "c_custkey", geo.wrap_longitude(F.col("lon").cast("double")).alias("wrapped"), geo.normalised_grid_longitude(F.col("lon").cast("double"), 20.0).alias("on_grid"), geo.day_of_year_date(F.col("y"), F.col("doy")).alias("day"),
        geo.gps_week(F.make_date("y", F.lit(1), F.lit(1))).alias("gps_week"), geo.days_in_year(F.col("y")).cast("long").alias("year_days"), "mjd", seconds.alias("unix_seconds"))


_HZ = "case when sys = 'G' then case band when '1' then 1575420000e0 when '2' then 1227600000e0 when '5' then 1176450000e0 end when sys = 'E' then case band when '1' then 1575420000e0 when '5' then 1176450000e0 when '6' then 1278750000e0 when '7' then 1207140000e0 when '8' then 1191795000e0 end when sys = 'R' then case band when '1' then (1602 + 0.5625 * ch) * 1e6 when '2' then (1246 + 0.4375 * ch) * 1e6 when '3' then 1202025000e0 end end"


@query(f"""with b as (select p_partkey, substr('GREC', (p_partkey % 4 + 1)::int, 1) as sys, substr('125678', (p_partkey % 6 + 1)::int, 1) as band, p_partkey % 14 - 7 as ch from part), h as (select *, {_HZ} as hz from b)
 select p_partkey, hz::double as hz, round(1000.5e0 * 299792458e0 / hz, 9) as metres, round(0.02 * (pow(1227.6e6, 2) / (pow(hz, 2) - pow(1227.6e6, 2))) * 2 * pi() * hz / 299792458e0, 9) as phase from h where hz is not null and hz <> 1227.6e6""")
def carrier_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    b = table(spark, sf_dir, "part").select("p_partkey", F.substring(F.lit("GREC"), (k % 4 + 1).cast("int"), F.lit(1)).alias("sys"), F.substring(F.lit("125678"), (k % 6 + 1).cast("int"), F.lit(1)).alias("band"), (k % 14 - 7).alias("ch"))
    h = b.withColumn("hz", geo.band_hz(F.col("sys"), F.col("band"), F.col("ch").cast("double"))).where("hz is not null and hz <> 1227600000D")
    l2 = F.lit(1227.60e6)
    return h.select("p_partkey", "hz", F.round(geo.cycles_to_metres(F.lit(1000.5), F.col("hz")), 9).alias("metres"), F.round(geo.geometry_free_to_phase(F.lit(0.02), F.col("hz"), l2), 9).alias("phase"))


_OBS = """o as (select user_id as sv, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 21600000000 as epoch, case when event_type in ('view', 'error') then 'b' else 'a' end as carrier, event_type as obs,
 max(value) * 1000 as cycles, case when event_type in ('view', 'error') then 1227600000.0 else 1575420000.0 end as hz from events group by all)"""


@query(f"""with {_OBS}, k as (select *, first_value(obs) over (partition by sv, carrier order by epoch, obs) as kept, cycles * 299792458.0 / hz as metres from o), c as (select sv, count(*) filter (where obs <> kept) as conflicts from k group by all),
 a as (select sv, epoch, obs, metres from k where obs = kept and carrier = 'a'), b as (select sv, epoch, obs, metres from k where obs = kept and carrier = 'b')
 select a.sv, a.epoch, a.obs as obs_a, b.obs as obs_b, round(a.metres - b.metres, 6) as gf_m, conflicts from a join b on a.sv = b.sv and a.epoch = b.epoch join c on c.sv = a.sv""")
def geometry_free_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.col("event_type").isin("view", "error")
    events = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("sv"), F.floor(micros("ts") / 21_600_000_000).alias("epoch"), F.col("event_type").alias("obs")).agg((F.max("value") * 1000).alias("cycles"))
    second = F.col("obs").isin("view", "error")
    obs = events.withColumn("carrier", F.when(second, "b").otherwise("a")).withColumn("hz", F.when(second, 1227.60e6).otherwise(1575.42e6))
    return rounded(highrate.geometry_free(obs))


def _arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each user as samples of one arc; the same place in the order is the same sample."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return events.withColumn("value", F.col("value") + 20)


@query(None)
def filtered_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of the high-passed values and mean of the ratio to the low-pass trend by arc; tested against a recursion."""
    found = highrate.filtered(_arcs(spark, sf_dir), ["user_id"], "event_id", "value", 1.0)
    return found.groupBy("user_id").agg(F.count("*").alias("n"), F.count("filtered").alias("n_filtered"), F.round(F.stddev_pop("filtered"), 6).alias("sigma"), F.round(F.avg("ratio"), 6).alias("mean_ratio"))


def cut_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each user in time, some marked as lost lock."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", (micros("ts") / 1_000_000).alias("t"), (F.col("value") + 20).alias("value"), "event_type")
    return events.withColumn("lost", (F.col("event_type") == "error") & (F.col("event_id") % 50 == 0)).drop("event_type")


@query(None)
def arcs_cut_and_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs cut at gaps of four days and at lost lock, in time buckets, then filtered each; tested against loop and recursion."""
    arcs = scans.bucketed_segments(cut_samples(spark, sf_dir), ["user_id"], "t", ["event_id"], 10 * 86_400, 4 * 86_400, F.col("lost"))
    found = long_arcs.filtered_blocks(arcs, ["user_id", "segment_id"], ["t", "event_id"], "value", 1.0, 10 * 86_400)
    return found.groupBy("user_id", "segment_id").agg(F.count("*").alias("n"), F.count("filtered").alias("n_filtered"), F.round(F.stddev_pop("filtered"), 6).alias("sigma"))


def one_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.lit("all").alias("series"), (micros("ts") / 1_000_000).alias("t"), "event_id", (F.col("value") + 20).alias("value"))


@query(None)
def long_arc_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as samples of one arc, filtered in blocks of an hour; tested against the recursion over the whole arc."""
    return rounded(long_arcs.filtered_blocks(one_arc(spark, sf_dir), ["series"], ["t", "event_id"], "value", 1.0, 3_600))


def orbit_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Epochs every 900 s of one day for the nations, some missing, and the orders' times as queries."""
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("G"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("sv"), F.col("n_nationkey").alias("k"))
    epochs = nation.select("sv", "k", F.explode(F.sequence(F.lit(0), F.lit(95))).alias("e")).where("(e * 7 + k) % 13 <> 0 and (k <> 3 or e < 3)")
    angle = F.col("e") * 900 * 2 * F.pi() / 43_080 + F.col("k")
    orbits = epochs.select("sv", (F.col("e") * 900).cast("double").alias("t"), (2.6e7 * F.cos(angle)).alias("x"), (2.0e7 * F.sin(angle)).alias("y"), (1.6e7 * F.sin(angle)).alias("z"))
    asked = table(spark, sf_dir, "orders").select(F.concat(F.lit("G"), F.lpad((F.col("o_custkey") % 26).cast("string"), 2, "0")).alias("sv"), ((F.col("o_orderkey") * 37) % 90_000).cast("double").alias("t"))
    return asked, orbits


@query(None)
def orbit_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions by spline; tested against a dense solution of the same conditions."""
    return rounded(highrate.orbit_positions(*orbit_tables(spark, sf_dir)), 3)
