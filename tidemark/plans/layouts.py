"""Queries over layouts: a region and day from files along a Morton curve, coordinates joined bucket by bucket."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import new_folder
from tidemark.sources import layouts

from .registry import micros, query, table


def placed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their second and a place on the globe."""
    k, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select("event_id", F.floor(micros("ts") / 1_000_000).alias("second"), ((u * 37 % 1801) / 10.0 - 90).cast("double").alias("lat"), ((k * 53 % 3600) / 10.0 - 180).cast("double").alias("lon"), "value")


BOX = {"second": (864_000, 1_296_000), "lat": (-30.0, 45.0), "lon": (-60.0, 40.0)}


@query("""with p as (select event_id, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 1000000 as second, (user_id * 37 % 1801) / 10.0 - 90 as lat, (event_id * 53 % 3600) / 10.0 - 180 as lon, value from events)
 select event_id, second, round(lat, 4)::double as lat, round(lon, 4)::double as lon, round(value, 6) as value from p where second between 864000 and 1296000 and lat between -30 and 45 and lon between -60 and 40""")
def region_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region over five days, read from the files of a Morton layout that can hold it."""
    path = new_folder(spark, "morton")
    layouts.write_z_ordered(placed_events(spark, sf_dir), path, ["second", "lat", "lon"], 64)
    found = layouts.z_scan(spark, path, BOX)
    return found.select("event_id", "second", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), F.round("value", 6).alias("value"))


@query("""with e as (select user_id as sv, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 3600000000 as epoch, event_id, value from events),
 c as (select sv, epoch, max(value) * 3 + min(event_id) as x from e where event_id % 3 <> 0 group by all) select e.event_id, e.sv, e.epoch, round(c.x, 6) as x from e left join c on e.sv = c.sv and e.epoch = c.epoch""")
def coordinates_by_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of (sv, epoch) to all samples, both stored in buckets of that key; the coordinates' key is unique."""
    samples = table(spark, sf_dir, "events").select(F.col("user_id").alias("sv"), F.floor(micros("ts") / 3_600_000_000).alias("epoch"), "event_id", "value")
    places = samples.where("event_id % 3 <> 0").groupBy("sv", "epoch").agg((F.max("value") * 3 + F.min("event_id")).alias("x"))
    left, right = (f"tidemark_{what}_{uuid.uuid4().hex}" for what in ("samples", "places"))
    buckets = max(8, spark.sparkContext.defaultParallelism)
    layouts.write_bucketed(samples, left, new_folder(spark, left), ["sv", "epoch"], buckets)
    layouts.write_bucketed(places, right, new_folder(spark, right), ["sv", "epoch"], buckets, unique=True)
    return layouts.bucketed_join(spark, left, right, ["sv", "epoch"]).select("event_id", "sv", "epoch", F.round("x", 6).alias("x"))
