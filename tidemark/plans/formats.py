"""Queries of the readers: each writes a driver table in a reader's format and reads it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import align
from tidemark.session import new_folder
from tidemark.sources import readers, tables

from .registry import micros, query, rounded, table


def _text(df: DataFrame, line: Column, label: str, **options: str) -> str:
    """Lines of a table in a new folder."""
    path = f"{new_folder(df.sparkSession, label)}/lines"
    df.select(line.alias("value")).write.options(**options).text(path)
    return path


def _seconds(epoch: str) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(epoch))


@query("""select user_id::varchar as sv, count(*) as n, max(epoch_us(ts)) // 1000000 as last_second, round(sum(value), 4) as vtec, count(case when event_id % 9 <> 0 then 1 end) as n_veq from events where event_id % 90 >= 30 group by all""")
def tec_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide table of methods with text times: seven columns are read, cells that are no numbers are null, low elevations go."""
    e = table(spark, sf_dir, "events")
    path = f"{new_folder(spark, 'tec')}/rows"
    k = F.col("event_id")
    e.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("epoch"), F.col("user_id").cast("string").alias("sv"), F.lit(1.5).alias("lat_ipp"), F.lit(2.5).alias("lon_ipp"), (k % 90).cast("int").alias("ele"),
        F.col("value").alias("vtec"), F.when(k % 9 == 0, "none").otherwise("3.25").alias("veq"), F.lit("unread").alias("station")).write.parquet(path)
    found = tables.tec_table(spark, path).where("ele >= 30")
    return found.groupBy("sv").agg(F.count("*").alias("n"), F.max(_seconds("epoch")).alias("last_second"), F.round(F.sum("vtec"), 4).alias("vtec"), F.count("veq").alias("n_veq"))


@query("""with p as (select event_id, ts, (user_id * 37 % 1801) / 10.0 - 90 as gdlat, (event_id * 53 % 3600) / 10.0 - 180 as glon, value as tec from events)
 select event_id, gdlat::double as gdlat, glon::double as glon, round(tec, 6) as tec, null::double as dtec from p where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-06' and gdlat between -60 and 60 and glon between -90 and 120""")
def regional_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins under other names and cases, resolved to ours; one day and box, the filter at the Parquet scan."""
    path = f"{new_folder(spark, 'bins')}/rows"
    k, u = F.col("event_id"), F.col("user_id")
    table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp_ntz").alias("Epoch"), ((u * 37 % 1801) / 10.0 - 90).cast("double").alias("GDLAT"), ((k * 53 % 3600) / 10.0 - 180).cast("double").alias("LON"), F.col("value").alias("Tec"), "event_id").write.parquet(path)
    ours = tables.resolved(spark.read.parquet(path), {"epoch": ("epoch", "time"), "gdlat": ("lat", "gdlat"), "glon": ("glon", "lon"), "tec": ("tec",), "dtec": ("dtec", "sigma"), "event_id": ("event_id",)}, ("dtec",))
    return rounded(tables.region_day(ours, "2024-01-05", (-60.0, 60.0, -90.0, 120.0)).drop("epoch"))


@query("select o_orderkey, (o_orderkey % 2000 + 50000 - 40587) * 86400 + (o_orderkey % 4) * 21600 as second, case when o_orderkey % 5 = 0 then null else -(o_orderkey % 77) / 4.0 end::double as v from orders")
def mjd_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compressed headerless table of eight columns whose time is a modified Julian date."""
    k = F.col("o_orderkey")
    mjd, v = (k % 2000 + 50_000 + k % 4 * 0.25).cast("double"), F.when(k % 5 == 0, "****").otherwise((-(k % 77) / 4.0).cast("decimal(10,2)").cast("string"))
    names = ["mjd", "a", "b", "o_orderkey", "c", "v", "d", "e"]
    line = F.concat(F.lit("  "), F.concat_ws("   ", F.format_string("%.2f", mjd), F.lit("1"), F.lit("2.5"), k.cast("string"), F.lit("0"), v, F.lit("-1"), F.lit("9")))
    found = readers.mjd_table(spark, _text(table(spark, sf_dir, "orders"), line, "mjd", compression="gzip"), names)
    return found.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), _seconds("epoch").alias("second"), "v")


@query("select o_orderdate::date as date, case when count(*) % 4 = 0 then null else count(*) end::double as spots from orders group by all")
def semicolon_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily numbers between semicolons; negative ones stand for missing."""
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    number = F.when(F.col("n") % 4 == 0, F.lit(-1)).otherwise(F.col("n"))
    line = F.concat_ws(";", F.date_format("day", "yyyy"), F.date_format("day", "MM"), F.date_format("day", " dd"), F.lit("1995.001"), F.format_string("%4d", number), F.lit("-1.0"), F.lit("0"), F.lit("1"))
    return readers.daily_semicolon(spark, _text(days, line, "semicolons"), "spots")


@query("""with d as (select o_orderdate::date as day, count(*) as n, min(o_orderkey) as k from orders group by all), f as (select *, 30 + (k % 5000) / 10.0 as flux, n + 100.0 as f81, 120.5 as f365, k % 60 as ap from d)
 select day as date, flux::double as f107_daily, f81::double as f107_81, f365::double as f107_365, ap::double as ap_daily, case when flux between 40 and 500 then flux end::double as word_51 from f where flux between 40 and 500""")
def solar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two daily tables, one by date with its last three words, one by day of the year with word 51, joined by date."""
    k = F.col("k")
    d = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("k"))
    flux = F.format_string("%.1f", 30 + k % 5000 / 10.0)
    year = F.when(F.dayofmonth("day") % 2 == 0, F.date_format("day", "yy")).otherwise(F.date_format("day", "yyyy"))
    filler = F.array_join(F.array_repeat(F.lit("7"), 8), " ")
    daily = F.concat_ws(" ", year, F.month("day").cast("string"), F.dayofmonth("day").cast("string"), filler, (k % 60).cast("string"), F.lit("1"), flux, F.format_string("%.1f", F.col("n") + 100.0), F.lit("120.5"))
    average = F.concat_ws(" ", F.date_format("day", "yyyy"), F.dayofyear("day").cast("string"), F.array_join(F.array_repeat(F.lit("99"), 48), " "), flux)
    by_date = tables.solar_daily(spark, _text(d, daily, "solar"))
    return by_date.join(tables.solar_average(spark, _text(d, average, "average")).withColumnRenamed("f107", "word_51"), "date", "left")


@query("""select epoch_us(date_trunc('second', ts)) // 1000000 as second, (user_id % 170 - 85)::double as gdlat, (event_id % 360 - 180)::double as glon, round(value, 3) as tec, case when event_id % 4 = 0 then null else 0.5 end::double as dtec from events where event_id % 11 <> 0""")
def extract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ten columns from year to uncertainty; those without a value go, a missing uncertainty is null."""
    k = F.col("event_id")
    tec = F.when(k % 11 == 0, "missing").otherwise(F.format_string("%.6f", F.col("value")))
    line = F.concat_ws(" ", F.date_format("ts", "yyyy M d H m s'.0'"), (F.col("user_id") % 170 - 85).cast("string"), (k % 360 - 180).cast("string"), tec, F.when(k % 4 == 0, "missing").otherwise("0.5"))
    found = tables.text_extract(spark, _text(table(spark, sf_dir, "events"), line, "extract"))
    return found.select(_seconds("epoch").alias("second"), "gdlat", "glon", F.round("tec", 3).alias("tec"), "dtec")


@query("select s_name as site, (s_suppkey % 181 - 90)::double as lat, (s_suppkey % 360)::double as lon from supplier where s_suppkey % 6 <> 0")
def site_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of quoted sites with their places; lines with fewer than three tokens go."""
    k = F.col("s_suppkey")
    line = F.when(k % 6 == 0, F.concat(F.lit("# "), k.cast("string"))).otherwise(F.concat(F.lit("'"), F.col("s_name"), F.lit("', "), (k % 181 - 90).cast("string"), F.lit(", "), (k % 360).cast("string"), F.lit(" more")))
    return tables.sites(spark, _text(table(spark, sf_dir, "supplier"), line, "sites"))


@query("select 'R' || lpad((c_custkey % 24)::varchar, 2, '0') as sv, (c_custkey % 24) % 14 - 7 as channel from customer group by all")
def agreed_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of satellites as many headers state them, with gaps; all that state one agree."""
    k = F.col("c_custkey") % 24
    said = table(spark, sf_dir, "customer").select(F.concat(F.lit("R"), F.lpad(k.cast("string"), 2, "0")).alias("sv"), (k % 14 - 7).alias("channel"))
    silent = said.withColumn("channel", F.lit(None).cast("long"))
    return tables.agreed_channels(said.union(silent))


@query("""with e as (select event_id, event_type, user_id as sv, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 30000000 as epoch, value from events),
 k as (select sv, epoch, event_type, max(value) as value from e group by all), r as (select *, row_number() over (partition by sv, epoch order by case event_type when 'click' then 0 when 'view' then 1 else 2 end) as place from k where event_type in ('click', 'view', 'error'))
 select sv, epoch, round(value, 6) as value, case when event_type = 'view' then 1 end::double as flag from r where place = 1""")
def segments_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with unlike columns put together; of equal keys the first segment's row stays."""
    events = table(spark, sf_dir, "events").withColumn("epoch", F.floor(micros("ts") / 30_000_000))
    part = lambda kind: events.where(F.col("event_type") == kind).groupBy(F.col("user_id").alias("sv"), "epoch").agg(F.round(F.max("value"), 6).alias("value"))
    return tables.segments_of_day([part("click"), part("view").withColumn("flag", F.lit(1.0)), part("error")], ["sv", "epoch"]).select("sv", "epoch", "value", "flag")


_ORBIT_SQL = """with n as (select 'G' || lpad(n_nationkey::varchar, 2, '0') as sv, n_nationkey as k from nation), e as (select sv, k, unnest(range(0, 96)) as e from n), o as (select sv, e * 900 as second, e * 900 * 2 * pi() / 43080 + k as a, e, k from e where (e * 7 + k) % 13 <> 0)
 select sv, second::bigint as second, round(2.6e4 * cos(a), 6) as x_km, round(2.0e4 * sin(a), 6) as y_km, round(1.6e4 * sin(a), 6) as z_km from o where (e + k) % 5 <> 0"""


@query(_ORBIT_SQL)
def orbit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An orbit file of a day, positions in kilometres at fixed columns; those without coordinates hold the format's mark."""
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("G"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("sv"), F.col("n_nationkey").alias("k"))
    rows = nation.select("sv", "k", F.explode(F.sequence(F.lit(0), F.lit(95))).alias("e")).where("(e * 7 + k) % 13 <> 0")
    angle = F.col("e") * 900 * 2 * F.pi() / 43_080 + F.col("k")
    absent = (F.col("e") + F.col("k")) % 5 == 0
    places = [F.format_string("%14.6f", F.when(absent, F.lit(999_999.999999)).otherwise(v)) for v in (2.6e4 * F.cos(angle), 2.0e4 * F.sin(angle), 1.6e4 * F.sin(angle))]
    records = rows.withColumn("line", F.concat(F.lit("P"), "sv", *places)).groupBy("e").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))
    minutes = F.col("e") * 15
    head = F.format_string("*  2024  1  5 %2d %2d  0.00000000", F.floor(minutes / 60), minutes % 60)
    found = readers.orbits(spark, _text(records, F.concat(head, F.lit("\n"), F.col("lines")), "orbit"))
    second = F.timestamp_diff("SECOND", F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"), F.col("epoch"))
    return found.select("sv", second.alias("second"), *[F.round(F.col(f"{c}_m") / 1000, 6).alias(f"{c}_km") for c in "xyz"])


LAT, LON, HOURS = [80.0 - 20 * k for k in range(9)], [-180.0 + 30 * k for k in range(13)], [2 * k for k in range(13)]


@query("""with o as (select o_orderkey % 1521 as node, round(avg(o_totalprice) / 1000)::bigint as raw from orders group by all), g as (select node // 169 as i, node // 13 % 13 as j, node % 13 as k, raw / 10.0 as v from o),
 p as (select c_custkey, (c_custkey * 37) % 1601 / 10.0 - 80 as lat, (c_custkey * 53) % 3601 / 10.0 - 180 as lon, (c_custkey * 29) % 241 / 10.0 as t from customer),
 f as (select *, least(floor((lat + 80) / 20), 7)::bigint as la, least(floor((lon + 180) / 30), 11)::bigint as lo, least(floor(t / 2), 11)::bigint as ta from p),
 s as (select *, (lat + 80) / 20 - la as fa, (lon + 180) / 30 - lo as fo, t / 2 - ta as ft from f),
 w as (select c_custkey, ft, c, (case when a = 1 then fa else 1 - fa end) * (case when b = 1 then fo else 1 - fo end) as w, v from s, (select unnest([0, 1]) as a), (select unnest([0, 1]) as b), (select unnest([0, 1]) as c) left join g on 8 - g.i = la + a and g.j = lo + b and g.k = ta + c),
 m as (select c_custkey, any_value(ft) as f, sum(w * v) filter (where c = 0) / nullif(sum(w) filter (where c = 0 and v is not null), 0) as v0, sum(w * v) filter (where c = 1) / nullif(sum(w) filter (where c = 1 and v is not null), 0) as v1 from w group by all)
 select c_custkey, round(coalesce((1 - f) * v0 + f * v1, v0, v1), 8) as value from m""")
def grid_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean prices on the nodes of a globe, written as a file of thirteen maps, read back, and interpolated in place and time."""
    nodes = spark.range(9 * 169).withColumnRenamed("id", "node").join(
        table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 1521).alias("node")).agg(F.round(F.avg("o_totalprice") / 1000).cast("int").alias("raw")), "node", "left")
    i, j, k = F.floor(F.col("node") / 169), F.floor(F.col("node") / 13) % 13, F.col("node") % 13
    label = lambda text, name: F.concat(F.rpad(text, 60, " "), F.rpad(F.lit(name), 20, " "))
    values = F.transform(F.array_sort(F.collect_list(F.struct("j", "raw"))), lambda x: F.format_string("%5d", F.coalesce(x["raw"], F.lit(9999))))
    bands = nodes.select(i.alias("i"), j.alias("j"), k.alias("k"), "raw").groupBy("k", "i").agg(values.alias("v"))
    band = F.concat(label(F.format_string("  %6.1f-180.0 180.0  30.0 450.0", 80.0 - 20 * F.col("i")), "LAT/LON1/LON2/DLON/H"), F.lit("\n"), F.array_join(F.slice("v", 1, 8), ""), F.lit("\n"), F.array_join(F.slice("v", 9, 8), ""))
    maps = bands.withColumn("text", band).groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "\n").alias("bands"))
    at = F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(5), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(hours=(2 * F.col("k")).cast("int"))
    text = F.concat_ws("\n", label(F.lit("    -1"), "EXPONENT"), label(F.lit(""), "END OF HEADER"), label(F.lit("     1"), "START OF TEC MAP"),
                       label(F.date_format(at, "  yyyy     M     d     H     m     s"), "EPOCH OF CURRENT MAP"), F.col("bands"), label(F.lit("     1"), "END OF TEC MAP"))
    path = f"{new_folder(spark, 'grids')}/maps"
    maps.select("k", text.alias("value")).repartition("k").write.partitionBy("k").text(path)
    read = readers.grid_maps(spark, path)
    hours = F.timestamp_diff("HOUR", F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"), F.col("map_epoch"))
    cells = read.select(F.round((F.col("lat") + 80) / 20).cast("long").alias("i"), F.round((F.col("lon") + 180) / 30).cast("long").alias("j"), F.floor(hours / 2).alias("k"), F.col("value").alias("node_value"))
    c = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(
        "c_custkey", ((c * 37) % 1601 / 10.0 - 80).cast("double").alias("lat"), ((c * 53) % 3601 / 10.0 - 180).cast("double").alias("lon"), ((c * 29) % 241 / 10.0).cast("double").alias("t"))
    return rounded(align.grid_interpolate_finite(points, cells, "c_custkey", LAT[::-1], LON, [float(h) for h in HOURS]), 8)
