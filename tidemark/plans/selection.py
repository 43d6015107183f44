"""Queries of filters, classifications, checked joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import align, paired, segments
from tidemark.operators import selection as sel

from .registry import micros, query, rounded, table


@query("""with p as (select l_returnflag, case when l_linenumber = 1 then 'nan'::double when l_linenumber = 2 then 'inf'::double when l_linenumber = 3 then null else l_extendedprice / l_quantity end as m, p_retailprice as r
 from lineitem join part on l_partkey = p_partkey), f as (select l_returnflag, m - r as res from p where isfinite(m) and isfinite(r))
 select l_returnflag, count(*) as n, round(avg(res), 6) as bias, round(sqrt(avg(res * res)), 6) as rmse from f group by all""")
def finite_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("m"))
    k = F.col("l_linenumber")
    line = line.withColumn("m", F.when(k == 1, float("nan")).when(k == 2, float("inf")).when(k != 3, F.col("m")))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("r"))
    return rounded(paired.paired_stats(line.join(part, "l_partkey"), ["l_returnflag"], "m", "r").select("l_returnflag", "n", "bias", "rmse"))


@query("""with e as (select c_custkey, c_mktsegment, (c_custkey * 37) % 181 - 90.0 as ele from customer)
 select c_mktsegment, count(*) filter (where ele >= 30) as signed_rows, count(*) filter (where abs(ele) >= 30) as size_rows from e group by all""")
def elevation_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", ((F.col("c_custkey") * 37) % 181 - 90.0).alias("ele"))
    one = sel.elevation_mask(rows, "ele").groupBy("c_mktsegment").agg(F.count("*").alias("signed_rows"))
    two = sel.elevation_mask(rows, "ele", signed=False).groupBy("c_mktsegment").agg(F.count("*").alias("size_rows"))
    return two.join(one, "c_mktsegment", "left").select("c_mktsegment", F.coalesce("signed_rows", F.lit(0).cast("long")).alias("signed_rows"), "size_rows")


@query("""with b(which, first, last) as (values ('day', timestamp '1997-03-01', timestamp '1997-03-01'), ('month', timestamp '1997-03-01', timestamp '1997-03-31'))
 select which, count(*) filter (where o_orderdate < last + interval 1 day) as half_open, count(*) as inclusive, round(sum(o_totalprice), 2) as price
 from b join orders on o_orderdate >= first and o_orderdate <= last + interval 1 day group by all""")
def day_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice")
    first = F.lit("1997-03-01").cast("timestamp_ntz")

    def one(which: str, last: str) -> DataFrame:
        end = F.lit(last).cast("timestamp_ntz")
        ts = F.col("o_orderdate")
        kept = orders.where(sel.in_days_inclusive(ts, first, end))
        half = sel.in_day(ts, first) if which == "day" else (ts >= first) & (ts < end + F.expr("interval 1 day"))
        return kept.agg(F.lit(which).alias("which"), F.count_if(half).alias("half_open"), F.count("*").alias("inclusive"), F.round(F.sum("o_totalprice"), 2).alias("price"))

    return one("day", "1997-03-01").union(one("month", "1997-03-31")).where("inclusive > 0")


_PLACES = """p as (select c_custkey, c_acctbal, (c_custkey * 37) % 801 / 10.0 - 40 as lat, (c_custkey * 53) % 1201 / 10.0 - 60 as lon from customer)"""


def _places(spark: SparkSession, sf_dir: str, a: int = 37, b: int = 53) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", ((k * a) % 801 / 10.0 - 40).alias("lat"), ((k * b) % 1201 / 10.0 - 60).alias("lon"))


@query(f"""with {_PLACES}, b as (select greatest(-90, least(90, min(lat) - 2)) as a, greatest(-90, least(90, max(lat) + 2)) as b, greatest(-180, least(180, min(lon) - 2)) as c, greatest(-180, least(180, max(lon) + 2)) as d from p where c_acctbal > 9900)
 select 'footprint' as box, count(*) as n, round(avg(c_acctbal), 6) as mean from p, b where lat between a and b and lon between c and d
 union all select 'fallback', count(*), round(avg(c_acctbal), 6) from p where lat between -20 and -10 and lon between 5 and 25
 union all select 'station', count(*), round(avg(c_acctbal), 6) from p where lat between -35 and -25 and lon between -10 and 10""")
def region_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _places(spark, sf_dir)
    fallback = (-20.0, -10.0, 5.0, 25.0)
    summary = lambda df, name: df.agg(F.lit(name).alias("box"), F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean"))
    by_data = sel.within(points, sel.footprint_box(points.where("c_acctbal > 9900"), 2.0, fallback))
    by_fallback = sel.within(points, sel.footprint_box(points.where("false"), 2.0, fallback))
    station = points.where(sel.in_box(F.col("lat"), F.col("lon"), (-30.0, 0.0)))
    return summary(by_data, "footprint").union(summary(by_fallback, "fallback")).union(summary(station, "station"))


_ACTIVITY = """a as (select c_custkey, c_acctbal, case when c_custkey % 11 = 0 then null else (c_custkey * 7) % 90 / 10.0 end as kp, case when c_custkey % 13 = 0 then null else 20.0 - (c_custkey * 17) % 120 end as dst,
 case when c_custkey % 17 = 0 then null else 30.0 - (c_custkey * 29) % 130 end as symh from customer),
 k as (select *, case when kp is null or dst is null or symh is null then 'unknown' when kp >= 5 or dst <= -50 or symh <= -50 then 'storm' when kp < 4 and dst > -30 and symh > -30 then 'quiet' else 'active_nonstorm' end as class from a)"""


@query(f"with {_ACTIVITY} select class, count(*) as n, round(avg(kp), 6) as kp, round(min(dst), 6) as dst, round(min(symh), 6) as symh from k group by all")
def activity_three_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.when(c % 11 != 0, (c * 7) % 90 / 10.0).alias("kp"), F.when(c % 13 != 0, 20.0 - (c * 17) % 120).alias("dst"), F.when(c % 17 != 0, 30.0 - (c * 29) % 130).alias("symh"))
    marked = rows.withColumn("class", sel.activity_class(F.col("kp"), F.col("dst"), F.col("symh")))
    return rounded(marked.groupBy("class").agg(F.count("*").alias("n"), F.avg("kp").alias("kp"), F.min("dst").alias("dst"), F.min("symh").alias("symh")))


@query("""select l_returnflag, count(*) as n, count(*) filter (where l_quantity > 5 and l_discount = 0 and l_tax <= 0.04 and l_linenumber <> 7) as n_ok from lineitem group by all""")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = sel.quality_flag(F.col("l_quantity") > 5, F.col("l_discount") == 0, F.col("l_tax") <= 0.04, F.col("l_linenumber") != 7)
    return table(spark, sf_dir, "lineitem").withColumn("ok", ok).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))


@query("""with s as (select substr('GRECJ', (c_custkey % 5 + 1)::int, 1) || lpad((c_custkey % 32)::varchar, 2, '0') as sv, c_acctbal from customer)
 select substr(sv, 1, 1) as system, count(*) as n, count(distinct sv) as n_sv from s where substr(sv, 1, 1) in ('G', 'R', 'E') group by all""")
def constellations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    sv = F.concat(F.substring(F.lit("GRECJ"), (k % 5 + 1).cast("int"), F.lit(1)), F.lpad((k % 32).cast("string"), 2, "0"))
    rows = table(spark, sf_dir, "customer").select(sv.alias("sv")).withColumn("system", sel.constellation(F.col("sv")))
    return rows.where("system is not null").groupBy("system").agg(F.count("*").alias("n"), F.count_distinct("sv").alias("n_sv"))


@query("""select case when p_name = 'red widget' then 'Red' when lower(p_name) like '%ring%' then 'Ring' when lower(p_name) like '%widget%' then 'Widget' else 'Other' end as shown, count(*) as n from part group by all""")
def mapped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = sel.mapped_name(F.col("p_name"), {"red widget": "Red"}, {"RING": "Ring", "widget": "Widget"}, "Other")
    return table(spark, sf_dir, "part").groupBy(shown.alias("shown")).agg(F.count("*").alias("n"))


@query("""select l_returnflag, round(avg(l_extendedprice / l_quantity - p_retailprice), 6) as core_vs_list_bias, round(sqrt(avg((l_extendedprice / l_quantity - p_retailprice) * (l_extendedprice / l_quantity - p_retailprice))), 6) as core_vs_list_rmse
 from lineitem join part on l_partkey = p_partkey group by all""")
def widened_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics renamed with the pair's prefix; then the columns of wanted suffixes that name the pair."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag", (F.col("l_extendedprice") / F.col("l_quantity")).alias("m"))
    joined = line.join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_partkey")
    wide = sel.prefixed(paired.paired_stats(joined, ["l_returnflag"], "m", "p_retailprice"), "core_vs_list_", ["l_returnflag"])
    return rounded(wide.select("l_returnflag", *sel.columns_like(wide, ("_bias", "_rmse"), ("vs_list", "vs_bins"))))


@query("""select s_suppkey, s_acctbal, n_name, r_name from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""")
def checked_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    region = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    found = sel.checked_many_to_one(table(spark, sf_dir, "supplier"), nation, ["s_nationkey"])
    return sel.checked_many_to_one(found, region, ["n_regionkey"]).select("s_suppkey", "s_acctbal", "n_name", "r_name")


@query("""with a as (select user_id, event_type, ts::date as day, avg(value) as a, count(*) as n from events where value > 60 group by all), b as (select user_id, event_type, ts::date as day, avg(value) as b, count(*) + 100 as n from events where value < 40 group by all)
 select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.event_type, b.event_type) as event_type, coalesce(a.day, b.day) as day, round(a.a, 6) as a, round(b.b, 6) as b, coalesce(a.n, b.n) as n
 from a full outer join b on a.user_id = b.user_id and a.event_type = b.event_type and a.day = b.day""")
def outer_join_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["user_id", "event_type", "day"]
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    one = events.where("value > 60").groupBy(*keys).agg(F.avg("value").alias("a"), F.count("*").alias("na"))
    two = events.where("value < 40").groupBy(*keys).agg(F.avg("value").alias("b"), (F.count("*") + 100).alias("nb"))
    return rounded(one.join(two, keys, "full_outer").select(*keys, "a", "b", F.coalesce("na", "nb").alias("n")))


@query("""with s as (select user_id, date_trunc('hour', ts) as epoch, avg(value) as x from events where event_type = 'view' group by all), o as (select user_id, date_trunc('hour', ts) as epoch, count(*) as n from events where event_type = 'click' group by all)
 select o.user_id, epoch_us(o.epoch) // 1000000 as t, o.n, round(s.x, 6) as x from o left join s on o.user_id = s.user_id and o.epoch = s.epoch""")
def coordinates_by_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = table(spark, sf_dir, "events").withColumn("epoch", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    own = hour.where("event_type = 'click'").groupBy("user_id", "epoch").agg(F.count("*").alias("n"))
    there = hour.where("event_type = 'view'").groupBy("user_id", "epoch").agg(F.avg("value").alias("x"))
    t = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("epoch"))
    return sel.checked_many_to_one(own, there, ["user_id", "epoch"]).select("user_id", t.alias("t"), "n", F.round("x", 6).alias("x"))


@query("""select c_custkey, round(c_acctbal - (select avg(c_acctbal) from customer), 6) as away, -62.64 as station_lat, c_nationkey * c.k as scaled from customer join (values ('AUTOMOBILE', 2), ('BUILDING', 3), ('FURNITURE', 5), ('HOUSEHOLD', 7), ('MACHINERY', 11)) c(seg, k) on seg = c_mktsegment""")
def constants_and_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar on all rows by a broadcast of one row, a constant, and a dictionary as a small joined table."""
    customers = table(spark, sf_dir, "customer")
    mean = customers.agg(F.avg("c_acctbal").alias("mean"))
    terms = spark.createDataFrame([("AUTOMOBILE", 2), ("BUILDING", 3), ("FURNITURE", 5), ("HOUSEHOLD", 7), ("MACHINERY", 11)], "c_mktsegment string, k int")
    joined = customers.join(F.broadcast(mean)).join(F.broadcast(terms), "c_mktsegment")
    return joined.select("c_custkey", F.round(F.col("c_acctbal") - F.col("mean"), 6).alias("away"), F.lit(-62.64).cast("decimal(4,2)").alias("station_lat"), (F.col("c_nationkey") * F.col("k")).alias("scaled"))


@query("""with a as (select distinct o_orderdate::date as day from orders where o_orderpriority = '1-URGENT'), b as (select distinct l_shipdate::date as day from lineitem where l_quantity > 49)
 select 'union' as op, count(*) as n, min(day) as first, max(day) as last from (select * from a union select * from b) union all
 select 'except', count(*), min(day), max(day) from (select * from a except select * from b) union all select 'both', count(*), min(day), max(day) from (select * from a intersect select * from b)""")
def day_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("day"))
    b = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.to_date("l_shipdate").alias("day"))
    sides = {"union": sel.day_union(a, b), "except": a.distinct().join(b, "day", "left_anti"), "both": a.distinct().join(b, "day", "left_semi")}
    rows = [df.agg(F.lit(op).alias("op"), F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last")) for op, df in sides.items()]
    return rows[0].union(rows[1]).union(rows[2])


@query("""with h as (select user_id from events where event_type in ('view', 'click', 'error') and value > 90 group by user_id having count(distinct event_type) = 3)
 select user_id, count(*) as n, count(distinct ts::date) as n_days from events where user_id in (from h) and ts::date in (date '2024-01-05', date '2024-01-09') group by all""")
def subset_and_selected_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    whole = sel.holds_all(events.where("value > 90"), "user_id", "event_type", ["view", "click", "error"])
    chosen = events.where(F.col("day").isin(*[F.lit(d).cast("date") for d in ("2024-01-05", "2024-01-09")]))
    return chosen.join(whole, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("day").alias("n_days"))


@query("select o_orderdate::date as day, count(*) as n, round(avg(o_totalprice), 4) as mean from orders where o_orderdate::date = (select max(o_orderdate)::date from orders) group by all")
def single_day_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    last = daily.agg(F.max("day").alias("last"))
    return sel.the_row(daily.join(F.broadcast(last)), F.col("day") == F.col("last")).drop("last")


@query("""select user_id, arg_max(event_id, row(value, -event_id)) as most_at, round(max(value), 6) as most, arg_min(event_id, row(value, event_id)) as least_at, round(min(value), 6) as least from events group by all""")
def arg_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = F.col("value"), F.col("event_id")
    return rounded(table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max_by("event_id", F.struct(v, -e)).alias("most_at"), F.max(v).alias("most"), F.min_by("event_id", F.struct(v, e)).alias("least_at"), F.min(v).alias("least")))


@query("select (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 3600000000 as hour, count(*) as n, round(median(value), 6) as station_value from events group by all")
def station_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = table(spark, sf_dir, "events").groupBy(F.floor(micros("ts") / 3_600_000_000).alias("hour"))
    return rounded(hours.agg(F.count("*").alias("n"), F.percentile("value", 0.5).alias("station_value")))


@query("""with s as (select unnest(generate_series(least(timestamp '2024-01-01', min(ts)::date::timestamp), greatest(timestamp '2024-02-05', max(ts)), interval 1 day))::date as day from events), r(event_type) as (values ('view'), ('error')),
 e as (select ts::date as day, event_type, count(*) as n, count(*) filter (where value > 100) as n_ok from events where event_type in ('view', 'error') group by all)
 select s.day, r.event_type, coalesce(n, 0) as n, coalesce(n_ok, 0) as n_ok, n is not null as has_rows, case when coalesce(n_ok, 0) >= 5 then 'OK' else 'FAILED' end as status
 from s cross join r left join e on e.day = s.day and e.event_type = r.event_type""")
def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each day of the spine and each reference, with counts, flags and a status.

    The spine is the period asked for, wider where there are events outside it, so that days without any count as failed.
    """
    ends = [f(F.lit(day).cast("date"), F.to_date(g("ts"))).alias(n) for n, f, g, day in (("a", F.least, F.min, "2024-01-01"), ("b", F.greatest, F.max, "2024-02-05"))]
    days = table(spark, sf_dir, "events").agg(*ends).select(F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("day"))
    spine = days.select("day", F.explode(F.array(F.lit("view"), F.lit("error"))).alias("event_type"))
    counts = table(spark, sf_dir, "events").where("event_type in ('view', 'error')").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 100).alias("n_ok"))
    zero = F.lit(0).cast("long")
    found = spine.join(counts, ["day", "event_type"], "left").withColumn("has_rows", F.col("n").isNotNull())
    found = found.withColumn("n", F.coalesce("n", zero)).withColumn("n_ok", F.coalesce("n_ok", zero))
    return found.withColumn("status", F.when(F.col("n_ok") >= 5, "OK").otherwise("FAILED"))


@query("""select event_type, event_id from (select event_type, event_id, row_number() over (partition by event_type order by md5(event_id::varchar || '/42'), event_id) as k from events) where k <= 50 order by event_type, event_id""")
def sampled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.md5(F.concat(F.col("event_id").cast("string"), F.lit("/42"))), F.col("event_id")]
    return sel.down_sample(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], 50, order).orderBy("event_type", "event_id")


@query("""select user_id, minute, event_type, event_id from (select user_id, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 3600000000 as minute, event_type, event_id,
 row_number() over (partition by user_id, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 3600000000 order by event_type, event_id) as k from events) where k = 1""")
def stable_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.floor(micros("ts") / 3_600_000_000).alias("minute"), "event_type", "event_id")
    return sel.stable_first(rows, ["user_id"], "minute", "event_type", "event_id")


@query(f"""with {_PLACES}, c as (select s_suppkey, s_nationkey % 3 as epoch, (s_suppkey * 61) % 801 / 10.0 - 40 as clat, (s_suppkey * 97) % 1201 / 10.0 - 60 as clon from supplier),
 d as (select c_custkey, s_suppkey, clat, clon, pow(111.32 * (clat - lat), 2) + pow(111.32 * cos(radians((clat + lat) / 2)) * (((clon - lon + 180) % 360 + 360) % 360 - 180), 2) as d2 from p join c on c_custkey % 3 = epoch)
 select c_custkey, s_suppkey, round(sqrt(d2), 6) as km from (select *, row_number() over (partition by c_custkey order by d2, clat, clon, s_suppkey) as k from d) where k = 1 and sqrt(d2) <= 400""")
def nearest_cell_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _places(spark, sf_dir).withColumn("epoch", (F.col("c_custkey") % 3).cast("int"))
    k = F.col("s_suppkey")
    cells = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 3).alias("epoch"), ((k * 61) % 801 / 10.0 - 40).alias("lat"), ((k * 97) % 1201 / 10.0 - 60).alias("lon"))
    return rounded(align.nearest_cell_flat(points, cells, "c_custkey", "s_suppkey", 400.0, ["epoch"]))


@query("""with x as (select o_orderkey, o_orderdate::date as start_day, o_orderdate + interval (o_orderkey % 48) hour as begins, o_orderdate + interval (o_orderkey % 48 + o_orderkey % 30) hour as ends, o_custkey % 50 as grp from orders where o_orderdate >= timestamp '1998-01-01'),
 w as (select *, timestamp '1998-06-10' as day from x), r as (select grp, o_orderkey, begins::date = day::date as same_day, begins <= day + interval 12 hour and ends > day + interval 12 hour as midday,
 greatest(0, epoch_us(least(ends, day + interval 1 day)) - epoch_us(greatest(begins, day))) // 1000000 as overlap, begins from w)
 select grp, o_orderkey, overlap from (select *, row_number() over (partition by grp order by same_day desc, midday desc, overlap desc, begins desc, o_orderkey desc) as k from r) where k = 1""")
def experiment_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each group the candidate that starts on the day, holds midday, overlaps most and begins last, in this order."""
    day = F.lit("1998-06-10 00:00:00").cast("timestamp_ntz")
    later = lambda h: F.timestamp_add("HOUR", h, F.col("o_orderdate"))
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz '1998-01-01 00:00:00'").select(
        "o_orderkey", (F.col("o_custkey") % 50).alias("grp"), later(k % 48).alias("begins"), later(k % 48 + k % 30).alias("ends"))
    noon, end = day + F.expr("interval 12 hours"), day + F.expr("interval 1 day")
    overlap = F.greatest(F.lit(0).cast("long"), F.timestamp_diff("SECOND", F.greatest("begins", day), F.least("ends", end)))
    order = F.struct((F.to_date("begins") == F.to_date(day)).alias("s"), ((F.col("begins") <= noon) & (F.col("ends") > noon)).alias("m"), "overlap", "begins", "o_orderkey")
    best = rows.withColumn("overlap", overlap).groupBy("grp").agg(F.max(order).alias("b"))
    return best.select("grp", "b.o_orderkey", "b.overlap")


@query("""select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by (o_orderstatus = 'P') desc, (lower(o_orderpriority) like '%urgent%') desc, o_orderkey) as k from orders) where k = 1""")
def file_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category first, then final status, then the first in order."""
    order = [F.desc(F.col("o_orderstatus") == "P"), F.desc(F.lower("o_orderpriority").contains("urgent")), F.col("o_orderkey")]
    return segments.keep_one(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_custkey"], order).select("o_custkey", "o_orderkey")


@query("""select n_regionkey, n_nationkey, n_name from nation where n_nationkey not in (select s_nationkey from supplier where s_acctbal > 5000) order by n_regionkey desc, n_nationkey""")
def missing_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "nation").join(rich, "n_nationkey", "left_anti").select("n_regionkey", "n_nationkey", "n_name").orderBy(F.desc("n_regionkey"), "n_nationkey")


@query("""select l_orderkey, count(distinct l_returnflag) as tokens, count(*) as n from lineitem group by l_orderkey having count(distinct l_returnflag) = 1""")
def unambiguous_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of hourly files whose names have one sampling token; others are left out."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_returnflag").alias("tokens"), F.count("*").alias("n")).where("tokens = 1")


@query("""select event_type, event_id from events where ((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 1000000) % 30 = 0""")
def decimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.floor(micros("ts") / 1_000_000)
    return table(spark, sf_dir, "events").where(F.pmod(second, F.lit(30)) == 0).select("event_type", "event_id")


@query("""select s_suppkey, count(*) over (partition by s_nationkey) as of_nation, ntile(4) over (order by s_acctbal, s_suppkey) as quarter, lead(s_suppkey) over (partition by s_nationkey order by s_acctbal, s_suppkey) as next from supplier""")
def ranking_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, order = Window.partitionBy("s_nationkey"), ["s_acctbal", "s_suppkey"]
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.count("*").over(nation).alias("of_nation"), F.ntile(4).over(Window.orderBy(*order)).cast("long").alias("quarter"), F.lead("s_suppkey").over(nation.orderBy(*order)).alias("next"))
