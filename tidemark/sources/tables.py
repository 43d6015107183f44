"""Readers of tables with column contracts, and discovery of files by name.

Columns are read as text and cast without failing, so a bad cell is null and a missing column an
error. Files are found through Spark's file listing, so any store that Spark reads will do.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .readers import day_of_year, double, words

EPOCH_0 = "1970-01-01 00:00:00"


def required(df: DataFrame, columns: list[str], what: str = "table") -> DataFrame:
    """``df`` if it has all the columns, else an error that names those missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    return df


def coerced(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Columns cast to their types; what cannot be cast, and NaN, is null."""
    out = []
    for c in df.columns:
        value = F.col(c).try_cast(types[c]) if c in types else F.col(c)
        out.append((F.when(~F.isnan(value), value) if types.get(c) in ("double", "float") else value).alias(c))
    return df.select(*out)


def csv_table(spark: SparkSession, path: str | list[str], types: Mapping[str, str], optional: tuple[str, ...] = ()) -> DataFrame:
    """The named columns of CSV files with a header; optional ones that lack are null."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    df = required(raw, [c for c in types if c not in optional], str(path))
    for c in optional:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return coerced(df.select(*types), types)


def csv_subset(spark: SparkSession, path: str | list[str], wanted: Callable[[str], bool], types: Mapping[str, str]) -> DataFrame:
    """The columns of CSV files whose names are wanted; only these are parsed."""
    raw = spark.read.option("header", True).csv(path)
    return coerced(raw.select(*[c for c in raw.columns if wanted(c)]), types)


def as_utc(value: Column, kind: str) -> Column:
    """A time without zone in UTC of a timestamp, text or count of seconds, ms, us or ns since 1970."""
    per = {"s": 1_000_000, "ms": 1_000, "us": 1}
    zero = F.lit(EPOCH_0).cast("timestamp_ntz")
    if kind == "ns":
        return F.timestamp_add("MICROSECOND", F.floor(value / 1_000), zero)
    if kind in per:
        return F.timestamp_add("MICROSECOND", F.round(value * per[kind]).cast("long"), zero)
    return F.to_utc_timestamp(value, F.current_timezone()).cast("timestamp_ntz") if kind == "timestamp" else F.expr("try_cast(null as timestamp_ntz)") if kind == "null" else value.try_cast("timestamp_ntz")


TEC = ("epoch", "sv", "lat_ipp", "lon_ipp", "ele", "vtec", "veq")


def tec_table(spark: SparkSession, path: str | list[str], epoch_kind: str = "text", columns: tuple[str, ...] = TEC) -> DataFrame:
    """The seven columns of a Parquet table of methods: epoch in UTC, numbers as doubles; other columns are not read."""
    df = required(spark.read.parquet(*([path] if isinstance(path, str) else path)), list(columns), str(path)).select(*columns)
    numbers = {c: "double" for c in columns if c not in ("epoch", "sv")}
    kind = dict(df.dtypes)["epoch"]
    epoch = F.col("epoch") if kind == "timestamp_ntz" else as_utc(F.col("epoch"), "timestamp" if kind == "timestamp" else epoch_kind)
    return coerced(df, numbers).withColumn("epoch", epoch)


def sparse_bins(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(epoch, gdlat, glon, tec, dtec)`` of Parquet bins; without an uncertainty it is null."""
    df = required(spark.read.parquet(*([path] if isinstance(path, str) else path)), ["epoch", "gdlat", "glon", "tec"], str(path))
    if "dtec" not in df.columns:
        df = df.withColumn("dtec", F.lit(None).cast("double"))
    return coerced(df.select("epoch", "gdlat", "glon", "tec", "dtec"), dict.fromkeys(("gdlat", "glon", "tec", "dtec"), "double"))


def resolved(df: DataFrame, fields: Mapping[str, tuple[str, ...]], optional: tuple[str, ...] = ()) -> DataFrame:
    """Columns under our names, each by the first of its alternatives that is there in any case."""
    there = {c.lower(): c for c in df.columns}
    out = []
    for name, candidates in fields.items():
        found = next((there[c.lower()] for c in candidates if c.lower() in there), None)
        if found is None and name not in optional:
            raise ValueError(f"no column for {name}: {', '.join(candidates)}")
        out.append(F.col(f"`{found}`").alias(name) if found else F.lit(None).cast("double").alias(name))
    return df.select(*out)


def region_day(df: DataFrame, day: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows of one UTC day inside (lat low, lat high, lon low, lon high); the filter reaches a Parquet scan."""
    first = F.lit(day).cast("timestamp_ntz")
    return df.where((F.col("epoch") >= first) & (F.col("epoch") < first + F.expr("interval 1 day")) & F.col("gdlat").between(box[0], box[1]) & F.col("glon").between(box[2], box[3]))


def text_extract(spark: SparkSession, path: str | list[str], day: str | None = None) -> DataFrame:
    """``(epoch, gdlat, glon, tec, dtec)`` of text lines with ten columns from year to uncertainty; seconds may have a fraction."""
    w = spark.read.text(path).select(words(F.col("value")).alias("w")).where(F.size("w") >= 9)
    n = lambda k: double(F.get("w", F.lit(k)))
    date = F.concat_ws("-", *(F.lpad(n(k).cast("int").cast("string"), width, "0") for k, width in ((0, 4), (1, 2), (2, 2))))
    micros = F.round(((n(3) * 60 + n(4)) * 60 + n(5)) * 1_000_000).cast("long")
    epoch = F.timestamp_add("MICROSECOND", micros, date.try_cast("date").cast("timestamp_ntz"))
    rows = w.select(epoch.alias("epoch"), *[n(k).alias(c) for k, c in enumerate(("gdlat", "glon", "tec", "dtec"), 6)]).where("epoch is not null and gdlat is not null and glon is not null and tec is not null")
    return rows if day is None else rows.where(F.to_date("epoch") == F.lit(day).cast("date"))


def sites(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(site, lat, lon)`` of lines with three tokens or more, without their quotes."""
    w = spark.read.text(path).select(F.transform(words(F.col("value")), lambda x: F.regexp_replace(x, "^['\"]+|['\",]+$", "")).alias("w")).where(F.size("w") >= 3)
    return w.select(F.get("w", F.lit(0)).alias("site"), double(F.get("w", F.lit(1))).alias("lat"), double(F.get("w", F.lit(2))).alias("lon")).where("lat is not null and lon is not null")


def full_year(year: Column) -> Column:
    """Years of two digits (to 50: this century), of three (since 1900) and of four."""
    return F.when(year >= 1900, year).when(year >= 100, year + 1900).when(year <= 50, year + 2000).otherwise(year + 1900)


def solar_daily(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(date, f107_daily, f107_81, f107_365, ap_daily)``: the last three words and the twelfth; fluxes from 40 to 500; a date's last line."""
    lines = _numbered(spark, path).withColumn("w", words(F.col("line"))).where(F.size("w") >= 16)
    whole = lambda k: F.get("w", F.lit(k)).try_cast("int")
    date = F.try_make_date(full_year(whole(0)), whole(1), whole(2)) if hasattr(F, "try_make_date") else F.concat_ws("-", F.lpad(full_year(whole(0)).cast("string"), 4, "0"), F.lpad(whole(1).cast("string"), 2, "0"), F.lpad(whole(2).cast("string"), 2, "0")).try_cast("date")
    last = lambda k: double(F.element_at("w", -k))
    rows = lines.select("place", date.alias("date"), last(3).alias("f107_daily"), last(2).alias("f107_81"), last(1).alias("f107_365"), double(F.get("w", F.lit(11))).alias("ap_daily"))
    good = rows.dropna().where(F.col("f107_daily").between(40.0, 500.0))
    return _last(good, "date")


def solar_average(spark: SparkSession, path: str | list[str], word: int = 51) -> DataFrame:
    """``(date, f107)`` by year and day of the year in the first two words; fluxes from 40 to 500; a date's last line."""
    lines = _numbered(spark, path).withColumn("w", words(F.col("line")))
    n = lambda k: double(F.get("w", F.lit(k)))
    rows = lines.select("place", n(0).alias("y"), n(1).alias("d"), n(word - 1).alias("f107")).dropna().where("y between 1900 and 2200 and d between 1 and 366")
    return _last(rows.where(F.col("f107").between(40.0, 500.0)).select("place", day_of_year(F.col("y"), F.col("d")).alias("date"), "f107"), "date")


def _numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their place: file, then line number of the file, as the files are read whole."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    return files.select(F.struct("file", "pos").alias("place"), "line")


def _last(rows: DataFrame, key: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in (key, "place")]
    found = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "place").alias("r"))
    return found.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def agreed_channels(records: DataFrame, sv: str = "sv", channel: str = "channel") -> DataFrame:
    """``(sv, channel)`` of all headers; a satellite with two channels is an error."""
    found = records.where(F.col(channel).isNotNull()).groupBy(sv).agg(F.min(channel).alias(channel), F.count_distinct(channel).alias("_n"))
    return found.where(F.assert_true(F.col("_n") == 1, F.concat(F.lit("conflicting channels of "), F.col(sv))).isNull()).drop("_n")


# --- files by name --------------------------------------------------------------------------------


def files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """``(path, name, size)`` of a folder's files; their contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))


def days_of_files(found: DataFrame, year: int | None = None) -> DataFrame:
    """``(year, doy, path)`` by ``_ddd_yyyy_`` in the name; other years go, and of a day's files the last name stays."""
    named = found.withColumn("doy", F.regexp_extract("name", r"_(\d{3})_(\d{4})_", 1).try_cast("int")).withColumn("year", F.regexp_extract("name", r"_(\d{3})_(\d{4})_", 2).try_cast("int"))
    good = named.where("doy between 1 and 366" + (f" and year = {year}" if year else ""))
    return good.groupBy("year", "doy").agg(F.max_by("path", F.struct("name", "path")).alias("path"))


PRIORITY = ("_01D_30S_MO", "_30S_MO", "_01D_15S_MO")


def preferred_files(found: DataFrame, keys: list[str], tokens: tuple[str, ...] = PRIORITY) -> DataFrame:
    """Of each key the file with the first token that any has, by name among equals; files without a token go."""
    rank = F.coalesce(*[F.when(F.col("name").contains(t), k) for k, t in enumerate(tokens)])
    return found.withColumn("_rank", rank).where("_rank is not null").withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_rank", "name"))).where("_k = 1").drop("_rank", "_k")


def segments_of_day(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """All segments with whatever columns they have, the first segment's row of equal keys, in order of the keys."""
    out = None
    for k, part in enumerate(parts):
        marked = part.withColumn("_part", F.lit(k))
        out = marked if out is None else out.unionByName(marked, allowMissingColumns=True)
    first = out.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_part"))).where("_k = 1").drop("_k", "_part")
    return first.orderBy(*keys)


def locate(spark: SparkSession, folder: str, exact: list[str], pattern: str) -> str:
    """Path of the first exact name that is there, else of the first match of the pattern, else of one further down."""
    names = re.compile("|".join(map(re.escape, exact)) or r"(?!)")
    for recursive in (False, True):
        for glob in ([*exact] if not recursive else []) + [pattern]:
            row = files(spark, folder, glob, recursive).agg(F.min("path").alias("p")).first()
            if row.p and (glob == pattern or names.fullmatch(row.p.rpartition("/")[2])):
                return row.p
    raise FileNotFoundError(f"{pattern} in {folder}")


def unfinished(spine: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Days of the spine without a result yet; all with ``force``."""
    return spine if force else spine.join(done.select(*keys).distinct(), keys, "left_anti")
