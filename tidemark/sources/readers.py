"""Readers of the text formats as DataFrames: numeric tables, grid maps, orbits and observations.

Files are the unit of reading, but for observation files; a day or an hour is one. Lines keep their file and number, and what a
line inherits from earlier ones (epoch, band, header) is the last non-null value of a window over its
file, so files are parsed side by side and nothing passes through the driver. ``gzip`` files are
unpacked by Spark. Observation files are split at their epoch lines, and records cut in numpy. Times are ``timestamp_ntz`` in UTC; bad numbers are null.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMBER = r"[+-]?\d+(?:\.\d*)?"


def file_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, pos, line)`` of every line."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))


def words(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def double(text: Column) -> Column:
    """A finite number or null; what begins like no number is not cast, as a failing cast is slow."""
    part = F.trim(text)
    found = F.when(part.rlike("^[-+.0-9]"), part.try_cast("double"))
    return F.when(F.abs(found) < float("inf"), found)


def carried(value: Column) -> Column:
    """The last non-null value at or before a line of its file."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy("file").orderBy("pos"))


def epoch(parts: Column, first: int = 0) -> Column:
    """Time of the words year, month, day, hour, minute, second; seconds are rounded to microseconds."""
    year, month, day, hour, minute = (F.get(parts, F.lit(first + k)).try_cast("int") for k in range(5))
    second = F.get(parts, F.lit(first + 5)).try_cast("decimal(18,6)")
    return F.make_timestamp_ntz(year, month, day, hour, minute, F.lit(0)) + F.make_dt_interval(secs=second)


def mjd_time(mjd: Column) -> Column:
    """Time of a modified Julian date."""
    days = F.floor(mjd).cast("int")
    seconds = ((mjd - F.floor(mjd)) * 86400).cast("decimal(18,6)")
    return F.lit("1858-11-17 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=days, secs=seconds)


def word_table(spark: SparkSession, path: str | list[str], columns: Mapping[str, int], sentinels: Mapping[str, float] | None = None) -> DataFrame:
    """Numeric columns by word number (from 1) of lines split at white space.

    A value whose size reaches its column's sentinel is null. Lines without a number in the first
    named column (headers, blanks) are dropped.
    """
    lines = spark.read.text(path).select(words(F.col("value")).alias("w"))
    out = []
    for name, at in columns.items():
        value = double(F.get("w", F.lit(at - 1)))
        if sentinels and name in sentinels:
            value = F.when(F.abs(value) < sentinels[name], value)
        out.append(value.alias(name))
    return lines.select(*out).where(F.col(next(iter(columns))).isNotNull())


def mjd_table(spark: SparkSession, path: str | list[str], columns: list[str], mjd: str = "mjd") -> DataFrame:
    """A headerless table of named columns at white space, with ``epoch`` from the column ``mjd``."""
    rows = word_table(spark, path, {mjd: columns.index(mjd) + 1} | {c: k + 1 for k, c in enumerate(columns)})
    return rows.select(mjd_time(F.col(mjd)).alias("epoch"), *columns)


def daily_semicolon(spark: SparkSession, path: str | list[str], value: str) -> DataFrame:
    """``(date, value)`` of lines ``year;month;day;fraction;value;...``; negative values are null."""
    part = F.split("value", ";")
    number = double(F.get(part, F.lit(4)))
    day = F.try_to_date(F.concat_ws("-", *(F.trim(F.get(part, F.lit(k))) for k in range(3))), "y-M-d")
    return spark.read.text(path).select(day.alias("date"), F.when(number >= 0, number).alias(value)).where("date is not null")


def day_of_year(year: Column, doy: Column) -> Column:
    return F.date_add(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), doy.cast("int") - 1)


def grid_maps(spark: SparkSession, path: str | list[str], missing: int = 9999) -> DataFrame:
    """``(file, map_epoch, lat, lon, value)`` of grid map files; ``missing`` is null before scaling.

    A band whose number of values does not fit its longitudes is an error.
    """
    label = F.trim(F.substring("line", 61, 20))
    head = F.substring("line", 1, 60)
    numbers = lambda text: F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))
    is_band = label == "LAT/LON1/LON2/DLON/H"
    lines = file_lines(spark, path).select(
        "file", "pos", "line",
        carried(F.when(label.rlike("^(START|END) OF [A-Z]+ MAP$|^END OF HEADER$"), label)).alias("section"),
        carried(F.when(label == "EXPONENT", F.regexp_extract(head, NUMBER, 0).try_cast("int"))).alias("exponent"),
        carried(F.when(label == "EPOCH OF CURRENT MAP", epoch(words(head)))).alias("map_epoch"),
        carried(F.when(is_band, F.struct("pos", numbers(head).alias("n")))).alias("band"))
    data = lines.where((F.col("section") == "START OF TEC MAP") & F.col("line").rlike(r"^[\s\d+-]*\d[\s\d+-]*$") & (F.col("pos") > F.col("band.pos")))
    bands = data.groupBy("file", "map_epoch", "band", "exponent").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: numbers(x["line"]))).alias("found"))
    lat, first, last, step = (F.get("band.n", F.lit(k)) for k in range(4))
    whole = F.size("found") == F.round((last - first) / step).cast("int") + 1
    checked = bands.select("file", "map_epoch", lat.alias("lat"), first.alias("first"), step.alias("step"), F.coalesce("exponent", F.lit(-1)).alias("exponent"),
                           F.when(whole, F.col("found")).otherwise(F.raise_error(F.concat(F.lit("incomplete grid row in "), "file"))).alias("found"))
    cells = checked.select("file", "map_epoch", "lat", "first", "step", "exponent", F.posexplode("found").alias("k", "raw"))
    value = F.when(F.col("raw") != missing, F.col("raw") * F.pow(F.lit(10.0), "exponent"))
    return cells.select("file", "map_epoch", "lat", (F.col("first") + F.col("k") * F.col("step")).alias("lon"), value.alias("value"))


def orbits(spark: SparkSession, path: str | list[str], limit_m: float = 999_000_000.0) -> DataFrame:
    """``(epoch, sv, x_m, y_m, z_m)`` of orbit files; of repeated positions the last one stays.

    Coordinates come from fixed columns, or from words where a fixed column is no number; rows with a
    missing coordinate or one of ``limit_m`` or more go.
    """
    star = F.col("line").startswith("*")
    lines = file_lines(spark, path).select("file", "pos", "line", carried(F.when(star, epoch(words(F.substring("line", 2, 60))))).alias("epoch"))
    fixed = [double(F.substring("line", 5 + 14 * k, 14)) for k in range(3)]
    loose = [double(F.get(words(F.substring("line", 5, 200)), F.lit(k))) for k in range(3)]
    use = fixed[0].isNotNull() & fixed[1].isNotNull() & fixed[2].isNotNull()
    metres = [(F.when(use, a).otherwise(b) * 1000).alias(n) for a, b, n in zip(fixed, loose, ("x_m", "y_m", "z_m"), strict=True)]
    points = lines.where(F.col("line").startswith("P") & F.col("epoch").isNotNull()).select(
        "file", "pos", "epoch", F.replace(F.substring("line", 2, 3), F.lit(" "), F.lit("0")).alias("sv"), *metres)
    good = points.where(" and ".join(f"abs({c}) < {limit_m}" for c in ("x_m", "y_m", "z_m")))
    last = good.groupBy("epoch", "sv").agg(F.max_by(F.struct("x_m", "y_m", "z_m"), F.struct("file", "pos")).alias("p"))
    return last.select("epoch", "sv", "p.x_m", "p.y_m", "p.z_m")


def observation_types(lines: DataFrame) -> DataFrame:
    """``(file, system, types)`` of the headers in ``(file, pos, line)``, continuation lines included."""
    head = lines.where(F.trim(F.substring("line", 61, 20)) == "SYS / # / OBS TYPES")
    system, count = F.trim(F.substring("line", 1, 1)), F.trim(F.substring("line", 4, 3)).try_cast("int")
    rows = head.select("file", "pos", carried(F.when(system != "", system)).alias("system"), count.alias("n"), F.regexp_extract_all(F.substring("line", 7, 54), F.lit(r"\S+"), F.lit(0)).alias("t"))
    found = rows.groupBy("file", "system").agg(F.max("n").alias("n"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"])).alias("t"))
    return found.select(F.col("file").alias("of_file"), F.col("system").alias("of_system"), F.slice("t", 1, F.coalesce("n", F.size("t"))).alias("types"))


OBSERVATIONS = "file string, epoch timestamp_ntz, sv string, obs string, value double, lli int, ssi int"
#: Records of an Arrow batch of values.
RECORDS = 8_192


def _values(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, marks) of rows of fields: 14 characters of number, two of marks; a bad number is NaN."""
    cells = cells.reshape(-1, 16)
    numbers = cells[:, :14].copy()
    values = np.full(len(numbers), np.nan)
    # usual fields have three decimals: digits after blanks and a sign make an integer
    digit = numbers - 48
    whole, rest = digit[:, :10], digit[:, 11:]
    is_digit, blank, minus = whole <= 9, numbers[:, :10] == 32, numbers[:, :10] == 45
    filled = is_digit | minus
    usual = (numbers[:, 10] == 46) & (rest <= 9).all(axis=1) & (filled | blank).all(axis=1) & (filled[:, 1:] | ~filled[:, :-1]).all(axis=1)
    usual &= (~minus[:, 1:] | blank[:, :-1]).all(axis=1) & (minus.sum(axis=1) <= 1) & is_digit[:, 9]
    exact = np.where(is_digit, whole, 0).astype(np.int64) @ (10 ** np.arange(12, 2, -1)) + rest.astype(np.int64) @ np.array([100, 10, 1])
    values[usual] = np.where(minus.any(axis=1), -exact, exact)[usual] / 1000.0  # both exact, so rounded once
    empty = (numbers == 32).all(axis=1)
    for k in np.flatnonzero(~usual & ~empty).tolist():
        values[k] = _number(numbers[k].tobytes())
    return values, cells[:, 14:].astype(np.int16) - 48


def _number(text: bytes) -> float:
    try:
        return float(text)
    except ValueError:
        return float("nan")


def _observation_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (file, epoch, types of each system, text) to values; the lines of a batch are cut as arrays."""
    known: dict[str, dict[str, list[str]]] = {}
    for batch in batches:
        names, headers = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        epochs = batch.column(1).cast(pa.int64()).to_numpy()
        texts = batch.column(3).cast(pa.large_binary())
        if not len(texts):
            continue
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)
        breaks = np.flatnonzero(data[: bounds[-1]] == 10)
        breaks = breaks[breaks >= bounds[0]]
        starts = breaks + 1
        block = np.searchsorted(bounds, breaks, side="right") - 1
        stops = np.minimum(np.r_[breaks[1:], bounds[-1]], bounds[block + 1])
        stops = stops - ((stops > starts) & (data[np.maximum(stops, 1) - 1] == 13))
        fits = stops - starts >= 3
        starts, stops, block = starts[fits], stops[fits], block[fits]
        one, two, three = (data[starts + k] for k in range(3))
        records = (one >= 65) & (one <= 90) & ((two == 32) | (two >= 48) & (two <= 57)) & (three >= 48) & (three <= 57)
        starts, stops, block, one = starts[records], stops[records], block[records], one[records]
        groups: dict[tuple[str, str], int] = {}
        group = np.array([groups.setdefault(pair, len(groups)) for pair in zip(names, headers, strict=True)])
        key = group[block] * 256 + one
        pairs = list(groups)
        for k in np.unique(key).tolist():
            name, header = pairs[k // 256]
            if header not in known:
                known[header] = {part[0]: part[2:].split(",") for part in header.split(";")}
            types = known[header].get(chr(k % 256))
            if types is None:
                continue
            mine = np.flatnonzero(key == k)
            places = np.arange(3 + 16 * len(types))
            for at in range(0, len(mine), RECORDS):
                some = mine[at : at + RECORDS]
                inside = places < (stops[some] - starts[some])[:, None]
                cells = np.where(inside, data[np.where(inside, starts[some][:, None] + places, 0)], np.uint8(32))
                yield _observation_rows(name, types, cells, epochs[block[some]])


def _observation_rows(name: str, types: list[str], cells: np.ndarray, epochs: np.ndarray) -> pa.RecordBatch:
    values, marks = _values(cells[:, 3:])
    good = np.flatnonzero(np.isfinite(values))
    record, field = np.divmod(good, len(types))
    names = cells[:, :3].copy()
    names[names == 32] = 48
    svs = pa.array(names.view("S3").ravel().astype("U3"))
    digit = lambda k: pa.array(marks[good, k].astype(np.int32), mask=(marks[good, k] < 0) | (marks[good, k] > 9))
    return pa.RecordBatch.from_arrays(
        [pa.array([name]).take(pa.array(np.zeros(len(good), dtype=np.int32))), pa.array(epochs.astype("datetime64[us]")[record]), svs.take(pa.array(record)), pa.array(types).take(pa.array(field)), pa.array(values[good]), digit(0), digit(1)],
        names=["file", "epoch", "sv", "obs", "value", "lli", "ssi"])


#: Most files whose headers are broadcast; headers of more files are joined by a shuffle, in which a file is a small part.
HEADERS = 100_000
_HEADER_END = "END OF HEADER"


def observation_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, header)``: the observables of each system of a file, written as ``G:C1C,L1C;R:C1C``."""
    heads = _blocks(spark, path).where(F.contains("text", F.lit(_HEADER_END)))
    lines = heads.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    parts = observation_types(lines).where("size(types) > 0").select("of_file", F.concat_ws(":", "of_system", F.array_join("types", ",")).alias("part"))
    return parts.groupBy(F.col("of_file").alias("file")).agg(F.array_join(F.array_sort(F.collect_list("part")), ";").alias("header"))


def _blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, text)``: an epoch line with its records each, without the mark that begins it; a file's header is one too."""
    return spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def observations(
    spark: SparkSession, path: str | list[str], systems: list[str] | None = None, observables: list[str] | None = None,
    since: str | None = None, until: str | None = None, broadcast: int = HEADERS,
) -> DataFrame:
    """``(file, epoch, sv, obs, value, lli, ssi)`` of observation files, a row for each value that is there.

    Files are cut into byte ranges, each of which begins at the next epoch line: that line's mark is the
    record separator, so Spark's own text scan splits a file of any size over tasks, in any store. What a
    file's header says goes to its blocks by a join with the table of headers. Blocks outside ``since``
    (included) to ``until`` (not) are dropped before they reach Python; of the others only the given
    ``systems`` and ``observables`` are kept. Records of event epochs (flag above 1) are not observations
    and go. Compressed files are one range.
    """
    words_ = words(F.substring_index("text", "\n", 1))
    flag = F.get(words_, F.lit(6))
    blocks = _blocks(spark, path).select("file", epoch(words_).alias("epoch"), flag.alias("flag"), "text")
    blocks = blocks.where("epoch is not null and (flag is null or not flag rlike '^[0-9]+$' or cast(flag as int) <= 1)")
    if since is not None:
        blocks = blocks.where(F.col("epoch") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        blocks = blocks.where(F.col("epoch") < F.lit(until).cast("timestamp_ntz"))
    headers = observation_headers(spark, path).withColumnRenamed("file", "of_file")
    if systems is not None:
        of = F.filter(F.split("header", ";"), lambda part: F.substring(part, 1, 1).isin(systems))
        headers = headers.withColumn("header", F.array_join(of, ";")).where("header <> ''")
    few = headers.limit(broadcast + 1).count() <= broadcast
    met = blocks.join(F.broadcast(headers) if few else headers, F.col("file") == F.col("of_file"))
    found = met.select("file", "epoch", "header", F.col("text").cast("binary").alias("text")).mapInArrow(_observation_batches, OBSERVATIONS)
    return found if observables is None else found.where(F.col("obs").isin(observables))
