"""Column contracts, discovery of files and sinks."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.sources import sinks, tables


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return f"file://{path}"


def test_csv_contracts(spark, tmp_path):
    path = write(tmp_path / "a.csv", "date,v,extra,n\n2025-01-01,1.5,x,3\n2025-01-02,bad,y,NaN\n,NaN,z,\n")
    types = {"date": "date", "v": "double", "n": "int", "more": "double"}
    got = tables.csv_table(spark, path, types, optional=("more",))
    assert got.columns == list(types) and [tuple(r) for r in got.collect()] == [(dt.date(2025, 1, 1), 1.5, 3, None), (dt.date(2025, 1, 2), None, None, None), (None, None, None, None)]
    with pytest.raises(ValueError, match="lacks more"):
        tables.csv_table(spark, path, types)
    assert tables.csv_subset(spark, path, lambda c: c in ("v", "n"), {"v": "double"}).columns == ["v", "n"]


def test_parquet_contracts(spark, tmp_path):
    rows = [("2025-01-01 00:00:00", "G01", "-62.5", 1.0, 31, 5.0, 6.0, 9)]
    spark.createDataFrame(rows, "epoch string, sv string, lat_ipp string, lon_ipp double, ele int, vtec double, veq double, stec int").write.parquet(f"{tmp_path}/tec")
    got = tables.tec_table(spark, f"{tmp_path}/tec")
    assert dict(got.dtypes)["epoch"] == "timestamp_ntz" and tuple(got.first())[1:] == ("G01", -62.5, 1.0, 31.0, 5.0, 6.0)
    assert "stec" not in got._jdf.queryExecution().executedPlan().toString()
    bins = spark.createDataFrame([(dt.datetime(2025, 1, 1, 23, 59), -60.0, -50.0, 4.0), (dt.datetime(2025, 1, 2), -60.0, -50.0, 4.0)], "epoch timestamp_ntz, GDLAT double, glon double, tec double")
    named = tables.resolved(bins, {"epoch": ("ut", "epoch"), "gdlat": ("lat", "gdlat"), "glon": ("glon",), "tec": ("tec",), "dtec": ("dtec", "etec")}, optional=("dtec",))
    named.write.parquet(f"{tmp_path}/bins")
    bare = tables.sparse_bins(spark, f"{tmp_path}/bins")
    assert tables.region_day(bare, "2025-01-01", (-65.0, -55.0, -55.0, -45.0)).count() == 1 and bare.first().dtec is None
    with pytest.raises(ValueError, match="no column for tec"):
        tables.resolved(bins.drop("tec"), {"tec": ("tec",)})


def test_text_tables(spark, tmp_path):
    path = write(tmp_path / "x.txt", "2025 1 1 0 0 7.25 -62.5 -60.0 11.5 0.5\n2025 1 2 0 0 0 -62.5 -60.0 12.5 nan\nheader line of words\n2025 13 1 0 0 0 1 2 3 4\n")
    got = tables.text_extract(spark, path).orderBy("epoch").collect()
    assert [(str(r.epoch), r.tec) for r in got] == [("2025-01-01 00:00:07.250000", 11.5), ("2025-01-02 00:00:00", 12.5)]
    assert tables.text_extract(spark, path, "2025-01-02").count() == 1
    path = write(tmp_path / "sites.txt", "'SITE', -62.64 -60.36\nbad line\n\"ABCD\" 1.0 2.0 more\nXYZ one two\n")
    assert sorted(map(tuple, tables.sites(spark, path).collect())) == [("ABCD", 1.0, 2.0), ("SITE", -62.64, -60.36)]


def test_solar_files(spark, tmp_path):
    line = lambda y, m, d, f: f"{y} {m} {d} " + " ".join(map(str, range(3, 14))) + f" {f} 120.0 130.0\n"
    path = write(tmp_path / "ap.dat", line(19, 1, 1, 100.0) + line(119, 1, 2, 101.0) + line(2019, 1, 2, 102.0) + line(99, 1, 3, 90.0) + line(2019, 2, 30, 99.0) + line(2019, 1, 4, 20.0) + "short\n")
    got = {str(r.date): (r.f107_daily, r.f107_81, r.f107_365, r.ap_daily) for r in tables.solar_daily(spark, path).collect()}
    assert got == {"2019-01-01": (100.0, 120.0, 130.0, 11.0), "2019-01-02": (102.0, 120.0, 130.0, 11.0), "1999-01-03": (90.0, 120.0, 130.0, 11.0)}
    day = lambda y, d, f: f"{y} {d} " + " ".join(["0"] * 48) + f" {f}\n"
    path = write(tmp_path / "omni.dat", day(2024, 60, 150.5) + day(2024, 60, 151.5) + day(2024, 61, 999.9) + day(2024, 366, 80))
    assert {str(r.date): r.f107 for r in tables.solar_average(spark, path).collect()} == {"2024-02-29": 151.5, "2024-12-31": 80.0}


def test_files_by_name(spark, tmp_path):
    for name in ("a/X_001_2024_b.txt", "a/X_001_2024_c.txt", "a/X_002_2023_c.txt", "a/X_367_2024_c.txt", "a/deep/wanted_1.csv", "a/S_01D_15S_MO.rnx", "a/S_30S_MO.rnx", "a/T_01D_15S_MO.rnx", "a/U_other.rnx"):
        write(tmp_path / name, "x")
    folder = f"file://{tmp_path}/a"
    days = tables.days_of_files(tables.files(spark, folder, "X_*"))
    assert sorted((r.year, r.doy, r.path.rpartition("/")[2]) for r in days.collect()) == [(2023, 2, "X_002_2023_c.txt"), (2024, 1, "X_001_2024_c.txt")]
    assert tables.days_of_files(tables.files(spark, folder, "X_*"), 2024).count() == 1
    named = tables.files(spark, folder, "*.rnx").withColumn("site", F.substring("name", 1, 1))
    assert sorted(r.name for r in tables.preferred_files(named, ["site"]).collect()) == ["S_30S_MO.rnx", "T_01D_15S_MO.rnx"]
    assert tables.locate(spark, folder, ["none.csv", "U_other.rnx"], "*.rnx").endswith("U_other.rnx")
    assert tables.locate(spark, folder, ["none.csv"], "wanted_*.csv").endswith("deep/wanted_1.csv")
    with pytest.raises(FileNotFoundError):
        tables.locate(spark, folder, ["none.csv"], "*.zip")


def test_segments_channels_and_unfinished_days(spark):
    one, two = spark.createDataFrame([(1, "G1", 5.0)], "t int, sv string, v double"), spark.createDataFrame([(1, "G1", 6.0, 1), (0, "G2", 7.0, 2)], "t int, sv string, v double, w int")
    assert [tuple(r) for r in tables.segments_of_day([one, two], ["t", "sv"]).collect()] == [(0, "G2", 7.0, 2), (1, "G1", 5.0, None)]
    heads = spark.createDataFrame([("R01", 1), ("R01", 1), ("R02", -4), ("R03", None)], "sv string, channel int")
    assert sorted(map(tuple, tables.agreed_channels(heads).collect())) == [("R01", 1), ("R02", -4)]
    with pytest.raises(PySparkException, match="conflicting channels of R01"):
        tables.agreed_channels(heads.union(spark.createDataFrame([("R01", 2)], heads.schema))).collect()
    spine = spark.range(5).withColumnRenamed("id", "doy")
    assert sorted(r.doy for r in tables.unfinished(spine, spine.where("doy in (1, 3)"), ["doy"]).collect()) == [0, 2, 4]
    assert tables.unfinished(spine, spine, ["doy"], force=True).count() == 5


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0), (dt.date(2024, 12, 31), 2.0), (dt.date(2024, 12, 31), None)], "date date, v double")
    for kind in (True, False):
        path = f"{tmp_path}/days{kind}"
        sinks.write_days(df, path, "date", parquet=kind)
        sinks.write_days(df.where("v = 2"), path, "date", parquet=kind)
        back = spark.read.parquet(path) if kind else spark.read.option("header", True).csv(path)
        assert sorted((r.year, r.doy, str(r.v)) for r in back.collect()) == [(2024, 1, "1.0"), (2024, 366, "2.0")]
    sinks.write_result(df, f"{tmp_path}/csv", [F.desc("v")])
    lines = [x for p in sorted((tmp_path / "csv").glob("part-*")) for x in p.read_text().splitlines() if x != "date,v"]
    assert lines == ["2024-12-31,2.0", "2024-01-01,1.0", "2024-12-31,"]
    sinks.write_snapshot(df.withColumn("y", F.year("date")), f"{tmp_path}/snap", ["y"])
    assert spark.read.parquet(f"{tmp_path}/snap").count() == 3
    sinks.write_manifest(df, f"{tmp_path}/report", "Days", ["date", "v"])
    assert [r.value for r in spark.read.text(f"{tmp_path}/report").collect()] == ["Days", "rows: 3", "date: 3 / 0 / 2024-01-01 / 2024-12-31", "v: 2 / 1 / 1.0 / 2.0"]
