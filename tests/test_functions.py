"""Scalar functions against known values and plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geodesy as geo
from tidemark.functions import probability as prob
from tidemark.operators import selection


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_geodesy_of_the_station_and_the_poles(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    r = one(spark, a=geo.ecef_to_geodetic(*lit(1453335.2992, -2554570.1548, -5641700.7402)), b=geo.ecef_to_geodetic(*lit(0, 0, 6356762.314245)), c=geo.ecef_to_geodetic(*lit(0, 0, -6356752.314245)))
    assert r.a.lat == pytest.approx(-62.64008176, abs=1e-8) and r.a.lon == pytest.approx(-60.36376872, abs=1e-8) and r.a.height == pytest.approx(52.996, abs=1e-3)
    assert (r.b.lat, r.c.lat) == (90.0, -90.0) and r.b.height == pytest.approx(10.0, abs=1e-5) and r.c.height == pytest.approx(0.0, abs=1e-5)
    wraps = one(spark, **{f"w{k}": geo.wrap_longitude(F.lit(float(x))) for k, x in enumerate((-190, 180, 540, 0))})
    assert tuple(wraps) == (170.0, -180.0, -180.0, 0.0)
    p = one(spark, z=geo.pierce_point(*lit(10, 20, 90, 90)), n=geo.pierce_point(*lit(10, 20, 0, 30)))
    assert (p.z.lat, p.z.lon) == (pytest.approx(10), pytest.approx(20)) and p.n.lat > 13 and p.n.lon == pytest.approx(20)


def test_carriers_and_dates(spark):
    s = F.lit
    r = one(
        spark, g=geo.band_hz(s("G"), s("2"), s(0.0)), r=geo.band_hz(s("R"), s("1"), s(-7.0)), none=geo.band_hz(s("C"), s("1"), s(0.0)), metres=geo.cycles_to_metres(s(1.0), s(1575.42e6)),
        mjd=geo.mjd_to_timestamp(s(60676.5)).cast("string"), doy=geo.day_of_year_date(s(2024), s(366)), bad=geo.day_of_year_date(s(2023), s(366)), week=geo.gps_week(s("1980-01-13").cast("date")), days=geo.days_in_year(s(2024)),
        start=geo.window_start(s(130), 60, 10))
    assert (r.g, r.r, r.none) == (1227.60e6, (1602 - 0.5625 * 7) * 1e6, None) and r.metres == pytest.approx(0.190293672798365)
    assert r.mjd == "2025-01-01 12:00:00" and str(r.doy) == "2024-12-31" and r.bad is None and (r.week, r.days, r.start) == (1, 366, 130)


def test_tail_probabilities():
    assert prob.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert prob.t_two_sided(0.0, 5) == 1 and prob.t_two_sided(1.0, 1) == pytest.approx(0.5) and prob.t_two_sided(None, 3) is None and prob.t_two_sided(1.0, 0) is None
    assert prob.t_two_sided(50.0, 3) == pytest.approx(1.76e-5, rel=0.01) and prob.t_two_sided(1.96, 1e7) == pytest.approx(0.04999579, abs=1e-6)
    for n in range(1, 15):
        for k in range(n + 1):
            tail = sum(math.comb(n, i) for i in range(n + 1) if math.comb(n, i) <= math.comb(n, k)) / 2**n
            assert prob.sign_two_sided(k, n) == pytest.approx(min(1.0, tail))
    assert prob.sign_two_sided(0, 0) is None


def test_finite_and_classes(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "v double")
    assert [r[0] for r in df.select(selection.finite(F.col("v"))).collect()] == [True, False, False, False, False]
    rows = [(5.0, 0.0, 0.0), (1.0, 0.0, 0.0), (4.5, 0.0, 0.0), (None, -99.0, 0.0), (1.0, -50.0, 0.0), (3.9, -29.0, -50.0)]
    got = spark.createDataFrame(rows, "a double, b double, c double").select(selection.activity_class(F.col("a"), F.col("b"), F.col("c"))).collect()
    assert [r[0] for r in got] == ["storm", "quiet", "active_nonstorm", "unknown", "storm", "storm"]
