"""Checked joins, single rows and quantiles."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import align, paired, selection
from tidemark.operators.quantiles import exact_quantiles


def test_joins_that_check_their_sides(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (9, "d")], "k int, x string")
    right = spark.createDataFrame([(1, 10), (2, 20)], "k int, y int")
    assert sorted(map(tuple, selection.checked_many_to_one(left, right, ["k"]).select("x", "y").collect())) == [("a", 10), ("b", 10), ("c", 20), ("d", None)]
    with pytest.raises(PySparkException, match="right side is not unique"):
        selection.checked_many_to_one(left, right.union(right.limit(1)), ["k"]).collect()
    with pytest.raises(PySparkException, match="left side is not unique"):
        selection.checked_one_to_one(left, right, ["k"]).collect()


def test_the_row_must_be_there_once(spark):
    df = spark.range(5)
    assert [r.id for r in selection.the_row(df, F.col("id") == 3).collect()] == [3]
    for condition in (F.col("id") > 2, F.col("id") > 9):
        with pytest.raises(PySparkException, match="rows found"):
            selection.the_row(df, condition).collect()


def test_exact_quantiles_of_groups_of_all_sizes(spark):
    rng = random.Random(4)
    rows = [("one", 5.0), ("two", 1.0), ("two", 2.0), ("nan", float("nan")), ("nan", None), (None, 3.0), (None, 7.0)]
    rows += [("ties", rng.choice([1.0, 2.0])) for _ in range(900)] + [("wide", rng.gauss(0, 10)) for _ in range(5000)] + [("few", rng.random()) for _ in range(17)]
    df = spark.createDataFrame(rows, "g string, v double")
    at = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r.g: tuple(r)[1:] for r in exact_quantiles(df, ["g"], "v", at).collect()}
    good = df.where("v is not null and not isnan(v)").groupBy("g").agg(*[F.percentile("v", p).alias(n) for n, p in at.items()])
    want = {r.g: tuple(r)[1:] for r in good.collect()}
    assert got.keys() == want.keys()
    for g, values in want.items():
        assert got[g] == pytest.approx(values)
    whole = exact_quantiles(df, [], "v", {"m": 0.5}).first()
    assert whole.m == pytest.approx(df.where("v is not null and not isnan(v)").agg(F.percentile("v", 0.5)).first()[0])


def test_bundles_without_finite_pairs(spark):
    df = spark.createDataFrame([("x", 1.0, 1.0), ("x", float("nan"), 1.0), ("x", None, 1.0), ("x", 3.0, 1.0), ("y", float("inf"), 2.0)], "g string, m double, r double")
    for f in (paired.paired_stats, paired.pooled_stats):
        got = {r.g: r for r in f(df, ["g"], "m", "r").collect()}
        assert (got["x"].n, got["x"].bias, got["x"].median, got["x"].r) == (2, 1.0, 1.0, None)
        assert got["y"].n == 0 and got["y"].bias is None and got["y"].median is None


def test_nearest_time_rules(spark):
    left = spark.createDataFrame([("a", 150), ("a", 1000), ("b", 150), (None, 150), ("a", None), ("a", 150)], "k string, t long")
    right = spark.createDataFrame([("a", 0, 1.0), ("a", 300, 2.0), ("a", 300, 0.5), ("b", -40, 3.0), ("b", 340, 4.0), (None, 150, 9.0), ("a", None, 8.0)], "k string, t long, v double")
    got = sorted((str(r.k), str(r.t), r.matched_time, r.v) for r in align.nearest_time(left, right, "t", 180, ["k"], "v").collect())
    assert got == [("None", "150", None, None), ("a", "1000", None, None), ("a", "150", 0, 1.0), ("a", "150", 0, 1.0), ("a", "None", None, None), ("b", "150", None, None)]


def test_nearest_time_against_all_pairs(spark):
    rng = random.Random(2)
    lefts = [(rng.randrange(3), rng.randrange(3000)) for _ in range(400)]
    rights = [(rng.randrange(3), rng.randrange(3000), float(rng.randrange(50))) for _ in range(150)]
    left, right = spark.createDataFrame(lefts, "k int, t long"), spark.createDataFrame(rights, "k int, t long, v double")
    got = sorted((r.k, r.t, str(r.matched_time), str(r.v)) for r in align.nearest_time(left, right, "t", 7, ["k"], "v").collect())
    want = []
    for k, t in lefts:
        near = sorted((abs(u - t), u, v) for g, u, v in rights if g == k and abs(u - t) <= 7)
        want.append((k, t, *map(str, near[0][1:] if near else (None, None))))
    assert got == sorted(want)


def test_grid_rule_of_finite_corners(spark):
    grid = spark.createDataFrame([(i, j, k, v) for k, maps in enumerate([(0.0, 10.0, 20.0, None), (None, None, None, None)]) for (i, j), v in zip([(0, 0), (0, 1), (1, 0), (1, 1)], maps)], "i int, j int, k int, node_value double")
    points = spark.createDataFrame([(1, 0.5, 0.5, 0.25), (2, 1.0, 1.0, 0.0), (3, 0.0, 1.0, 0.5), (4, 1.2, 0.5, 0.5), (5, 0.5, 0.5, 1.0), (6, 0.5, 0.5, 1.5), (7, None, 0.5, 0.5)], "p int, lat double, lon double, t double")
    got = {r.p: r.value for r in align.grid_interpolate_finite(points, grid, "p", [0.0, 1.0], [0.0, 1.0], [0.0, 1.0]).collect()}
    assert got == {1: 10.0, 2: None, 3: 10.0, 4: None, 5: 10.0, 6: None, 7: None}


def test_flat_cells_beyond_the_limit_and_across_the_date_line(spark):
    points = spark.createDataFrame([(1, 0.0, 179.9), (2, -75.0, -54.1), (3, 0.0, 0.0)], "p int, lat double, lon double")
    cells = spark.createDataFrame([(10, 0.0, -179.9), (11, -75.0, -44.2), (12, 0.73, 0.0), (13, 0.0, 0.73)], "c int, lat double, lon double")
    got = {r.p: (r.c, round(r.km, 2)) for r in align.nearest_cell_flat(points, cells, "p", "c", 80.0).collect()}
    assert got == {1: (10, 22.26)}
    wide = {r.p: r.c for r in align.nearest_cell_flat(points, cells, "p", "c", 300.0).collect()}
    assert wide == {1: 10, 2: 11, 3: 13}
