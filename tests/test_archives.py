"""Stored states, bucketed series, linear windows."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import align, scans, segments, states, stats
from tidemark.sources import commits


def test_merged_states_equal_all_rows(spark, tmp_path):
    rows = spark.range(40_000).select(
        F.date_add(F.lit("2024-01-20").cast("date"), (F.col("id") % 40).cast("int")).alias("day"), (F.col("id") % 3).alias("k"),
        F.when(F.col("id") % 97 != 0, 1e6 + F.randn(1)).alias("m"), F.when(F.col("id") % 89 == 0, float("nan")).otherwise(1e6 + F.randn(2)).alias("r")).cache()
    path = str(tmp_path / "states")
    states.store(states.day_states(rows, ["k"], "day", "m", "r"), path)
    again = rows.where("day = date '2024-02-03'").withColumn("m", F.col("m") + 5)
    states.replace_days(states.day_states(again, ["k"], "day", "m", "r"), path)
    changed = rows.withColumn("m", F.when(F.col("day") == F.lit("2024-02-03").cast("date"), F.col("m") + 5).otherwise(F.col("m"))).where("m is not null and not isnan(r)").withColumn("res", F.col("m") - F.col("r"))
    merged = states.merge(states.stored(spark, path), ["k"])
    got = {r.k: r for r in states.statistics(merged, ["k"], {"p05": 0.05, "median": 0.5, "p95": 0.95}).collect()}
    for w in changed.groupBy("k").agg(F.count("*").alias("n"), F.avg("res").alias("bias"), F.avg(F.abs("res")).alias("mae"), F.sqrt(F.avg(F.col("res") * F.col("res"))).alias("rmse"), F.stddev_pop("res").alias("std"), F.corr("m", "r").alias("r")).collect():
        g = got[w.k]
        assert g.n == w.n and all(math.isclose(g[c], w[c], rel_tol=1e-6) for c in ("bias", "mae", "rmse", "std", "r"))
        mine = sorted(r.res for r in changed.where(F.col("k") == w.k).select("res").collect())
        for name, p in (("p05", 0.05), ("median", 0.5), ("p95", 0.95)):
            rank = sum(v <= g[name] for v in mine) / len(mine)
            assert abs(rank - p) <= states.RANK_ERROR
    assert len(list((tmp_path / "states").glob("year=2024/month=*"))) == 2
    plan = merged._jdf.queryExecution().toString()
    assert "states" in plan and "Range (" not in plan  # years come from the states alone
    assert states.merge(states.day_states(rows.limit(0), ["k"], "day", "m", "r"), ["k"]).count() == 0


@pytest.mark.parametrize("width", [7, 50, 1e9])
def test_bucketed_segments_equal_whole_windows(spark, width):
    rng = random.Random(3)
    rows, t = [], 0.0
    for k in range(600):
        t += rng.choice([0.0, 1.0, 1.0, 1.0, 2.0, 9.0, 60.0])
        rows.append((rng.choice(["a", "a", "b", None]), None if k % 101 == 0 else t, k, rng.random() < 0.05, k))
    df = spark.createDataFrame(rows, "s string, t double, k long, mark boolean, dt_ long")
    got = scans.bucketed_segments(df, ["s"], "t", ["k"], width, 5, F.col("mark"), 3)
    assert got.columns == [*df.columns, "dt", "segment_id", "segment_begin", "segment_end", "edge", "near_edge"]
    plain = segments.in_order(["s"], ["t", "k"])
    dt = F.col("t") - F.lag("t").over(plain)
    starts = F.coalesce((F.col("dt") <= 0) | (F.col("dt") > 5), F.lit(True)) | F.col("mark")
    want = df.withColumn("dt", dt).withColumn("segment_id", F.sum(starts.cast("int")).over(plain) - 1)
    want = segments.edge_distance(want, ["s", "segment_id"], "t", 3)
    assert sorted((r.k, r.dt, r.segment_id, r.edge, r.near_edge) for r in got.collect()) == sorted((r.k, r.dt, r.segment_id, r.edge, r.near_edge) for r in want.collect())


def test_no_window_over_the_whole_series(spark):
    df = spark.range(100_000).select(F.lit(1).alias("s"), F.col("id").cast("double").alias("t"), "id")
    found = scans.bucketed_segments(df, ["s"], "t", ["id"], 1000, 5)
    assert found.agg(F.max("segment_id"), F.max("segment_end"), F.count("*")).first()[:] == (0, 99_999.0, 100_000)
    windows = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if " Window [" in line or "Window [" in line]
    assert windows and all("_bucket" in line or "_segment" in line for line in windows)


def test_nearest_time_and_q_values_are_linear(spark):
    """A bucket or range of 200,000 rows in one task: a frame that looks ahead would take minutes."""
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.col("id").alias("v"))
    began = time.time()
    met = align.nearest_time(df, df.where("t % 3 = 0"), "t", 1_000_000, ["k"], "v")
    assert met.agg(F.sum("gap"), F.count("*")).first()[:] == (sum(min(t % 3, 3 - t % 3 if t - t % 3 + 3 < n else 9) for t in range(n)), n)
    p = df.select("t", ((F.col("t") + 1) / n).alias("p"))
    assert stats.benjamini_hochberg(p, "p", "t").agg(F.min("q")).first()[0] == pytest.approx(1.0)
    assert time.time() - began < 60


def test_values_that_are_not_finite(spark):
    nan = float("nan")
    rows = [(1, 0.01), (2, 0.02), (3, nan), (4, None), (5, float("inf"))]
    got = {r.k: r.q for r in stats.benjamini_hochberg(spark.createDataFrame(rows, "k long, p double"), "p", "k").collect()}
    assert got == {1: 0.02, 2: 0.02, 3: None, 4: None, 5: None}
    pairs = [(1.0, 2.0), (2.0, 4.0), (3.0, 9.0), (nan, 1.0), (4.0, None)]
    row = stats.spearman(spark.createDataFrame(pairs, "x double, y double"), "x", "y").first()
    assert (row.n, round(row.rho, 9)) == (3, 1.0)


def test_interval_join_equals_all_pairs(spark):
    rng = random.Random(9)
    points = [(k, rng.choice(["a", "b", None]), rng.choice([None, *range(-300, 300)])) for k in range(200)]
    spans = [(n, rng.choice(["a", "b"]), a, a + rng.choice([-1, 0, 1, 3, 4, 5, 16, 17, 100, 400])) for n, a in enumerate(rng.randrange(-320, 320) for _ in range(300))] + [(999, "a", None, 5)]
    p, w = spark.createDataFrame(points, "k long, s string, t long"), spark.createDataFrame(spans, "w long, s string, a long, b long")
    inside = lambda t, a, b: t is not None and a is not None and a <= t < b
    got = align.interval_join(p, w, "t", "a", "b", ["s"])
    assert sorted((r.k, r.w) for r in got.collect()) == sorted((k, n) for k, s, t in points for n, z, a, b in spans if s == z and inside(t, a, b))
    got = align.interval_join(p.drop("s"), w.drop("s"), "t", "a", "b")
    assert sorted((r.k, r.w) for r in got.collect()) == sorted((k, n) for k, _, t in points for n, _, a, b in spans if inside(t, a, b))
    assert align.interval_join(p, w.limit(0), "t", "a", "b", ["s"]).count() == 0


def test_many_windows_without_nested_loop(spark):
    points = spark.range(100_000).select(F.col("id").alias("t"))
    spans = spark.range(100_000).select(F.col("id").alias("w"), (F.col("id") * 7 % 100_000).alias("a")).withColumn("b", F.col("a") + F.col("w") % 50)
    found = align.interval_join(points, spans, "t", "a", "b")
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == spans.agg(F.sum(F.least("b", F.lit(100_000)) - F.col("a"))).first()[0]


def test_only_published_units_are_read(spark, tmp_path):
    root = f"file://{tmp_path}/run"
    one = lambda v: spark.createDataFrame([(v,)], "v long")
    units = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "unit string")
    assert commits.committed(spark, root, "v long").count() == 0 and commits.unfinished(units, root).count() == 3
    commits.commit(one(1), root, "d1")
    commits.write_aside(one(2), root, "d2")  # stopped before it is published
    assert [r.v for r in commits.committed(spark, root, "v long").collect()] == [1]
    commits.write_aside(one(10), root, "d1")  # stopped while it is written again
    assert [r.v for r in commits.committed(spark, root, "v long").collect()] == [1]
    for r in commits.unfinished(units, root).collect():
        commits.commit(one(20), root, r.unit)
    commits.commit(one(11), root, "d1")
    assert sorted(r.v for r in commits.committed(spark, root, "v long").collect()) == [11, 20, 20] and commits.unfinished(units, root).count() == 0


def test_nearest_site_without_limit(spark):
    """Against all pairs: poles, the date line, antipodes, one cluster and far points."""
    rng = random.Random(7)
    sites = [(k, 50 + rng.random(), 10 + rng.random()) for k in range(40)] + [(90, 90.0, 0.0), (91, -89.9, 33.0), (92, 0.0, 179.95)]
    points = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(60)] + [(100, 0.1, -179.99), (101, -90.0, 5.0), (102, 89.99, -170.0), (103, -50.5, -169.5), (104, None, 1.0), (105, 50.5, 10.5)]

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371 * math.asin(min(1.0, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    p, s = spark.createDataFrame(points, "k long, lat double, lon double"), spark.createDataFrame(sites, "site long, lat double, lon double")
    for first in (5.0, 500.0, 30_000.0):
        got = {r.k: (r.site, r.km) for r in align.nearest_site(p, s, "k", "site", first).collect()}
        assert set(got) == {k for k, lat, _ in points if lat is not None}
        for k, lat, lon in points:
            if lat is not None:
                best = min(sites, key=lambda x: km(lat, lon, x[1], x[2]))  # noqa: B023
                assert got[k][0] == best[0] and abs(got[k][1] - km(lat, lon, *best[1:])) < 1e-6
    assert align.nearest_site(p, s.limit(0), "k", "site").count() == 0
