"""Layouts: what a scan opens, and joins without a shuffle."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import layouts as plans
from tidemark.sources import layouts


def test_codes_interleave_bits(spark):
    rows = [(x, y) for x in (0, 1, 5, 7) for y in (0, 2, 3, 6)]
    got = spark.createDataFrame(rows, "x int, y int").select("x", "y", layouts.morton([F.col("x"), F.col("y")], 3).alias("z")).collect()
    assert all(r.z == sum(((r.x >> i & 1) << 2 * i) + ((r.y >> i & 1) << 2 * i + 1) for i in range(3)) for r in got)
    with pytest.raises(ValueError):
        layouts.morton([F.lit(1)] * 3, 22)


def test_bytes_read_fall_with_the_box(spark, tmp_path):
    events = plans.placed_events(spark, "/root/testdata/sf0.01")
    path = f"file://{tmp_path}/z"
    layouts.write_z_ordered(events, path, ["second", "lat", "lon"], 64)
    shares = []
    for part in (1.0, 0.5, 0.2, 0.05):
        box = {"second": (0, int(2_592_000 * part)), "lat": (-90.0, -90.0 + 180 * part), "lon": (-180.0, -180 + 360 * part)}
        cost = layouts.z_cost(spark, path, box).first()
        shares.append(cost.bytes_read / cost.bytes)
        got = layouts.z_scan(spark, path, box)
        assert len(got.inputFiles()) == cost.files_read
        want = events.where(" and ".join(f"{c} between {a} and {b}" for c, (a, b) in box.items()))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert shares[0] > 0.95 and shares[1] < 0.5 and shares[2] < 0.15 and shares == sorted(shares, reverse=True)


def test_odd_values_and_empty_tables(spark, tmp_path):
    rows = [(1.0, 2.0), (None, 3.0), (float("nan"), 1.0), (5.0, None), (1.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    path = f"file://{tmp_path}/z"
    layouts.write_z_ordered(df, path, ["a", "b"], 3)
    assert sorted(map(tuple, layouts.z_scan(spark, path, {"a": (0.0, 9.0)}).fillna(-1).collect())) == [(1.0, 2.0), (1.0, 2.0), (5.0, -1.0)]
    assert layouts.z_scan(spark, path, {"b": (10.0, 11.0)}).count() == 0
    layouts.write_z_ordered(df.where("a > 99 and not isnan(a)"), path, ["a", "b"], 3)
    assert layouts.z_scan(spark, path, {"a": (0.0, 9.0)}).count() == 0


def test_buckets_join_without_an_exchange(spark, tmp_path):
    left = spark.range(200).select((F.col("id") % 20).alias("sv"), (F.col("id") % 7).alias("epoch"), "id")
    right = left.select("sv", "epoch").distinct().where("sv <> 3").withColumn("x", F.col("sv") * 10 + F.col("epoch"))
    layouts.write_bucketed(left, "layouts_left", f"file://{tmp_path}/l", ["sv", "epoch"], 4)
    layouts.write_bucketed(right, "layouts_right", f"file://{tmp_path}/r", ["sv", "epoch"], 4, unique=True)
    joined = layouts.bucketed_join(spark, "layouts_left", "layouts_right", ["sv", "epoch"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert sorted((r.id, r.x) for r in joined.collect()) == [(k, None if k % 20 == 3 else k % 20 * 10 + k % 7) for k in range(200)]
    with pytest.raises(ValueError, match="not unique"):
        layouts.write_bucketed(right.union(right.limit(1)), "layouts_twice", f"file://{tmp_path}/t", ["sv", "epoch"], 4, unique=True)
    for name in ("layouts_left", "layouts_right", "layouts_twice"):
        spark.sql(f"drop table {name}")
