"""Resampling draws with replacement."""

from pyspark.sql import functions as F

from tidemark.operators import stats


def test_replicates_repeat_and_omit_clusters(spark):
    n = 40
    draws = spark.range(50).withColumnRenamed("id", "rep").crossJoin(spark.range(n).withColumnRenamed("id", "slot"))
    picked = draws.withColumn("idx", stats.mixed_pick(F.col("rep"), F.col("slot"), F.lit(n), 7))
    distinct = [r.c for r in picked.groupBy("rep").agg(F.count_distinct("idx").alias("c")).collect()]
    assert all(c < n for c in distinct) and 0.55 * n < sum(distinct) / len(distinct) < 0.71 * n  # 1 - 1/e = 0.632
    uses = {r.idx: r["count"] for r in picked.groupBy("idx").count().collect()}
    assert set(uses) == set(range(n)) and max(uses.values()) < 2 * 50


def test_interval_has_width(spark):
    clusters = spark.createDataFrame([(k, float(k * k), 2) for k in range(30)], "c long, total double, cnt long")
    got = stats.cluster_bootstrap(clusters, "c", "total", "cnt", 400, 7).first()
    assert got.reps == 400 and got.low < got.mean < got.high and got.high - got.low > 20
    assert stats.cluster_bootstrap(clusters.limit(0), "c", "total", "cnt", 10, 7).first().reps == 0
