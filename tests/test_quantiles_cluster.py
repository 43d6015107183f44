"""Quantiles on a local cluster, where blocks of a shuffle arrive in another order each time they are read."""

import os
import subprocess
import sys
import tempfile


def run() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from tidemark.operators.quantiles import exact_quantiles

    builder = SparkSession.builder.master("local-cluster[3,2,1024]").config("spark.executor.memory", "1g").config("spark.sql.shuffle.partitions", "12")
    builder = builder.config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-"))
    spark = builder.getOrCreate()
    df = spark.range(0, 2_000_000, 1, 24).select((F.col("id") % 20).alias("g"), (F.xxhash64("id") / 2**40).alias("v"))
    at = {"low": 0.05, "mid": 0.5, "high": 0.95}
    want = {r[0]: r[1:] for r in df.groupBy("g").agg(*[F.percentile("v", p) for p in at.values()]).collect()}
    got = {r[0]: r[1:] for r in exact_quantiles(df, ["g"], "v", at).collect()}
    print("wrong:", sum(abs(a - b) > 1e-9 * abs(b) for g in want for a, b in zip(got[g], want[g], strict=True)))
    spark.stop()


def test_arrival_of_blocks_changes_nothing():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, __file__], env=os.environ | {"PYTHONPATH": root}, cwd=tempfile.mkdtemp(prefix="spark-"), capture_output=True, text=True, timeout=300)
    assert "wrong: 0\n" in done.stdout, done.stdout + done.stderr[-2000:]


if __name__ == "__main__":
    run()
