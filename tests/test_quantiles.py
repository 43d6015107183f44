"""Quantiles of rows that come in another order each time they are read, and of narrow, wide and uneven groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import quantiles
from tidemark.operators.quantiles import exact_quantiles

AT = {"low": 0.05, "mid": 0.5, "high": 0.95, "top": 0.99}


def test_order_of_rows_changes_nothing(spark):
    """As over a network, where parts of a sketch are merged as they arrive."""

    def dealt(batches):
        rng = np.random.default_rng()
        for b in batches:
            yield b.assign(k=rng.integers(1 << 31, size=len(b)))

    n = 800_000
    df = spark.range(0, n, 1, 8).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % n).cast("double").alias("v")).mapInPandas(dealt, "g long, v double, k long").repartition(8, "k")
    want = {g: np.quantile(np.arange(g, n, 2, dtype=float), list(AT.values())) for g in (0, 1)}
    for _ in range(3):
        for r in exact_quantiles(df, ["g"], "v", AT).collect():
            assert np.allclose(r[1:], want[r.g], atol=1e-6), r


@pytest.mark.parametrize("inside", [1, 50, 100_000])
def test_brackets_of_uneven_values(spark, monkeypatch, inside):
    monkeypatch.setattr(quantiles, "INSIDE", inside)
    rng = np.random.default_rng(3)
    groups = {
        "equal": np.full(500, 0.1), "one": np.array([-2.5]), "far": np.r_[rng.normal(size=999), 1.7e308, -1.7e308], "tiny": np.array([5e-324, 0.0, -0.0, 1e-323] * 40),
        "ties": rng.integers(0, 4, 700).astype(float), None: rng.normal(size=300) + 1e9}
    df = spark.createDataFrame(pd.DataFrame([(g, float(x)) for g, v in groups.items() for x in v], columns=["g", "v"]), "g string, v double")
    got = {r.g: r[1:] for r in exact_quantiles(df, ["g"], "v", AT).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert np.allclose(got[g], np.quantile(v, list(AT.values())), rtol=1e-12, atol=1e-12), g
