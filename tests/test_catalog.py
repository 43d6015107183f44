"""Every catalogue query against its SQL on the smallest driver tables."""

import math

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return ""
    if hasattr(v, "year"):
        return str(v)[:10]
    if isinstance(v, bool) or isinstance(v, str):
        return str(v)
    return f"{float(v):.12g}"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    want = db.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda d: sorted([cell(v) for v in r] for r in d[columns].astype(object).values.tolist())
    assert rows(got) == rows(want)


def test_queries_without_sql_have_tests_of_their_own():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"arcs_cut_and_filtered", "filtered_arcs", "long_arc_filtered", "orbit_positions"}  # tests/test_highrate.py, test_long_arcs.py
    assert len(catalog.ORACLES) > 120
