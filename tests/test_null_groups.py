"""Groups whose key is null, against SQL."""

import duckdb
import pytest

from tidemark.plans import catalog


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    folder, con = tmp_path_factory.mktemp("nulls"), duckdb.connect()
    con.execute("create view part as select * from '/root/testdata/sf0.001/part.parquet'")
    con.execute("""create table lineitem as select * replace (if(l_orderkey % 7 = 0, null, l_shipdate) as l_shipdate, if(l_orderkey % 5 = 0, null, l_returnflag) as l_returnflag)
     from '/root/testdata/sf0.001/lineitem.parquet'""")
    for t in ("part", "lineitem"):
        con.execute(f"copy (from {t}) to '{folder}/{t}.parquet' (format parquet)")
    return str(folder), con


@pytest.mark.parametrize("name", ["point_weighted_year", "pooled_single_precision"])
def test_null_groups_have_quantiles(spark, data, name):
    folder, con = data
    found = catalog.QUERIES[name](spark, folder)
    want = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    rows = lambda x: sorted(map(repr, x))
    assert rows(tuple(r) for r in found.select(*columns).collect()) == rows(want.fetchall())
