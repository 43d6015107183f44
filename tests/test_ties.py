"""Residuals that lie on a half of the last digit kept, against SQL."""

import duckdb

from tidemark.plans import catalog


def test_halves_are_rounded_as_in_sql(spark, tmp_path):
    """A price over 32 often has seven digits, the last a five; each is a year of its own here."""
    con = duckdb.connect()
    con.execute("create view part as select * from '/root/testdata/sf0.01/part.parquet'")
    con.execute("""create table lineitem as select * replace (make_timestamp(1600 + row_number() over (order by l_orderkey, l_linenumber), 5, 17, 0, 0, 0) as l_shipdate)
     from '/root/testdata/sf0.01/lineitem.parquet' where l_quantity = 32""")
    for t in ("part", "lineitem"):
        con.execute(f"copy (from {t}) to '{tmp_path}/{t}.parquet' (format parquet)")
    for name in ("point_weighted_year", "paired_stats"):
        want = con.execute(catalog.ORACLES[name])
        columns = [d[0] for d in want.description]
        got = catalog.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
