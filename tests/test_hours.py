"""Queries of hourly rows against their SQL on times around the start of 2024."""

import datetime
import random

import duckdb
import pytest

from tidemark.plans import catalog

TYPES = ("click", "error", "purchase", "signup", "view")


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    rng, folder = random.Random(3), tmp_path_factory.mktemp("hours")
    con = duckdb.connect()
    con.execute("create table e (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    zero = datetime.datetime(2024, 1, 1)
    rows = [(i, zero + datetime.timedelta(seconds=rng.randrange(-200_000, 200_000)), rng.randrange(30), rng.choice(TYPES), rng.randrange(9000) / 100, "") for i in range(4000)]
    con.executemany("insert into e values (?, ?, ?, ?, ?, ?)", rows)
    con.execute(f"copy e to '{folder}/events.parquet' (format parquet)")
    con.execute("create view events as from e")
    return str(folder), con


@pytest.mark.parametrize("name", ["elevation_fan_out", "three_hour_blocks", "top_links"])
def test_hours_before_2024(spark, data, name):
    folder, con = data
    found = catalog.QUERIES[name](spark, folder)
    want = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    rows = lambda x: sorted(map(repr, x))
    assert rows(tuple(r) for r in found.select(*columns).collect()) == rows(want.fetchall())
