"""Streams over several files against the batch rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import highrate
from tidemark.streaming import windows as st

SCHEMA = "s string, t long, v double"


def hours(spark, folder, rows, parts):
    """Files in order of time, so that arcs cross their borders."""
    rows = sorted(rows, key=lambda r: r[1])
    for k in range(parts):
        some = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/h{k:02d}.parquet")
    return st.file_stream(spark, f"{folder}/in/*", spark.createDataFrame([], SCHEMA).schema, files=1)


def test_arcs_go_on_across_files(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"g{k % 3}", rng.randrange(4000), 1.0) for k in range(300)] + [("g0", 5, 1.0), (None, 3, 1.0), ("g1", None, 1.0)]
    stream = hours(spark, tmp_path, [r for r in rows if r[1] is not None], 5)
    found = st.run_to_table(st.arcs(stream, "s", "t", 60), f"{tmp_path}/out", "update")
    got = {(r.series, r.arc): (r.first_us, r.last_us, r.n) for r in st.latest(found, ["series", "arc"]).collect()}
    want = {}
    for s in ("g0", "g1", "g2"):
        times, arc = sorted({t for g, t, _ in rows if g == s and t is not None}), -1
        for k, t in enumerate(times):
            if not k or t - times[k - 1] > 60:
                arc += 1
                want[s, arc] = (t, t, 0)
            want[s, arc] = (want[s, arc][0], t, want[s, arc][2] + 1)
    assert got == want and found.select("batch").distinct().count() == 5


def test_windows_and_repeats(spark, tmp_path):
    rows = [(f"g{k % 2}", 3600 + 10 * k, float(k)) for k in range(100)]
    stream = hours(spark, tmp_path, rows, 4).withColumn("at", F.timestamp_seconds("t"))
    counts = st.tumbling(stream, "at", "60 seconds", "5 minutes", ["s"], [F.count("*").alias("n"), F.sum("v").alias("total")])
    got = st.latest(st.run_to_table(counts, f"{tmp_path}/w", "update"), ["window_start", "s"])
    batch = spark.createDataFrame(rows, SCHEMA).groupBy((F.floor(F.col("t") / 60) * 60).alias("w"), "s").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    assert sorted((r.window_start.timestamp(), r.s, r.n, r.total) for r in got.collect()) == sorted((float(r.w), r.s, r.n, r.total) for r in batch.collect())
    again = st.first_wins(stream.union(stream), "at", "1 hour", ["s", "t"])
    assert st.run_to_table(again, f"{tmp_path}/d", "append").count() == 100


def test_arcs_are_filtered_once_they_close(spark, tmp_path):
    rng, second = random.Random(8), 1_000_000
    arcs = {"a": [(0, 300), (500, 700), (2000, 2300)], "b": [(100, 2500)], "c": [(1500, 1530)]}
    rows = [(s, t * second, rng.random() + 3) for s, spans in arcs.items() for lo, hi in spans for t in range(lo, hi) if t % 17]
    rows += [("a", 5 * second, 99.0), (None, 40 * second, 1.0), (None, 9000 * second, 0.0)]
    stream = hours(spark, tmp_path, rows, 6).withColumn("at", F.timestamp_micros("t"))
    closed = st.closed_arcs(stream, "at", "s", "t", "v", 100 * second, "60 seconds", 1.0)
    with st.state_in_rocksdb(spark):
        found = st.run_to_table(closed, f"{tmp_path}/out", "append")
    got, batches = {}, {}
    for r in found.orderBy("t_us").collect():
        got.setdefault((r.series, r.arc_begin_us), []).append((r.t_us, r.value, r.filtered, r.ratio))
        batches.setdefault((r.series, r.arc_begin_us), set()).add(r.batch)
    want = {}
    for s, spans in arcs.items():
        for lo, hi in spans:
            samples = sorted({t: v for g, t, v in reversed(rows) if g == s and lo * second <= t < hi * second}.items())
            want[s, samples[0][0]] = (samples, highrate.high_and_ratio(np.array([v for _, v in samples]), 1.0, 0.1, 6, 60))
    assert set(got) == set(want)
    for k, (samples, (high, ratio)) in want.items():
        assert [p[:2] for p in got[k]] == samples and len(batches[k]) == 1
        for at, expected in ((2, high), (3, ratio)):
            assert np.array([np.nan if p[at] is None else p[at] for p in got[k]]) == pytest.approx(expected, abs=1e-9, nan_ok=True)
    assert len(set().union(*batches.values())) > 1
    left = spark.read.format("statestore").option("stateVarName", "samples").load(f"{tmp_path}/out/checkpoint")
    assert left.count() == 0


def test_a_batch_of_a_series_takes_few_calls_on_its_state():
    calls, kept, timers = [], {"samples": [], "timer": None}, set()

    class Kept:
        def __init__(self, name): self.name = name
        def get(self): calls.append("get"); return iter(kept["samples"]) if self.name == "samples" else kept["timer"]
        def exists(self): calls.append("exists"); return bool(kept[self.name])
        def appendList(self, rows): calls.append("append"); kept["samples"] += rows
        def put(self, rows): calls.append("put"); kept["samples"] = list(rows)
        def update(self, row): calls.append("update"); kept["timer"] = row
        def clear(self): calls.append("clear"); kept[self.name] = [] if self.name == "samples" else None

    class Handle:
        def getListState(self, *_): return Kept("samples")
        def getValueState(self, *_): return Kept("timer")
        def registerTimer(self, at): calls.append("register"); timers.add(at)
        def deleteTimer(self, at): calls.append("delete"); timers.discard(at)

    class At:
        def __init__(self, ms): self.ms = ms
        def getExpiryTimeInMs(self): return self.ms
        def getCurrentWatermarkInMs(self): return 10_000

    closing = st._Closing(1_000_000, 1.0, 0.1, 6, 60)
    closing.init(Handle())
    arcs = [[k * 3_000_000, k * 3_000_000 + 500_000] for k in range(20)]
    frame = st.pd.DataFrame({"t": sum(arcs, [])[::-1], "value": 1.0})
    list(closing.handleInputRows(("a",), iter([frame]), At(0)))
    assert timers == {1501} and len(calls) <= 4
    calls.clear()
    (out,) = closing.handleExpiredTimer(("a",), At(0), At(timers.pop()))
    assert out["t_us"].tolist() == sum(arcs[:3], []) and out["arc_begin_us"].nunique() == 3
    assert [r[0] for r in kept["samples"]] == sum(arcs[3:], []) and timers == {10_501} and len(calls) <= 4
