"""Filters over blocks of an arc against the recursion over the whole arc."""

import numpy as np
import pytest

from tidemark.operators import highrate, long_arcs
from tidemark.plans import highrate as plans

from .test_highrate import recursion


def want(x, fs):
    t = np.arange(len(x)) - (len(x) - 1) / 2
    high = recursion(x - x.mean() - t * (t @ (x - x.mean())) / (t @ t), highrate.butterworth(fs, 0.1, 6, True))
    trend = recursion(x, highrate.butterworth(fs, 0.1, 6, False))
    return high, highrate.to_trend(x, trend)


def test_blocks_equal_the_recursion(spark):
    rng = np.random.default_rng(5)
    arcs = {"long": (np.sort(rng.choice(9000, 6000, replace=False)), 40 + rng.normal(size=6000).cumsum() / 9), "thin": (np.arange(110) * 40, rng.normal(size=110) + 9),
            "short": (np.arange(50), np.ones(50)), "hole": (np.arange(200), np.r_[np.ones(100), np.nan, np.ones(99)]), None: (np.arange(130) - 60, rng.normal(size=130) + 3)}
    rows = [(s, int(t), None if np.isnan(v) else float(v), 7) for s, (ts, vs) in arcs.items() for t, v in zip(ts, vs, strict=True)] + [("long", None, 1.0, 7)]
    rng.shuffle(rows)
    df = spark.createDataFrame([tuple(r) for r in rows], "s string, t long, v double, other int")
    for width in (100.0, 1000.0, 1e6):
        found = long_arcs.filtered_blocks(df, ["s"], ["t"], "v", 10.0, width)
        assert found.columns == ["s", "t", "v", "filtered", "ratio"]
        got = {}
        for r in found.orderBy("t").collect():
            got.setdefault(r.s, []).append((r.filtered, r.ratio))
        assert {s: len(v) for s, v in got.items()} == {s: len(v[0]) for s, v in arcs.items()}
        assert all(p == (None, None) for s in ("short", "hole") for p in got[s])
        for s in ("long", "thin", None):
            high, ratio = want(arcs[s][1], 10.0)
            assert [p[0] for p in got[s]] == pytest.approx(high, abs=1e-9)
            assert np.array([np.nan if p[1] is None else p[1] for p in got[s]]) == pytest.approx(ratio, abs=1e-9, nan_ok=True)
    assert long_arcs.filtered_blocks(df.where("t < -1000"), ["s"], ["t"], "v", 10.0, 100.0).count() == 0


@pytest.mark.parametrize("n", [1, 2, 40, 5000])
def test_tables_equal_runs(n):
    for f in long_arcs._filters(10.0, 0.1, 6):
        ones, ramp = f.line(n)
        assert ones == pytest.approx(f.own(np.ones(n)), abs=1e-9) and ramp == pytest.approx(f.own(np.arange(n, dtype=float)), abs=1e-6)
        unit = np.eye(6)[3]
        sent, after = f.run(np.zeros(n), unit)
        assert f.power(n) @ unit == pytest.approx(after, abs=1e-9) and f.echo(n) @ unit == pytest.approx(f.run(sent[::-1], np.zeros(6))[1], abs=1e-9)


def test_all_events_as_one_arc(spark):
    folder = "/root/testdata/sf0.01"
    x = np.array([r.value for r in plans.one_arc(spark, folder).orderBy("t", "event_id").collect()])
    high, ratio = want(x, 1.0)
    got = plans.long_arc_filtered(spark, folder).orderBy("t", "event_id").collect()
    assert len(got) == len(x) and [r.filtered for r in got] == pytest.approx(high, abs=2e-6)
    assert [r.ratio for r in got] == pytest.approx(ratio, abs=2e-6, nan_ok=True)


def test_arcs_are_cut_then_filtered(spark):
    folder = "/root/testdata/sf0.01"
    got = {(r.user_id, r.segment_id): r for r in plans.arcs_cut_and_filtered(spark, folder).collect()}
    arcs, last = {}, {}
    for r in plans.cut_samples(spark, folder).orderBy("user_id", "t", "event_id").collect():
        seen = last.get(r.user_id)
        number = -1 if seen is None else seen[1]
        if seen is None or r.t <= seen[0] or r.t - seen[0] > 4 * 86_400 or r.lost:
            number += 1
        last[r.user_id] = (r.t, number)
        arcs.setdefault((r.user_id, number), []).append(r.value)
    assert {k: len(v) for k, v in arcs.items()} == {k: r.n for k, r in got.items()}
    used = 0
    for k, v in arcs.items():
        if len(v) < 60:
            assert got[k].n_filtered == 0 and got[k].sigma is None
            continue
        used += 1
        assert got[k].sigma == pytest.approx(want(np.array(v), 1.0)[0].std(), abs=1e-5)
    assert used > 10
