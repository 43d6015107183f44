"""Filters, orbits and segmentation against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import highrate
from tidemark.plans import highrate as plans


def recursion(x, sections):
    """Forward and backward pass, sample by sample."""
    pad = 3 * (2 * len(sections) + 1)
    y = [*(2 * x[0] - x[pad:0:-1]), *x, *(2 * x[-1] - x[-2 : -pad - 2 : -1])]
    for _ in range(2):
        level = y[0]
        for b, a in sections:
            gain = sum(b) / sum(a)
            s, r = (b[1] + b[2] - (a[1] + a[2]) * gain) * level, (b[2] - a[2] * gain) * level
            out = []
            for v in y:
                o = b[0] * v + s
                s, r = b[1] * v - a[1] * o + r, b[2] * v - a[2] * o
                out.append(o)
            y, level = out, level * gain
        y = y[::-1]
    return np.array(y[pad:-pad])


@pytest.mark.parametrize("n", [60, 127, 128, 129, 700])
def test_zero_phase_filter(n):
    x = np.random.default_rng(n).normal(size=n).cumsum()
    for high in (True, False):
        sections = highrate.butterworth(10.0, 0.1, 6, high)
        assert highrate.zero_phase(x, sections) == pytest.approx(recursion(x, sections), abs=1e-9)


def test_filter_gains():
    gain = lambda s, f: abs(np.prod([(b[0] + b[1] / z + b[2] / z**2) / (a[0] + a[1] / z + a[2] / z**2) for b, a in s for z in [np.exp(2j * np.pi * f / 10)]]))
    high, low = (highrate.butterworth(10.0, 0.1, 6, h) for h in (True, False))
    assert gain(high, 0.1) == pytest.approx(math.sqrt(0.5)) and gain(low, 0.1) == pytest.approx(math.sqrt(0.5))
    assert gain(high, 0.01) < 1e-5 and gain(low, 1.0) < 1e-5 and gain(low, 1e-4) == pytest.approx(1)
    assert [highrate.least_samples(k, 10.0) for k in ("pair", "single", "check")] == [300, 100, 39]


def test_filtered_arcs_query(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.user_id: r for r in plans.filtered_arcs(spark, folder).collect()}
    arcs = {}
    for r in plans._arcs(spark, folder).orderBy("user_id", "event_id").collect():
        arcs.setdefault(r.user_id, []).append(r.value)
    used = 0
    for user, values in arcs.items():
        x, r = np.array(values), got[user]
        assert r.n == len(x)
        if len(x) < 60:
            assert (r.n_filtered, r.sigma) == (0, None)
            continue
        used += 1
        t = np.arange(len(x)) - (len(x) - 1) / 2
        high = recursion(x - x.mean() - t * (t @ (x - x.mean())) / (t @ t), highrate.butterworth(1.0, 0.1, 6, True))
        trend = recursion(x, highrate.butterworth(1.0, 0.1, 6, False))
        assert r.sigma == pytest.approx(high.std(), abs=1e-5) and r.mean_ratio == pytest.approx((x / trend)[trend > 0].mean(), abs=1e-5)
    assert used > 50


def dense_spline(t, y, q):
    """Second derivatives by a dense system: inner equations, and the third derivative goes on over the second and last but one point."""
    n, h = len(t), np.diff(t)
    a, b = np.zeros((n, n)), np.zeros(n)
    for k in range(1, n - 1):
        a[k, k - 1 : k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
        b[k] = 6 * ((y[k + 1] - y[k]) / h[k] - (y[k] - y[k - 1]) / h[k - 1])
    a[0, :3] = 1 / h[0], -1 / h[0] - 1 / h[1], 1 / h[1]
    a[-1, -3:] = 1 / h[-2], -1 / h[-2] - 1 / h[-1], 1 / h[-1]
    m = np.linalg.solve(a, b)
    k = np.clip(np.searchsorted(t, q, side="right") - 1, 0, n - 2)
    u, v = t[k + 1] - q, q - t[k]
    return (m[k] * u**3 + m[k + 1] * v**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * v


def test_orbit_query_against_a_dense_spline(spark):
    asked, orbits = plans.orbit_tables(spark, "/root/testdata/sf0.001")
    points = {}
    for r in orbits.orderBy("sv", "t").collect():
        points.setdefault(r.sv, []).append((r.t, r.x, r.y, r.z))
    got = plans.orbit_positions(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == asked.count()
    kinds = set()
    for r in got:
        p = np.array(points.get(r.sv, [])).reshape(-1, 4)
        t = p[:, 0]
        at = int(np.searchsorted(t, r.t))
        exact = at < len(t) and t[at] == r.t
        gap = t[at] - t[at - 1] if 0 < at < len(t) else None
        ok = len(t) >= 2 and (exact or (gap is not None and gap <= 1200))
        assert r.available == ok and (r.x is not None) == ok
        kinds.add((r.method, ok, exact))
        if ok:
            for k, v in enumerate((r.x, r.y, r.z), 1):
                want = p[at, k] if exact else dense_spline(t, p[:, k], np.array([r.t]))[0] if len(t) >= 4 else np.interp(r.t, t, p[:, k])
                assert v == pytest.approx(want, abs=0.5)
    assert {("cubic", True, False), ("cubic", False, False), ("linear", True, False), ("none", False, False)} <= kinds


@pytest.mark.parametrize("block", [7, 96])
def test_the_spline_is_that_over_all_epochs(spark, block):
    """Blocks of any size, days without epochs, distances of 1 s to days, repeated epochs, queries before, after and without."""
    rng = np.random.default_rng(5)
    step = np.where(rng.random(900) < 0.02, 200_000.0, np.where(rng.random(900) < 0.1, 1.0, 900.0))
    t = 1_600_000_000.0 + np.cumsum(step)
    y = np.column_stack([f(t / 6_856 + k) * 2.6e7 for k, f in enumerate((np.sin, np.cos, np.sin))])
    epochs = [("G1", float(a), *map(float, p)) for a, p in zip(t, y)]
    epochs += epochs[10:30] + [("G1", float(t[40]), 9e9, 0.0, 0.0), ("G1", None, 0.0, 0.0, 0.0), ("G2", 0.0, 1.0, 2.0, 3.0), ("G2", 400_000.0, 2.0, 3.0, 4.0), (None, 0.0, 1.0, 1.0, 1.0)]
    q = np.concatenate([rng.uniform(t[0] - 1e5, t[-1] + 1e5, 500), t[::50], (t[:-1] + t[1:])[::3] / 2])
    asked = [("G1", float(x)) for x in q] * 2 + [("G2", 1_000.0), ("G2", -1.0), ("G3", 5.0), ("G1", None), (None, 0.0)]
    frames = spark.createDataFrame(asked, "sv string, t double"), spark.createDataFrame(epochs, "sv string, t double, x double, y double, z double")
    got = highrate.orbit_positions(*frames, most_gap=1e9, block=block).collect()
    assert len(got) == len(asked)
    inside = (q >= t[0]) & (q <= t[-1])
    dense = np.column_stack([dense_spline(t - t[0], y[:, k], q[inside] - t[0]) for k in range(3)])
    want = dict(zip(q[inside].tolist(), dense.tolist()))
    for r in got:
        if r.sv == "G1":
            assert r.available == (r.t in want) and r.method == "cubic"
            if r.available and r.gap < 1e4:  # within a millimetre; across days without epochs it swings far out
                assert np.allclose((r.x, r.y, r.z), want[r.t], atol=1e-3, rtol=1e-11)
            elif r.available:
                assert np.allclose((r.x, r.y, r.z), want[r.t], rtol=1e-9, atol=1e-3 * max(map(abs, want[r.t])))
    rest = {(r.sv, r.t): (r.method, r.available, r.x) for r in got if r.sv != "G1"}
    assert rest["G2", 1_000.0] == ("linear", True, pytest.approx(1.0025)) and rest["G2", -1.0] == ("linear", False, None)
    assert rest["G3", 5.0] == ("none", False, None) and not rest[None, 0.0][1]
    empty = frames[1].limit(0)
    assert {r.available for r in highrate.orbit_positions(frames[0], empty).collect()} == {False} and highrate.orbit_positions(frames[0].limit(0), frames[1]).count() == 0


def test_slips_and_events(spark):
    steps = [0.0, 0.0, 0.0, 0.1, 0.0, 50.0, 0.0, 0.0, 0.0, 0.1, 0.0]
    rows = [("a", k, sum(steps[: k + 1])) for k in range(len(steps))] + [("b", k, float(k % 2) * 99) for k in range(4)]
    df = spark.createDataFrame(rows, "s string, t int, v double")
    got = {(r.s, r.t): r.segment_id for r in highrate.slip_segments(df, ["s"], ["t"], "v").collect()}
    dd = [rows[k + 2][2] - 2 * rows[k + 1][2] + rows[k][2] for k in range(len(steps) - 2)]
    cuts = {k + 1 for k, x in enumerate(dd) if abs(x - np.median(dd)) > max(1.0, 12 * 1.4826 * np.median(np.abs(np.array(dd) - np.median(dd))))}
    assert [got["a", k] for k in range(len(steps))] == [sum(c <= k for c in cuts) for k in range(len(steps))] and cuts
    assert {got["b", k] for k in range(4)} == {0}
    flags = spark.createDataFrame([("a", 0, None), ("a", 1, 1), ("a", 2, 0), ("a", 3, 2), ("a", 4, 4)], "s string, t int, lli int")
    zero, one, two = highrate.lli_bits(F.col("lli"))
    cut = highrate.event_segments(flags, ["s"], ["t"], [zero, one]).withColumn("two", two).orderBy("t").collect()
    assert [r.segment_id for r in cut] == [0, 1, 1, 2, 2] and cut[4].two
