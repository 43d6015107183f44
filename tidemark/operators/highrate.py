"""High-rate series: segmentation by events and slips, detrending, filters, orbits, carrier pairing.

Everything but the filters and the orbit spline is column expressions and windows by series; those two
get one arc or one block of a satellite's epochs as Arrow and use numpy there.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.geodesy import cycles_to_metres

from .segments import in_order

#: Samples that the filter takes in one matrix product.
BLOCK = 128


def relative_gaps(df: DataFrame, series: list[str], order: list[str], time: str, factor: float = 2.5) -> DataFrame:
    """Adds ``dt``, the series' median positive step and ``gap``: dt null, not positive or over ``factor`` steps."""
    d = df.withColumn("dt", F.col(time) - F.lag(time).over(in_order(series, order)))
    d = d.withColumn("nominal", F.percentile(F.when(F.col("dt") > 0, F.col("dt")), 0.5).over(Window.partitionBy(*series)))
    return d.withColumn("gap", F.coalesce((F.col("dt") <= 0) | (F.col("dt") > factor * F.col("nominal")), F.lit(True)))


def lli_bits(lli: Column) -> tuple[Column, Column, Column]:
    """Bits 0, 1 and 2 of a loss-of-lock indicator as booleans; null has none."""
    value = F.coalesce(lli.cast("int"), F.lit(0))
    return tuple(value.bitwiseAND(F.lit(1 << k)) != 0 for k in range(3))


def event_segments(df: DataFrame, series: list[str], order: list[str], flags: list[Column]) -> DataFrame:
    """Adds ``segment_id`` from 0: a row at which any flag holds starts a segment, and so does a series' first row."""
    w = in_order(series, order)
    starts = F.row_number().over(w) == 1
    for f in flags:
        starts = starts | F.coalesce(f, F.lit(False))
    marked = df.withColumn("_starts", starts.cast("int"))
    return marked.withColumn("segment_id", F.sum("_starts").over(w) - 1).drop("_starts")


def slip_segments(df: DataFrame, series: list[str], order: list[str], value: str, floor: float = 1.0, factor: float = 12.0) -> DataFrame:
    """Adds ``segment_id``: the row before a second difference far from the median starts a segment.

    Far is over max(floor, factor * 1.4826 * MAD); a series with fewer than five of them is not cut.
    """
    w, own = in_order(series, order), Window.partitionBy(*series)
    d = df.withColumn("_dd", F.col(value) - 2 * F.lag(value, 1).over(w) + F.lag(value, 2).over(w))
    d = d.withColumn("_mid", F.percentile("_dd", 0.5).over(own)).withColumn("_n", F.count("_dd").over(own))
    d = d.withColumn("_mad", F.percentile(F.abs(F.col("_dd") - F.col("_mid")), 0.5).over(own))
    far = (F.col("_n") >= 5) & (F.abs(F.col("_dd") - F.col("_mid")) > F.greatest(F.lit(floor), factor * 1.4826 * F.col("_mad")))
    d = d.withColumn("_slip", F.coalesce(F.lead(far).over(w), F.lit(False)))
    return event_segments(d, series, order, [F.col("_slip")]).drop("_dd", "_mid", "_n", "_mad", "_slip")


def window_events(df: DataFrame, keys: list[str], lli: Column, jump: Column, epoch_flag: Column, edge: Column, guard: float) -> DataFrame:
    """Counts of events in each window, its least edge distance and whether it is near one (true if none is known)."""
    zero, one, _ = lli_bits(lli)
    least = F.min(edge)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(zero).alias("lli0"), F.count_if(one).alias("lli1"), F.count_if(jump).alias("jumps"),
        F.count_if(epoch_flag != 0).alias("epoch_flags"), least.alias("least_edge"), F.coalesce(least <= guard, F.lit(True)).alias("near_edge"))


def detrended(df: DataFrame, segment: list[str], time: str, value: str) -> DataFrame:
    """Adds ``detrended``: the value less its segment's line, fitted on centred time; less the mean if time stands still."""
    own = Window.partitionBy(*segment)
    t, v = F.col(time).cast("double"), F.col(value)
    d = df.withColumn("_t", t - F.avg(t).over(own)).withColumn("_v", v - F.avg(v).over(own))
    slope = F.try_divide(F.sum(F.expr("_t * _v")).over(own), F.nullif(F.sum(F.expr("_t * _t")).over(own), F.lit(0.0)))
    return d.withColumn("detrended", F.col("_v") - F.coalesce(slope, F.lit(0.0)) * F.col("_t")).drop("_t", "_v")


def least_samples(kind: str, fs: float, cutoff: float = 0.1, order: int = 6) -> int:
    """Shortest segment that a filter takes: ``pair`` (geometry-free), ``single`` (one frequency) or ``check``."""
    return {"pair": max(30, math.ceil(fs * 3 / cutoff)), "single": max(60, int(10 * fs)), "check": max(30, 3 * (2 * order + 1))}[kind]


# --- filters --------------------------------------------------------------------------------------


def butterworth(fs: float, cutoff: float, order: int, high: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections (b, a) of an even-order Butterworth filter by the bilinear transform."""
    if order % 2 or not 0 < cutoff < fs / 2:
        raise ValueError("an even order and a cutoff below half the rate")
    k = math.tan(math.pi * cutoff / fs)
    out = []
    for n in range(order // 2):
        damping = 2 * math.sin(math.pi * (2 * n + 1) / (2 * order))
        scale = 1 / (1 + k * damping + k * k)
        b = np.array([1.0, -2.0, 1.0]) * scale if high else np.array([1.0, 2.0, 1.0]) * k * k * scale
        out.append((b, np.array([1.0, 2 * (k * k - 1) * scale, (1 - k * damping + k * k) * scale])))
    return out


@lru_cache(maxsize=64)
def _matrices(b: tuple[float, ...], a: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a section and a block: the response to its samples, to the state before it, and what both leave as later states."""
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    into = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    powers = [np.eye(2)]
    for _ in range(BLOCK):
        powers.append(step @ powers[-1])
    seen = np.array([p[0] for p in powers[:BLOCK]])
    impulse = np.r_[b[0], [p[0] @ into for p in powers[: BLOCK - 1]]]
    lags = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
    response = np.where(lags >= 0, impulse[np.maximum(lags, 0)], 0.0)
    moved = np.array([powers[BLOCK - 1 - k] @ into for k in range(BLOCK)])
    return response, seen, np.array(powers), moved


def section(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One section over ``x`` from a state, and the state after it: within a block the response is a matrix, between blocks the state moves on."""
    response, seen, powers, moved = _matrices(tuple(b.tolist()), tuple(a.tolist()))
    blocks = np.pad(x, (0, -len(x) % BLOCK)).reshape(-1, BLOCK)
    states, added = np.empty((len(blocks), 2)), blocks @ moved
    for k in range(len(blocks)):
        states[k] = state
        state = powers[BLOCK] @ state + added[k]
    rest = len(x) % BLOCK
    if rest:
        state = powers[rest] @ states[-1] + blocks[-1, :rest] @ moved[BLOCK - rest :]
    return (blocks @ response.T + states @ seen.T).ravel()[: len(x)], state


def steady(sections: list[tuple[np.ndarray, np.ndarray]], level: float) -> np.ndarray:
    """States of the sections (a row each) after a constant input that has always been there."""
    out = []
    for b, a in sections:
        gain = b.sum() / a.sum()
        out.append(np.array([b[1] + b[2] - (a[1] + a[2]) * gain, b[2] - a[2] * gain]) * level)
        level *= gain
    return np.array(out)


def cascade(sections: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All sections over ``x`` one after the other, from their states, and the states after it."""
    after = np.empty((len(sections), 2))
    for k, (b, a) in enumerate(sections):
        x, after[k] = section(b, a, x, states[k])
    return x, after


def zero_phase(x: np.ndarray, sections: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Forward and backward pass with odd padding and steady initial states; ``x`` is longer than the padding."""
    pad = 3 * (2 * len(sections) + 1)
    if len(x) <= pad:
        raise ValueError(f"more than {pad} samples are needed")
    y = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]
    for _ in range(2):
        y = cascade(sections, y, steady(sections, y[0]))[0][::-1]
    return y[pad:-pad]


def high_and_ratio(x: np.ndarray, fs: float, cutoff: float, order: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Zero-phase high pass of the detrended values of an arc, and values by their low-pass trend; NaN where there is none."""
    high, ratio = np.full(len(x), np.nan), np.full(len(x), np.nan)
    if len(x) >= least and len(x) > 3 * (order + 1) and np.isfinite(x).all():
        t = np.arange(len(x)) - (len(x) - 1) / 2
        centred = x - x.mean()
        high = zero_phase(centred - t * (t @ centred) / (t @ t), butterworth(fs, cutoff, order, True))
        ratio = to_trend(x, zero_phase(x, butterworth(fs, cutoff, order, False)))
    return high, ratio


def to_trend(x: np.ndarray, trend: np.ndarray) -> np.ndarray:
    return np.where(trend > 0, x / np.where(trend > 0, trend, 1.0), np.nan)


def filtered(df: DataFrame, segment: list[str], order_by: str, value: str, fs: float, cutoff: float = 0.1, order: int = 6, kind: str = "single") -> DataFrame:
    """``(segment, order_by, value, filtered, ratio)``: zero-phase high pass of the detrended value, and value by low-pass trend.

    An arc is one group: its length is bounded by how long a satellite is in view (``long_arcs.filtered_blocks``
    takes arcs of any length). Arcs that are too
    short or hold a missing value have nulls, and so has a ratio to a trend that is not positive.
    """
    keys = [f for f in df.select(*segment, order_by, value).schema]
    schema = T.StructType([*keys, T.StructField("filtered", T.DoubleType()), T.StructField("ratio", T.DoubleType())])
    least = least_samples(kind, fs, cutoff, order)

    def arc(table: pa.Table) -> pa.Table:
        table = table.select([k.name for k in keys])
        table = table.take(pc.sort_indices(table, sort_keys=[(order_by, "ascending")]))
        x = table[value].cast(pa.float64()).to_numpy(zero_copy_only=False)
        high, ratio = high_and_ratio(x, fs, cutoff, order, least)
        return table.append_column("filtered", pa.array(high, from_pandas=True)).append_column("ratio", pa.array(ratio, from_pandas=True))

    return df.select(*segment, order_by, value).groupBy(*segment).applyInArrow(arc, schema)


# --- orbits ---------------------------------------------------------------------------------------


def spline(t: np.ndarray, y: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cubic spline through the points with not-a-knot ends (four points or more), at ``q`` inside the range."""
    n, h = len(t), np.diff(t)
    slope = np.diff(y, axis=0) / h[:, None]
    a, rhs = np.zeros((3, n)), np.zeros_like(y)  # bands of the system for second derivatives at inner points
    inner = np.arange(1, n - 1)
    a[0, 2:], a[1, 1:-1], a[2, :-2] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    rhs[inner] = 6 * (slope[1:] - slope[:-1])
    # a third derivative that goes on over the second and the last but one point expresses the ends by their neighbours
    a[1, 1] += h[0] * (h[0] + h[1]) / h[1]
    a[0, 2] -= h[0] * h[0] / h[1]
    a[1, n - 2] += h[-1] * (h[-1] + h[-2]) / h[-2]
    a[2, n - 3] -= h[-1] * h[-1] / h[-2]
    m = np.zeros_like(y)
    upper, solved = np.zeros(n), np.zeros_like(y)
    for k in range(1, n - 1):
        below = a[2, k - 1] if k > 1 else 0.0
        pivot = a[1, k] - below * upper[k - 1]
        upper[k] = a[0, k + 1] / pivot if k < n - 2 else 0.0
        solved[k] = (rhs[k] - below * solved[k - 1]) / pivot
    for k in range(n - 2, 0, -1):
        m[k] = solved[k] - upper[k] * m[k + 1]
    m[0] = ((h[0] + h[1]) * m[1] - h[0] * m[2]) / h[1]
    m[-1] = ((h[-1] + h[-2]) * m[-2] - h[-1] * m[-3]) / h[-2]
    at = np.clip(np.searchsorted(t, q, side="right") - 1, 0, n - 2)
    left, right, w = (t[at + 1] - q)[:, None], (q - t[at])[:, None], h[at][:, None]
    return (m[at] * left**3 + m[at + 1] * right**3) / (6 * w) + (y[at] / w - m[at] * w / 6) * left + (y[at + 1] / w - m[at + 1] * w / 6) * right


ORBIT = "sv string, t double, x double, y double, z double, nearest double, gap double, method string, available boolean"


#: Epochs that a block has beyond its own on either side. A change of the spline's second derivative at an epoch is at
#: least halved from each epoch to the next, whatever their distances, so a block's ends weigh 2 ** -64 at most inside.
HALO = 64


def orbit_positions(queries: DataFrame, orbits: DataFrame, most_gap: float = 1200.0, day: float = 86_400.0, block: int = 96) -> DataFrame:
    """Positions of satellites ``(sv, t)`` from epochs ``(sv, t, x, y, z)``: spline, or lines below four epochs; no extrapolation.

    A query between epochs more than ``most_gap`` apart has none; one at an epoch has the epoch's own.
    Of equal epochs the one of least coordinates counts; an epoch without a time counts for nothing.
    The spline is that over all epochs of a satellite: epochs are numbered from counts of days and cut into
    blocks of ``block``, each with ``HALO`` epochs around it, so no group grows with the archive.
    """
    known = orbits.where("t is not null").groupBy("sv", "t").agg(F.min(F.struct("x", "y", "z")).alias("p"))
    rows = known.select("sv", "t", "p", F.lit(0).alias("asked")).unionByName(queries.select("sv", "t", F.lit(1).alias("asked")), allowMissingColumns=True)
    rows = rows.withColumn("day", F.floor(F.col("t") / day))
    before = Window.partitionBy("sv").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy("sv", "day").agg(F.sum(1 - F.col("asked")).alias("n"))
    days = days.select(F.col("sv").alias("of_sv"), F.col("day").alias("of_day"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy("sv")).alias("total"))
    upto = Window.partitionBy("sv", "day").orderBy("t", "asked").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("upto", F.sum(1 - F.col("asked")).over(upto))
    numbered = numbered.join(days, F.col("sv").eqNullSafe(F.col("of_sv")) & F.col("day").eqNullSafe(F.col("of_day")))
    at = F.col("base") + F.col("upto") - 1  # number of the last epoch that is not after the row
    last = F.greatest(F.floor((F.col("total") - 1) / block), F.lit(0))
    of = lambda k: F.least(F.greatest(F.floor(k / block), F.lit(0)), last)
    known = numbered.where("asked = 0").select(F.col("sv").alias("sv"), F.col("t").alias("t"), "p.*", F.explode(F.sequence(of(at - HALO), of(at + HALO))).alias("block"))
    asked = numbered.where("asked = 1").select("sv", "t", of(at).alias("block"))

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        q = left["t"].to_numpy()
        n = len(q)
        names = ["t", "x", "y", "z"]
        points = np.column_stack([right[c].to_numpy() for c in names]) if right.num_rows else np.empty((0, 4))
        points = points[np.argsort(points[:, 0], kind="stable")]
        points = points[np.unique(points[:, 0], return_index=True)[1]] if len(points) else points
        t, xyz = points[:, 0], points[:, 1:]
        out, nearest, gap = np.full((n, 3), np.nan), np.full(n, np.nan), np.full(n, np.nan)
        ok, method = np.zeros(n, dtype=bool), "none"
        if len(t) >= 2:
            method = "cubic" if len(t) >= 4 else "linear"
            right_at = np.searchsorted(t, q)
            bracket = (right_at > 0) & (right_at < len(t))
            inside = (q >= t[0]) & (q <= t[-1])
            if inside.any():
                out[inside] = spline(t, xyz, q[inside]) if len(t) >= 4 else np.column_stack([np.interp(q[inside], t, xyz[:, k]) for k in range(3)])
            r = right_at[bracket]
            gap[bracket] = t[r] - t[r - 1]
            nearest[bracket] = np.minimum(q[bracket] - t[r - 1], t[r] - q[bracket])
            within = np.minimum(right_at, len(t) - 1)
            exact = np.abs(t[within] - q) <= 1e-6
            out[exact], nearest[exact] = xyz[within[exact]], 0.0
            gap[exact & (right_at == 0)] = 0.0
            ok = np.isfinite(out).all(axis=1) & (exact | (bracket & (gap <= most_gap)))
            out[~ok] = np.nan
        columns = [left["sv"], left["t"], *(pa.array(out[:, k], from_pandas=True) for k in range(3)), pa.array(nearest, from_pandas=True), pa.array(gap, from_pandas=True), pa.array([method] * n, pa.string()), pa.array(ok)]
        return pa.table(columns, names=["sv", "t", "x", "y", "z", "nearest", "gap", "method", "available"])

    return asked.groupBy("sv", "block").cogroup(known.groupBy("sv", "block")).applyInArrow(one, ORBIT)


# --- carriers -------------------------------------------------------------------------------------


def geometry_free(obs: DataFrame) -> DataFrame:
    """``(sv, epoch, obs_a, obs_b, gf_m, conflicts)`` of long phases ``(sv, epoch, carrier, obs, cycles, hz)``.

    The first observable seen of a satellite's carrier stays its choice; other observables of that
    carrier are conflicts, counted by satellite. Rows pair at the same epoch, in metres.
    """
    w = Window.partitionBy("sv", "carrier").orderBy("epoch", "obs").rowsBetween(Window.unboundedPreceding, 0)
    known = obs.where("cycles is not null").withColumn("_kept", F.first("obs").over(w)).withColumn("metres", cycles_to_metres(F.col("cycles"), F.col("hz")))
    conflicts = known.groupBy("sv").agg(F.count_if(F.col("obs") != F.col("_kept")).alias("conflicts"))
    chosen = known.where(F.col("obs") == F.col("_kept")).groupBy("sv", "epoch").agg(*[
        F.max(F.when(F.col("carrier") == c, F.col(v))).alias(f"{v}_{c}") for c in ("a", "b") for v in ("obs", "metres")])
    paired = chosen.where("metres_a is not null and metres_b is not null")
    return paired.join(conflicts, "sv").select("sv", "epoch", "obs_a", "obs_b", (F.col("metres_a") - F.col("metres_b")).alias("gf_m"), "conflicts")

