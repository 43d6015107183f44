"""The zero-phase filters over arcs of any length: blocks of time side by side, states carried over block rows.

A filter is linear, so what a block leaves as the state after it is a matrix times the state before it,
plus what its own samples leave from rest; both passes are such maps, and so are the parts that a
line through the arc takes away. Each block is read once for its own part (``_summary``), the maps are
composed over one row a block (``_scan``), and each block is filtered from the states it then knows (``_finish``).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import highrate

#: Norm below which a power of the filter's matrix is nothing.
NOTHING = 1e-22


class _Filter:
    """A cascade of sections as a linear system with a state of two numbers a section.

    What a number of samples makes of a state, and of a line through them, are sums over powers of the
    system's matrix; they are tables by that number, which stand still after ``decay`` samples (4,096
    of them at 10 Hz, 5 MB).
    """

    def __init__(self, fs: float, cutoff: float, order: int, high: bool) -> None:
        self.sections = highrate.butterworth(fs, cutoff, order, high)
        self.size = order
        units = [self.run(np.zeros(1), e) for e in np.eye(order)]
        step, seen = np.column_stack([after for _, after in units]), np.array([y[0] for y, _ in units])
        powers = np.eye(order)[None]
        while np.abs(step).max() > NOTHING:  # step is here the matrix to the number of powers known
            powers, step = np.concatenate([powers, powers @ step]), step @ step
        self.decay = len(powers)
        self.powers = np.concatenate([powers, np.zeros((1, order, order))])
        taken = powers @ self.run(np.ones(1), np.zeros(order))[1]  # what a sample leaves after so many others
        sums = lambda terms: np.concatenate([np.zeros((1, *terms.shape[1:])), np.cumsum(terms, axis=0)])
        at = np.arange(self.decay, dtype=float)
        self.echoes = sums(taken[:, :, None] * (seen @ powers)[:, None, :])
        self.level, self.weighted = sums(taken), sums(taken * at[:, None])
        self.level_back, self.ramp_back = (sums(taken * self.run(x, np.zeros(order))[0][:, None]) for x in (np.ones(self.decay), at))

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y, after = highrate.cascade(self.sections, x, state.reshape(-1, 2))
        return y, after.ravel()

    def steady(self, level: float) -> np.ndarray:
        return highrate.steady(self.sections, level).ravel()

    def own(self, x: np.ndarray) -> np.ndarray:
        """States that samples leave from rest: after the forward pass, and after the backward pass over its output."""
        y, ahead = self.run(x, np.zeros(self.size))
        return np.r_[ahead, self.run(y[::-1], np.zeros(self.size))[1]]

    def power(self, n: int) -> np.ndarray:
        """What ``n`` samples make of a state."""
        return self.powers[min(n, self.decay)]

    def echo(self, n: int) -> np.ndarray:
        """State after the backward pass over what a state before ``n`` samples sends forward."""
        return self.echoes[min(n, self.decay)]

    def line(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """``own`` of ``n`` ones and of the numbers from 0."""
        k = min(n, self.decay)
        return np.r_[self.level[k], self.level_back[k]], np.r_[(n - 1) * self.level[k] - self.weighted[k], self.ramp_back[k]]


@lru_cache(maxsize=8)
def _filters(fs: float, cutoff: float, order: int) -> tuple[_Filter, _Filter]:
    return _Filter(fs, cutoff, order, True), _Filter(fs, cutoff, order, False)


_SUMMARY = "n long, finite boolean, total double, moment double, head array<double>, tail array<double>, own array<double>"
_STATES = "before long, mean double, slope double, states array<double>"


def filtered_blocks(
    df: DataFrame, segment: list[str], order: list[str], value: str, fs: float, width: float, cutoff: float = 0.1, poles: int = 6, kind: str = "single",
) -> DataFrame:
    """``(segment, order, value, filtered, ratio)`` as ``highrate.filtered`` gives, for arcs of any length.

    Samples are ordered by the columns ``order``, of which the first is a number that is time; ``width`` is
    the time of a block, chosen so that a block fits a task. Rows without a time are left out. Arcs
    that are too short or hold a missing value have nulls. Only one row a block of an arc meets in one task.
    """
    fields = [f for f in df.select(*segment, *order, value).schema]
    names = [f.name for f in fields]
    by = [f for f in fields if f.name in segment]
    block = T.StructField("_block", T.LongType())
    rows = df.select(*names).where(F.col(order[0]).isNotNull()).withColumn("_block", F.floor(F.col(order[0]) / width).cast("long"))
    least, pad = highrate.least_samples(kind, fs, cutoff, poles), 3 * (poles + 1)
    keys = [*segment, "_block"]

    def sorted_values(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in order]))
        return table, table[value].cast(pa.float64()).to_numpy(zero_copy_only=False)

    def summary(table: pa.Table) -> pa.Table:
        table, x = sorted_values(table)
        finite = bool(np.isfinite(x).all())
        own = np.concatenate([f.own(x) for f in _filters(fs, cutoff, poles)]) if finite else np.empty(0)
        total, moment = (float(x.sum()), float(np.arange(len(x)) @ x)) if finite else (0.0, 0.0)
        found = [pa.array([v]) for v in (len(x), finite, total, moment)] + [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (x[: pad + 1], x[-pad - 1 :], own)]
        return pa.table([*(table[c].slice(0, 1) for c in keys), *found], names=[*keys, *_names(_SUMMARY)])

    def scan(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("_block", "ascending")]))
        n = table["n"].to_numpy()
        size, before, count = int(n.sum()), np.r_[0, n.cumsum()[:-1]], len(n)
        mean, slope, states = np.nan, np.nan, None
        if size >= least and size > pad and pc.all(table["finite"]).as_py():
            total = table["total"].to_numpy()
            mean = total.sum() / size
            # about the middle of the arc, block by block
            from_middle = before - (size - 1) / 2
            slope = float((from_middle * (total - mean * n) + table["moment"].to_numpy() - mean * n * (n - 1) / 2).sum()) / (size * (size * size - 1.0) / 12)
            own = np.array(table["own"].to_pylist())
            head, tail = _ends(table["head"].to_pylist(), pad + 1), _ends([t[::-1] for t in table["tail"].to_pylist()[::-1]], pad + 1)[::-1]
            states = np.empty((count, 4 * poles))
            for k, f in enumerate(_filters(fs, cutoff, poles)):
                mine = own[:, 2 * poles * k : 2 * poles * (k + 1)].copy()
                first, last = head, tail
                if not k:  # the high pass is of what the arc's line leaves
                    at = np.arange(pad + 1) - (size - 1) / 2
                    first, last = head - mean - slope * at, tail - mean - slope * (at + size - pad - 1)
                    for j in range(count):
                        ones, ramp = f.line(int(n[j]))
                        mine[j] -= (mean + slope * from_middle[j]) * ones + slope * ramp
                states[:, 2 * poles * k : 2 * poles * (k + 1)] = _carried(f, n, mine, first, last)
        listed = pa.array([None] * count if states is None else states.tolist(), pa.list_(pa.float64()))
        found = [pa.array(before.astype(np.int64)), pa.array(np.full(count, mean), from_pandas=True), pa.array(np.full(count, slope), from_pandas=True), listed]
        # the line's zero is put at each block's first sample
        if states is not None:
            found[1] = pa.array(mean + slope * from_middle)
        return pa.table([*(table[c] for c in keys), *found], names=[*keys, *_names(_STATES)])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        table, x = sorted_values(left.select(names))
        high, ratio = np.full(len(x), np.nan), np.full(len(x), np.nan)
        given = right.slice(0, 1).to_pylist()[0]
        if given["states"] is not None:
            states = np.array(given["states"]).reshape(4, poles)
            made = []
            for k, (f, y) in enumerate(zip(_filters(fs, cutoff, poles), (x - given["mean"] - given["slope"] * np.arange(len(x)), x), strict=True)):
                ahead = f.run(y, states[2 * k])[0]
                made.append(f.run(ahead[::-1], states[2 * k + 1])[0][::-1])
            high, ratio = made[0], highrate.to_trend(x, made[1])
        return table.append_column("filtered", pa.array(high, from_pandas=True)).append_column("ratio", pa.array(ratio, from_pandas=True))

    summaries = rows.groupBy(*keys).applyInArrow(summary, T.StructType([*by, block, *T.StructType.fromDDL(_SUMMARY)]))
    states = summaries.groupBy(*segment).applyInArrow(scan, T.StructType([*by, block, *T.StructType.fromDDL(_STATES)]))
    out = T.StructType([*fields, T.StructField("filtered", T.DoubleType()), T.StructField("ratio", T.DoubleType())])
    return rows.groupBy(*keys).cogroup(states.groupBy(*keys)).applyInArrow(finish, out)


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _ends(parts: list[list[float]], most: int) -> np.ndarray:
    """The first ``most`` numbers of the parts."""
    out: list[float] = []
    for p in parts:
        out += p
        if len(out) >= most:
            break
    return np.array(out[:most])


def _carried(f: _Filter, n: np.ndarray, own: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """States before each block in the forward pass and, coming from its end, in the backward pass."""
    count, size = len(n), f.size
    ahead, back = np.empty((count, size)), np.empty((count, size))
    padding = 2 * first[0] - first[:0:-1]
    state = f.run(padding, f.steady(padding[0]))[1]
    for j in range(count):
        ahead[j] = state
        state = f.power(int(n[j])) @ state + own[j, :size]
    beyond = f.run(2 * last[-1] - last[-2::-1], state)[0][::-1]
    state = f.run(beyond, f.steady(beyond[0]))[1]
    for j in range(count - 1, -1, -1):
        back[j] = state
        state = f.power(int(n[j])) @ state + own[j, size:] + f.echo(int(n[j])) @ ahead[j]
    return np.concatenate([ahead, back], axis=1)
