"""Windows, sessions and arcs over streams of hourly files.

The batch rules keep their meaning: windows are aligned to UTC, an arc ends where the next sample is
more than a gap away, and arcs go on across file boundaries because their state is keyed by series,
not by file. Rows later than the watermark are dropped by Spark; zero-phase filters look both ways,
so they run on arcs that have closed (``closed_arcs``).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark.operators import highrate

ARC = "series string, arc long, first_us long, last_us long, n long, closed boolean"
_STATE = "arc long, first_us long, last_us long, n long"


def file_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files: int = 24) -> DataFrame:
    """Rows of Parquet files as they come into a folder, so many files in one batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)


def tumbling(stream: DataFrame, ts: str, width: str, late: str, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Aggregates of fixed windows, closed once the watermark has passed them."""
    grouped = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(*aggs)
    return grouped.select(F.col("w.start").alias("window_start"), *[c for c in grouped.columns if c != "w"])


def sessions(stream: DataFrame, ts: str, gap: str, late: str, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Aggregates of arcs as session windows: events of a key closer than ``gap`` belong together."""
    grouped = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*aggs)
    return grouped.select(F.col("w.start").alias("arc_start"), F.col("w.end").alias("arc_end"), *[c for c in grouped.columns if c != "w"])


def first_wins(stream: DataFrame, ts: str, late: str, keys: list[str]) -> DataFrame:
    """One row of each key while the watermark remembers it."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def arcs(stream: DataFrame, series: str, micros: str, gap_us: int) -> DataFrame:
    """``(series, arc, first_us, last_us, n, closed)`` as arcs change: closed ones and the open one of each batch.

    The state of a series is its open arc, four numbers, whatever the files were. Samples not after
    the arc's last one are repeats or late and count in no arc. A series' samples of one batch are read
    in Arrow batches of bounded rows and sorted there; batches hold some hours of files.
    """

    def follow(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        arc, first, last, n = state.get if state.exists else (-1, 0, 0, 0)
        times = pd.concat([f["t"] for f in frames]).sort_values()
        out: list[tuple] = []
        for t in times.tolist():
            if n and t <= last:
                continue
            if not n or t - last > gap_us:
                if n:
                    out.append((key[0], arc, first, last, n, True))
                arc, first, n = arc + 1, t, 0
            last, n = t, n + 1
        state.update((arc, first, last, n))
        if n:
            out.append((key[0], arc, first, last, n, False))
        yield pd.DataFrame(out, columns=["series", "arc", "first_us", "last_us", "n", "closed"])

    rows = stream.where(F.col(series).isNotNull() & F.col(micros).isNotNull()).select(F.col(series).cast("string").alias("series"), F.col(micros).cast("long").alias("t"))
    return rows.groupBy("series").applyInPandasWithState(follow, ARC, _STATE, "update", "NoTimeout")


FILTERED = "series string, arc_begin_us long, t_us long, value double, filtered double, ratio double"


class _Closing(StatefulProcessor):
    """Samples of a series until their arc is over: a list of them, and one timer, not after the time at which the first arc may be over.

    Each call on the state is a round trip to the JVM, so a batch of a series takes two or four of them whatever its arcs are.
    """

    def __init__(self, gap_us: int, fs: float, cutoff: float, order: int, least: int) -> None:
        self.gap, self.filter = gap_us, (fs, cutoff, order, least)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getListState("samples", "t long, value double")
        self.timer = handle.getValueState("timer", "at long")

    def _closes(self, last: int) -> int:
        """Milliseconds at which nothing can go on an arc that ends with ``last``."""
        return (last + self.gap) // 1000 + 1

    def _wait(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames = [f for f in rows if len(f)]
        if key[0] is None or not frames:
            return iter(())
        for frame in frames:
            self.samples.appendList([(t, None if v != v else v) for t, v in zip(frame["t"].tolist(), frame["value"].tolist(), strict=True)])
        times = np.sort(np.concatenate([f["t"].to_numpy() for f in frames]))
        ends = times[:-1][np.diff(times) > self.gap]
        at = self._closes(int(ends[0] if len(ends) else times[-1]))
        known = self.timer.get()
        if known is None or at < known[0]:
            if known is not None:
                self.handle.deleteTimer(known[0])
            self._wait(at)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        over = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        held = sorted(((r[0], r[1]) for r in self.samples.get()), key=lambda r: (r[0], r[1] is None, r[1] or 0.0))
        if not held:
            return iter(())
        times = np.array([r[0] for r in held], dtype=np.int64)
        first = np.r_[True, np.diff(times) > 0]
        times, values = times[first], np.array([np.nan if r[1] is None else r[1] for r in held])[first]
        cuts = np.flatnonzero(np.diff(times) > self.gap) + 1
        arcs, rest = [], 0
        for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(times)].tolist(), strict=True):
            at = self._closes(int(times[b - 1]))
            if at > over:
                self._wait(at)
                break
            arcs.append((np.full(b - a, times[a]), *highrate.high_and_ratio(values[a:b], *self.filter)))
            rest = b
        if rest == len(times):
            self.samples.clear()
            self.timer.clear()
        elif rest:
            self.samples.put([(t, None if v != v else v) for t, v in zip(times[rest:].tolist(), values[rest:].tolist(), strict=True)])
        if not rest:
            return iter(())
        begins, high, ratio = map(np.concatenate, zip(*arcs, strict=True))
        return iter([pd.DataFrame({"series": pd.Series([key[0]] * rest, dtype=object), "arc_begin_us": begins, "t_us": times[:rest], "value": values[:rest], "filtered": high, "ratio": ratio})])

    def close(self) -> None:
        pass


def closed_arcs(stream: DataFrame, at: str, series: str, micros: str, value: str, gap_us: int, late: str, fs: float, cutoff: float = 0.1, order: int = 6, kind: str = "single") -> DataFrame:
    """Rows of ``FILTERED``: the samples of each arc once it has closed, with the zero-phase filters of ``highrate.filtered``.

    ``at`` is the sample's time as a timestamp for the watermark, ``micros`` the same time as microseconds since 1970.
    An arc is over when the watermark has passed its last sample by more than ``gap_us``, so no
    sample can follow it; its rows are then emitted, all at once and only once, and its state is
    removed. A series that still has an open arc keeps that arc's samples alone. Of samples of one
    time the smallest value stays. Rows without a series, or without a time, only move the watermark.
    State is kept in RocksDB: run it within ``state_in_rocksdb``.
    """
    rows = stream.withWatermark(at, late).select(F.col(series).cast("string").alias("series"), F.col(micros).cast("long").alias("t"), F.col(value).cast("double").alias("value"), F.col(at).alias("at"))
    keyed = rows.select(F.when(F.col("t").isNotNull(), F.col("series")).alias("series"), F.coalesce("t", F.lit(0)).alias("t"), "value", "at")
    closing = _Closing(gap_us, fs, cutoff, order, highrate.least_samples(kind, fs, cutoff, order))
    return keyed.groupBy("series").transformWithStateInPandas(closing, StructType.fromDDL(FILTERED), "append", "eventTime")


@contextmanager
def state_in_rocksdb(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, in so many partitions; the session's own settings come back afterwards.

    A stream keeps its number of partitions for life, so choose it by the cores that will serve it.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if partitions is not None:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def run_to_table(stream: DataFrame, path: str, mode: str) -> DataFrame:
    """Process all files that are there, store each batch's rows with its number under ``path`` and read them back.

    A batch that is run again after a failure replaces its own folder, so rows stand once.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()
    return stream.sparkSession.read.option("basePath", f"{path}/rows").schema(StructType([*stream.schema.fields, *_BATCH])).parquet(f"{path}/rows")


_BATCH = StructType().add("batch", "long").fields


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row of its last batch."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return found.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
