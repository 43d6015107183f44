"""Helpers shared by the training-data operators: shared storage and column checks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
#: Bytes of a row group of stored tables; a writing task holds one in memory.
ROW_GROUP = 32 << 20

#: Most bytes of an Arrow batch of texts; the JVM holds a batch outside its heap, the Python worker a copy.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"

_held: dict[object, object] = {}


def _give_back() -> None:
    """Return freed memory to the system, so that a stage does not start on top of what the last one held."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def worker_cache(key: object, make: Callable[[], T]) -> T:
    """The cache of this Python process under ``key``; it outlives a task, but only one lives at a time.

    Workers are reused by all stages, so a stage's cache goes when another stage asks for its own.
    """
    if key not in _held:
        _held.clear()
        _give_back()
        _held[key] = make()
    return _held[key]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, in a session whose Arrow batches are bounded in bytes.

    By default a batch has 10,000 rows whatever their size. A batch still has one row at least, so
    whole texts pass. The setting stays, because a plan reads it when it runs.
    """
    conf = docs.sparkSession.conf
    now = int(conf.get(_BATCH_KEY).rstrip("b"))
    if now <= 0 or now > BATCH_BYTES:
        conf.set(_BATCH_KEY, str(BATCH_BYTES))
    return docs


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local run gets a temporary folder of its own; a cluster run is refused,
    because a machine-local folder there would lose or hide files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it back.

    This cuts the lineage with files that outlive any executor and keeps the rows' order and
    partitioning fixed for what follows.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as it takes to be no column of ``df``."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
