"""Token ids in ORC: stripes with run-length integers, row indexes and Bloom filters.

Documents are dealt into ranges of ``doc_id`` and sorted there, encoded, and written as one ORC file
for each range, so that files, stripes and rows ascend by ``doc_id``. Integer lists use ORC's
run-length encoding; a lookup by id is pruned by file and stripe statistics, row indexes and the
Bloom filter of ``doc_id``, and stripes are read in parallel.

Columns: ``part`` (number of the range), ``local_start`` (ids before the document in its range),
``doc_id``, ``n_tokens``, ``tokens``. A document's place in the whole corpus is ``local_start`` plus
the ids of all earlier ranges, a sum over one row for each range.

Defined results: a null or empty text has the end id alone; repeated ids are kept, ordered by text;
a null ``doc_id`` sorts first; an empty table gives an empty folder of that schema; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, small_batches
from .tokens import word_ids

END_ID = 2
SCHEMA = "part int, local_start long, doc_id long, n_tokens int, tokens array<int>"
#: Settings of ORC's writer: Bloom filter column and rate, stripe bytes, rows of a row index.
ORC = {
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
    "orc.stripe.size": str(64 << 20), "orc.row.index.stride": "5000", "compression": "zstd",
}


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Encode the whole texts of ``docs`` and write them to ``path`` in ascending ``doc_id`` order."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, begun = word_ids(tokenizer_path), TaskContext.get().partitionId(), 0
        for some in slices(batches):
            ids = [encoder.encode(x) + end for x in some.column(1).to_pylist()]
            sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            ends = np.cumsum(sizes)
            values = np.frombuffer(b"".join(ids), dtype="<i4")
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array(begun + ends - sizes), some.column(0), pa.array(sizes.astype(np.int32)), lists],
                names=["part", "local_start", "doc_id", "n_tokens", "tokens"],
            )
            begun += int(ends[-1])

    ranged = small_batches(docs).select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(encode, SCHEMA).write.options(**ORC).orc(path)


def read(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """The stored rows, or those of some documents by a filter that reaches ORC's indexes."""
    rows = small_batches(spark.read.schema(SCHEMA).orc(path))
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(list(doc_ids)))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        at, data = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        view = memoryview(np.ascontiguousarray(data, dtype="<i4")).cast("B")
        crc = np.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at).astype(np.int64)), pa.array(crc)], names=["part", "local_start", "doc_id", "n_tokens", "ids_crc32"])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every stored document, read back from the files."""
    rows = read(spark, path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("part").alias("of_part"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    sums = rows.select("part", "local_start", "doc_id", "tokens").mapInArrow(_sums, "part int, local_start long, doc_id long, n_tokens long, ids_crc32 long")
    return sums.join(bases, F.col("part") == F.col("of_part")).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
