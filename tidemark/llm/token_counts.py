"""Token counts by a map-side lookup in two tiers.

A first pass keeps the most frequent words of each partition and merges these bounded summaries into
one table of frequent words, whose token counts are broadcast. In the second pass each document sums
the counts of its pre-token runs from that table; misses go through a bounded cache of the worker
and are encoded there. Pre-tokens are never shuffled: what leaves a task of the first pass is
``per_task`` rows at most.

Defined results: a null text counts as empty; a null ``doc_id`` stays null; repeated rows and ids all get a row; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, worker_cache
from .tokens import CACHE_CHARS, TieredCounts

LIMIT = 1024
#: Size bounds of the broadcast table and of one task's summary.
FREQUENT = 16_384
PER_TASK = 4_096
#: Words that a summary counts before it drops the rarest.
HELD = 200_000


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            if text:
                seen.update(text.split(" "))
                if len(seen) > 2 * HELD:
                    seen = Counter(dict(seen.most_common(HELD)))
    top = [(w, n) for w, n in seen.most_common(PER_TASK) if w and len(w) <= CACHE_CHARS and not any(map(str.isspace, w))]
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])


def frequent_words(docs: DataFrame, most: int = FREQUENT) -> list[str]:
    """At most ``most`` words that are frequent over all documents."""
    summaries = small_batches(docs).select("text").mapInArrow(_summary, "word string, n long")
    top = summaries.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return [r.word for r in top.collect()]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, most: int = FREQUENT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row of ``docs``."""
    spark = docs.sparkSession
    ready = TieredCounts(tokenizer_path)
    table = spark.sparkContext.broadcast({w: ready[w] for w in frequent_words(docs, most)})
    run = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_cache(("token counts", run), lambda: TieredCounts(tokenizer_path, table.value))
        for batch in slices(batches):
            texts = batch.column(1)
            n = pa.array([counter.count(x) for x in texts.to_pylist()], pa.int64())
            size = pc.fill_null(pc.binary_length(texts).cast(pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
