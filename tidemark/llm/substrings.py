"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 16 bytes proposes cuts; a cut holds if no other was proposed in the
``LEAST`` bytes before it, so cuts depend on nearby bytes only and an insertion moves no cut
elsewhere. Where this leaves more than ``GAP`` bytes uncut, as in a line or a word that is repeated over
and over, the places whose hash is smallest of the ``TRAIL`` up to it are cuts as well, ``SPACE`` bytes apart at
least: a text of one period is then cut once a period or every few periods, always at one phase, so
all its chunks are the same wherever it begins and however long it is.

The unit of repetition is a chunk with the next one, deduplicated by 64-bit digest (the only chunk of a
text stands alone). A digest with two different documents, or twice in one, is a repeat. Repeated pairs
that overlap form a span: neighbours in a span have been neighbours elsewhere too, so chance repeats of
short phrases do not add up. A repeated passage covers its span and reaches at most into the chunk after
it, through the chunk before it and a few bytes further, as many as a cut depends on: the cuts at its very
beginning may differ from place to place. So a passage of more than ``WORDS`` words lies in a span that has more than so many together
with these; such spans are reported, and so are spans of ``LONG`` bytes, whatever their words. A passage
needs three cuts to hold a pair: one of 51 words and 330 bytes has fewer with a chance of about 1e-4, a
much shorter one (51 words of two or three letters) with one of a few hundredths.

Defined results: null and empty texts have no spans; rows of one ``doc_id`` count as one document
when repeats across documents are counted (a null id as an id of its own), repeats within a document are
those of one row; rows equal in id and text have their spans once in ``spans`` and are all edited in
``remove_repeats``; a character that a chunk's end cuts in two stays whole unless both its chunks go; an
empty table gives no rows; other columns are ignored or, in ``remove_repeats``, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import materialize, small_batches

WINDOW = 16
#: One byte in so many is a proposed cut; the bytes that must be free of others before a cut; the longest chunk.
RATE = 16
LEAST = 8
MOST = 2048
#: A span counts if a passage of more than so many words may lie in it, or if it has so many bytes.
WORDS = 50
LONG = 1024
#: Bytes without a cut beyond which further cuts are taken; the bytes of which such a cut's hash is smallest; the bytes between them.
GAP = 64
TRAIL = 32
SPACE = 16
#: Bytes before a cut on which it depends: of the cuts proposed by the hash, and of the further ones.
LEAD = (WINDOW + LEAST, WINDOW + TRAIL)
#: Texts that are cut as one array.
SLICE = 250
#: ``place`` is the start with the length in the lower bits and two flags below them: the digest stands twice in this
#: text, and it has stood further up. ``words`` has the words begun before the place where a passage may begin above those
#: begun before the end of the chunk after the pair. All rows are shuffled, so they have few columns.
CHUNKS = "doc_id long, doc_key long, digest long, place long, words long"
LENGTH_BITS = 13
TWICE, AGAIN = 2, 1


def _gear() -> np.ndarray:
    """One 16-bit number for each byte value, by a rule."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), 7) & 0xFFFF for b in range(256)], dtype=np.uint16)


def chunk_ends(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending ends of the chunks of the texts ``data[begins[k]:ends[k]]``, which follow each other, and which of them are further cuts."""
    h = _gear()[data]
    step = 1
    while step < WINDOW:  # h of 2 * step bytes from h of step bytes
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint16(step)
        h, step = longer, 2 * step
    cuts = np.flatnonzero(h < 65536 // RATE) + 1
    if len(cuts):
        owner = np.searchsorted(ends, cuts, side="left")
        cuts = cuts[cuts - begins[owner] >= WINDOW]
        cuts = cuts[np.r_[True, np.diff(cuts) >= LEAST]] if len(cuts) else cuts
    cuts = np.union1d(cuts, ends[ends > begins])
    wide = np.flatnonzero(np.diff(np.r_[0, cuts]) > GAP)
    further = cuts[:0]
    if len(wide):
        further = _further_cuts(h, np.r_[0, cuts[:-1]][wide], cuts[wide], begins[np.searchsorted(ends, cuts[wide], side="left")])
        cuts = np.union1d(cuts, further)
    sizes = np.diff(np.r_[0, cuts])
    long = np.flatnonzero(sizes > MOST)
    if len(long):
        extra = [np.arange(cuts[k] - sizes[k] + MOST, cuts[k], MOST) for k in long]
        cuts = np.union1d(cuts, np.concatenate(extra))
    return cuts, np.isin(cuts, further)


def _further_cuts(h: np.ndarray, starts: np.ndarray, stops: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Cuts within the chunks ``starts`` to ``stops``, each of the text that begins at its ``begins``."""
    low, step = h.copy(), 1
    while step < TRAIL:  # low of 2 * step bytes from low of step bytes
        less = low.copy()
        np.minimum(low[step:], low[:-step], out=less[step:])
        low, step = less, 2 * step
    places = np.flatnonzero(h == low) + 1
    out: list[int] = []
    firsts = np.searchsorted(places, np.maximum(starts + SPACE, begins + LEAD[1]))
    lasts = np.searchsorted(places, stops)
    for start, a, b in zip(starts.tolist(), firsts.tolist(), lasts.tolist(), strict=True):
        at = start
        for place in places[a:b].tolist():
            if place - at >= SPACE:
                out.append(place)
                at = place
    return np.array(out, dtype=np.int64)


def _words_before(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each place, how many words begin before it; a text's first byte begins a word unless it is a blank."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    first = ~blank
    first[1:] &= blank[:-1]
    heads = begins[begins < len(data)]
    first[heads] = ~blank[heads]
    return np.r_[0, np.cumsum(first, dtype=np.int32)].astype(np.int32)


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            some = batch.slice(k, SLICE)
            texts = [(x or "").encode("utf-8", "surrogatepass") for x in some.column(2).to_pylist()]
            data = b"".join(texts)
            ends = np.cumsum([len(x) for x in texts])
            begins = np.r_[0, ends[:-1]]
            if not data:
                continue
            cuts, further = chunk_ends(np.frombuffer(data, dtype=np.uint8), begins, ends)
            starts = np.r_[0, cuts[:-1]]
            owner = np.searchsorted(ends, cuts, side="left")
            following = np.r_[owner[1:] == owner[:-1], False]  # the next chunk is of the same text
            alone = ~following & np.r_[True, owner[1:] != owner[:-1]]
            k = np.flatnonzero(following | alone)
            last = k + following[k]
            owner, begin, stop = owner[k], starts[k], cuts[last]
            words = _words_before(np.frombuffer(data, dtype=np.uint8), begins)
            base = words[begins[owner]]
            lead = np.where(np.r_[False, False, further][k], LEAD[1], LEAD[0])  # by the cut at which the chunk before begins
            before = words[np.maximum(starts[np.maximum(k - 1, 0)] - lead, begins[owner])] - base
            after = words[np.minimum(cuts[np.minimum(last + 1, len(cuts) - 1)], ends[owner])] - base
            view = memoryview(data)
            digest = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)), dtype=np.uint64, count=len(k))
            order = np.lexsort((digest, owner))  # stable: places ascend among equals
            same = (digest[order[1:]] == digest[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
            flags = np.zeros(len(k), dtype=np.int64)
            flags[order] = np.r_[False, same] * (TWICE | AGAIN) | np.r_[same, False] * TWICE
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [some.column(0).take(at), some.column(1).take(at), pa.array(digest.view(np.int64)),
                 pa.array(((begin - begins[owner]) << LENGTH_BITS | (stop - begin)) << 2 | flags), pa.array(before.astype(np.int64) << 32 | after)],
                names=["doc_id", "doc_key", "digest", "place", "words"])


_NO_ID = -(1 << 63)


def _keyed(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.xxhash64("doc_id", "text").alias("doc_key"), "text")


def _repeated_chunks(docs: DataFrame, within: bool) -> DataFrame:
    """Repeated pairs of chunks: ``(doc_id, doc_key, start, stop, before, after, extra, span)``.

    ``extra``: a document with a smaller id has this pair too, or this one further up. Texts are cut
    twice instead of storing chunks; only digests that repeat are written, and joined with all occurrences.
    """
    chunks = _keyed(docs).mapInArrow(_chunk_batches, CHUNKS)
    twice = F.bool_or(F.col("place").bitwiseAND(TWICE) != 0) if within else F.lit(False)
    digests = chunks.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), twice.alias("twice")).where("first_doc < last_doc or twice")
    digests = materialize(digests.select(F.col("digest").alias("of_digest"), "first_doc"), "repeated-digests")
    extra = F.col("doc_id") > F.col("first_doc")
    found = chunks.join(digests, F.col("digest") == F.col("of_digest"))
    if within:
        extra = extra | (F.col("place").bitwiseAND(AGAIN) != 0)
    found = found.select("doc_id", "doc_key", "place", "words", extra.alias("extra"))
    found = found.repartition("doc_id", "doc_key").distinct()  # one exchange serves the distinct rows and the windows
    start, length = F.shiftright("place", LENGTH_BITS + 2), F.shiftright("place", 2).bitwiseAND((1 << LENGTH_BITS) - 1)
    parts = {"start": start, "stop": start + length, "before": F.shiftright("words", 32), "after": F.col("words").bitwiseAND((1 << 32) - 1)}
    found = found.select("doc_id", "doc_key", "extra", *[e.cast("int").alias(n) for n, e in parts.items()])
    here = Window.partitionBy("doc_id", "doc_key").orderBy("start")
    begins = F.coalesce(F.lag("stop").over(here) <= F.col("start"), F.lit(True))
    return found.withColumn("begins", begins).withColumn("span", F.sum(F.col("begins").cast("int")).over(here)).drop("begins")


def _counts(over: Window | None, words: int, long: int) -> F.Column:
    """Whether a span counts, as an aggregate or over a window."""
    ends = [F.max("after"), F.min("before"), F.max("stop"), F.min("start")]
    after, before, stop, start = (e if over is None else e.over(over) for e in ends)
    return (after - before > words) | (stop - start >= long)


def spans(docs: DataFrame, words: int = WORDS, long: int = LONG, within: bool = True) -> DataFrame:
    """``(doc_id, span_start, span_end, n_chunks, extra_bytes)``: byte spans that repeat across documents or, with ``within``, in one.

    Every occurrence is a row, the first included; ``n_chunks`` counts the repeated pairs, and
    ``extra_bytes`` the bytes of those that stand earlier: in a document of smaller id or, with
    ``within``, further up in this one.
    """
    here = Window.partitionBy("doc_id", "doc_key", "span").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    done = F.max(F.when(F.col("extra"), F.col("stop"))).over(here)
    fresh_bytes = F.when(F.col("extra"), F.col("stop") - F.greatest("start", F.coalesce(done, F.col("start")))).otherwise(0)
    runs = _repeated_chunks(docs, within).withColumn("fresh_bytes", fresh_bytes).groupBy("doc_id", "doc_key", "span").agg(
        F.min("start").cast("long").alias("span_start"), F.max("stop").cast("long").alias("span_end"),
        F.count("*").alias("n_chunks"), F.sum("fresh_bytes").alias("extra_bytes"), _counts(None, words, long).alias("counts"))
    ids = F.when(F.col("doc_id") != _NO_ID, F.col("doc_id"))
    return runs.where("counts").select(ids.alias("doc_id"), "span_start", "span_end", "n_chunks", "extra_bytes")


def remove_repeats(docs: DataFrame, words: int = WORDS, long: int = LONG, within: bool = True) -> DataFrame:
    """``docs`` with every repeat but the first cut out of ``text``: that in the smallest id, furthest up.

    Only pairs of chunks inside spans that count go. ``n_chars``, where it is a column, follows the text.
    Rows of which no letter or digit is left are dropped.
    """
    marked = _repeated_chunks(docs, within)
    whole = Window.partitionBy("doc_id", "doc_key", "span")
    gone = marked.withColumn("counts", _counts(whole, words, long)).where(F.col("counts") & F.col("extra"))
    cuts = gone.groupBy("doc_id", "doc_key").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cuts"))
    cuts = cuts.select(F.col("doc_id").alias("cut_doc"), F.col("doc_key").alias("cut_key"), "cuts")
    keyed = docs.select(F.struct(*docs.columns).alias("row"),
                        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("key_doc"), F.xxhash64("doc_id", "text").alias("key_text"))
    joined = keyed.join(cuts, (F.col("key_doc") == F.col("cut_doc")) & (F.col("key_text") == F.col("cut_key")), "left")
    changed = F.col("cuts").isNotNull()
    edited = joined.select("row", changed.alias("changed"), _without(F.when(changed, F.col("row.text")), F.col("cuts")).alias("new_text"))
    columns = {
        "text": F.when(F.col("changed"), F.col("new_text")).otherwise(F.col("row.text")),
        "n_chars": F.when(F.col("changed"), F.length("new_text").cast(dict(docs.dtypes).get("n_chars", "long"))).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None,
    }
    left = edited.where(~F.col("changed") | F.col("new_text").rlike(r"[\p{L}\p{N}]"))
    return left.select(*[columns[c].alias(c) if c in columns else F.col("row")[c].alias(c) for c in docs.columns])


@F.arrow_udf(StringType())
def _without_cuts(texts: pa.Array, cuts: pa.Array) -> pa.Array:
    """Texts without the bytes of their cuts; null where there is nothing to cut."""
    out: list[str | None] = []
    for text, gone in zip(texts, cuts, strict=True):
        if not text.is_valid or not gone.is_valid:
            out.append(None)
            continue
        data, at, parts = text.as_py().encode("utf-8", "surrogatepass"), 0, []
        for begin, end in _whole_characters(data, gone.as_py()):
            parts.append(data[at:begin])
            at = end
        out.append(b"".join([*parts, data[at:]]).decode("utf-8", "surrogatepass"))
    return pa.array(out, pa.string())


#: So declared, it is evaluated once, and not again in a filter on its result that the optimizer moves below it.
_without = _without_cuts.asNondeterministic()


def _whole_characters(data: bytes, cuts: list[dict]) -> Iterator[tuple[int, int]]:
    """The cuts, adjacent and overlapping ones joined, without the parts of characters that begin or end outside."""
    joined: list[list[int]] = []
    for c in cuts:
        if joined and joined[-1][1] >= c["start"]:
            joined[-1][1] = max(joined[-1][1], c["stop"])
        else:
            joined.append([c["start"], c["stop"]])
    for begin, end in joined:
        while begin < end and data[begin] & 0xC0 == 0x80:
            begin += 1
        while begin < end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        if begin < end:
            yield begin, end
