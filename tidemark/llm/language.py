"""Language identification by rank-order profiles of character n-grams.

A profile is a list of the most frequent 1- to 3-grams of letters, words padded with a blank. A
language's profile comes from the counts over all its training texts; a document is compared by the
out-of-place distance: for each n-gram of the document's profile the difference of the two ranks, or
the profile length where the language lacks it. The nearest language wins.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is every
text if nothing was learned; equal distances go to the first language in order; rows with a null
language teach nothing; repeated rows all get a row; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, small_batches, worker_cache

UNKNOWN = "und"
#: n-grams of a profile, and the most languages that profiles are broadcast for.
PROFILE = 400
LANGUAGES = 1_000
#: Distinct n-grams that a task holds for its languages before it hands them on.
HELD = 2_000_000


def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else 0 (a blank)."""
    make = lambda: np.fromiter((c if chr(c).isalpha() else 0 for c in range(0x110000)), dtype=np.uint32, count=0x110000)
    return worker_cache("letters", make)


def grams(text: str) -> np.ndarray:
    """Hashes of the 1- to 3-grams of a text's padded words."""
    codes = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    blank = codes == 0
    codes = np.r_[np.uint32(0), codes[~(blank & np.r_[True, blank[:-1]])], np.uint32(0)]
    if len(codes) < 3:
        return np.empty(0, dtype=np.uint32)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    p, q, r = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
    one = b[b > 0] * p
    two = (codes[:-1] * q + codes[1:] * p + np.uint32(1))[(codes[:-1] > 0) | (codes[1:] > 0)]
    three = (a * r + b * q + c * p + np.uint32(2))[b > 0]
    return np.concatenate([one, two, three])


def _counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes = np.sort(hashes)
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    return hashes[first], np.diff(np.r_[first, len(hashes)])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flush() -> pa.RecordBatch:
        lang = [x for x, (k, _) in held.items() for _ in range(len(k))]
        keys = np.concatenate([np.empty(0, np.uint32), *(k for k, _ in held.values())])
        counts = np.concatenate([np.empty(0, np.int64), *(n for _, n in held.values())])
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])

    def add(lang: str, found: list[np.ndarray]) -> None:
        keys, counts = _counted(np.concatenate(found))
        if lang in held:
            k, n = held[lang]
            both = np.concatenate([k, keys])
            order = np.argsort(both, kind="stable")
            both, total = both[order], np.concatenate([n, counts])[order]
            first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
            keys, counts = both[first], np.add.reduceat(total, first)
        held[lang] = (keys, counts.astype(np.int64))

    for batch in slices(batches):
        found: dict[str, list[np.ndarray]] = defaultdict(list)
        sizes: dict[str, int] = defaultdict(int)
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            g = grams(text)
            if len(g):
                found[lang].append(g)
                sizes[lang] += len(g)
                if sizes[lang] > 1_000_000:
                    add(lang, found.pop(lang))
                    sizes[lang] = 0
        for lang, x in found.items():
            add(lang, x)
        if sum(len(k) for k, _ in held.values()) > HELD:
            yield flush()
    yield flush()


def learn(labelled: DataFrame, profile: int = PROFILE) -> dict[str, list[int]]:
    """Profile (n-gram hashes by rank) of each language of the rows ``(text, lang)``."""
    rows = small_batches(labelled).select("text", "lang").where("text is not null and lang is not null")
    counts = rows.mapInArrow(_count_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= profile).select("lang", "gram", "rank")
    found: dict[str, list[int]] = defaultdict(list)
    for r in sorted(top.limit(LANGUAGES * profile + 1).collect()):
        found[r.lang].append((r.rank, r.gram))
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    return {lang: [g for _, g in sorted(x)] for lang, x in sorted(found.items())}


def predict(profiles: dict[str, list[int]], profile: int = PROFILE) -> F.Column:
    """``(lang_pred, score)`` of the column ``text``; score: 1 less the mean distance by the profile length.

    Only texts go to the Python workers and only results come back; other columns stay in the JVM.
    """
    langs = sorted(profiles)
    keys = np.array(sorted({g for x in profiles.values() for g in x}), dtype=np.uint32)
    ranks = np.full((len(keys) + 1, len(langs)), -1, dtype=np.int32)
    for k, lang in enumerate(langs):
        ranks[np.searchsorted(keys, np.array(profiles[lang], dtype=np.uint32)), k] = np.arange(len(profiles[lang]))

    def one(text: str | None) -> tuple[str, float]:
        g = grams(text) if text and langs else ()
        if not len(g):
            return UNKNOWN, 0.0
        own, counts = _counted(g)
        order = np.lexsort((own, -counts))[:profile]
        own = own[order]
        at = np.searchsorted(keys, own)
        at[keys[np.minimum(at, len(keys) - 1)] != own] = len(keys)
        there = ranks[at]
        away = np.where(there < 0, profile, np.abs(there - np.arange(len(own))[:, None]))
        means = away.mean(axis=0) / profile
        best = int(np.argmin(means))
        return langs[best], float(1 - means[best])

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def nearest(texts: pa.Array) -> pa.Array:
        found = [one(x.as_py()) for x in texts]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["lang_pred", "score"])

    return nearest(F.col("text"))


def held_out(doc_id: F.Column, modulus: int = 3, remainder: int = 1) -> F.Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` by profiles of the rows that are not held out."""
    profiles = learn(docs.where(~held_out(F.col("doc_id"))))
    found = small_batches(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(profiles).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def keep_identified(docs: DataFrame, least: float) -> DataFrame:
    """Rows of ``docs`` whose language is known with at least this score; columns as they were."""
    profiles = learn(docs.where(~held_out(F.col("doc_id"))))
    found = predict(profiles)
    return small_batches(docs).where((found["lang_pred"] != UNKNOWN) & (found["score"] >= least))
