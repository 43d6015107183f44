"""SimHash near-duplicates with pigeonring candidate filtering.

A fingerprint is cut into 8 ring segments of 8 bits. If two fingerprints differ in at most 3 bits,
some segment starts a chain in which every run of ``l`` consecutive segments differs in at most
``floor(3 l / 8)`` bits (the pigeonring principle). So from that start two segments are equal and,
of the next three, at least two are: each fingerprint gets 8 x 3 keys of 32 equal bits. Only
fingerprints that share a key meet; there the chain budgets prune a pair before its full Hamming
check. Equal fingerprints are one row throughout, so copies never form pairs, and what leaves a
batch of buckets is a spanning forest of its links, never all pairs. A bucket too large for a task is cut by
the same principle again: of four parts of its free bits one must be equal, so its rows go into four
smaller buckets each, with a quarter of the free bits less, until all are small.

Defined results: a null or word-less text has fingerprint zero and links like any other; repeated
rows and ids all get a row; rows with a null id get a component by their fingerprint, whose id is
the smallest non-null one reachable (null if there is none); an empty table gives no rows; other
columns are ignored, or kept by ``keep_one_per_class``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, slices, small_batches
from .components import connected_components, forest

SEED = 42
SHINGLE = 3
MAX_BITS = 3
SEGMENTS = 8
#: Largest bucket that one group compares; larger ones are cut by further equal bits.
BUCKET_ROWS = 32_768
PARTS = MAX_BITS + 1
#: Free bits at which a bucket of distinct fingerprints is small in any case, and is cut no further.
LEAST_FREE = 12


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        values = np.array([fingerprint(x) for x in batch.column(2).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(values.view(np.int64))], names=["doc_id", "row_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, row_key, fp)``: the fingerprint of each document as a signed long, and a hash of its id and text."""
    return small_batches(docs).select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row_key"), "text").mapInArrow(
        _fingerprint_batches, "doc_id long, row_key long, fp long")


def _keys() -> F.Column:
    """The 24 keys of a fingerprint, each with its free bits: start and pair of segments above, 32 bits below."""
    part = [F.shiftrightunsigned("fp", 8 * k).bitwiseAND(F.lit(0xFF)) for k in range(SEGMENTS)]
    keys = []
    for start in range(SEGMENTS):
        at = [(start + k) % SEGMENTS for k in range(5)]
        for pair, (p, q) in enumerate(((2, 3), (2, 4), (3, 4))):
            value = F.lit((start * 3 + pair) << 32)
            for shift, k in zip((24, 16, 8, 0), (at[0], at[1], at[p], at[q]), strict=True):
                value = value.bitwiseOR(F.shiftleft(part[k], shift))
            equal = sum(0xFF << 8 * k for k in (at[0], at[1], at[p], at[q]))
            keys.append(F.struct(value.alias("key"), F.lit(_signed(~equal)).alias("free")))
    return F.array(*keys)


def _signed(bits: int) -> int:
    bits &= (1 << 64) - 1
    return bits - (bits >> 63 << 64)


def _parts(free: int) -> list[int]:
    """The set bits of ``free`` in four masks."""
    bits = [k for k in range(64) if free >> k & 1]
    return [sum(1 << k for k in bits[len(bits) * n // PARTS : len(bits) * (n + 1) // PARTS]) for n in range(PARTS)]


def _cut_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, free, fp) to four rows each: key with one part of the free bits, the other free bits, fp."""
    for batch in batches:
        key, free, fp = (batch.column(k).to_numpy().view(np.uint64) for k in range(3))
        out: list[list[np.ndarray]] = [[], [], []]
        for mask in np.unique(free).tolist():
            at = np.flatnonzero(free == np.uint64(mask))
            for n, part in enumerate(_parts(mask)):
                with np.errstate(over="ignore"):
                    mixed = (key[at] ^ (fp[at] & np.uint64(part))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
                    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                out[0].append((key[at] & ~np.uint64(0xFFFF_FFFF)) | (mixed >> np.uint64(32)))
                out[1].append(np.full(len(at), mask & ~part, dtype=np.uint64))
                out[2].append(fp[at])
        columns = [pa.array(np.concatenate(x).view(np.int64)) if x else pa.array([], pa.int64()) for x in out]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "free", "fp"])


def _ring_mask(start: int, length: int) -> np.uint64:
    return np.uint64(sum(0xFF << 8 * ((start + k) % SEGMENTS) for k in range(length)))


#: (mask, budget) of the chain prefixes that imply all others, by start; the first two segments are equal by the key.
_CHAINS = [[(_ring_mask(s, n), MAX_BITS * n // SEGMENTS) for n in (5, 7)] for s in range(SEGMENTS)]


def _near(one: np.ndarray, others: np.ndarray, start: int) -> np.ndarray:
    """Which pairs pass the chain from ``start`` and then differ in at most 3 bits."""
    diff = one ^ others
    ok = np.ones(diff.shape, dtype=bool)
    for mask, budget in _CHAINS[start]:
        ok &= np.bitwise_count(diff & mask) <= budget
    return ok & (np.bitwise_count(diff) <= MAX_BITS)


def bucket_forest(values: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links that span the components of one bucket of distinct fingerprints."""
    links, rest = [], values
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            node = frontier.pop()
            hit = _near(node, rest, start)
            if hit.any():
                found = rest[hit]
                rest = rest[~hit]
                frontier.extend(found)
                links.extend((int(node), int(x)) for x in found)
    return links


def _emit(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    sizes = np.diff(edges)
    first = edges[:-1][sizes == 2]
    starts = (keys[first] & 0xFF_FFFF_FFFF) >> 32
    a, b = [], []
    for s in range(SEGMENTS):
        at = first[starts // 3 == s]
        hit = at[_near(values[at], values[at + 1], s)]
        a.append(values[hit])
        b.append(values[hit + 1])
    links: list[tuple[int, int]] = []
    for n in np.flatnonzero(sizes > 2):
        lo, hi = edges[n], edges[n + 1]
        links += bucket_forest(values[lo:hi], int(keys[lo] & 0xFF_FFFF_FFFF) // (3 << 32))
    more = np.array(links, dtype=np.uint64).reshape(-1, 2)
    node, top = forest(np.concatenate([*a, more[:, 0]]).view(np.int64), np.concatenate([*b, more[:, 1]]).view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(top)], names=["a", "b"])


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key to links; a bucket may span batches."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def joined() -> tuple[np.ndarray, np.ndarray]:
        key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        return key, fp.view(np.uint64)

    for batch in batches:
        key, fp = (batch.column(k).to_numpy() for k in range(2))
        if not len(key):
            continue
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        if cut:
            held.append((key[:cut], fp[:cut]))
            yield _emit(*joined())
            held = []
        elif held and held[-1][0][-1] != key[0]:
            yield _emit(*joined())
            held = []
        held.append((key[cut:], fp[cut:]))
    if held:
        yield _emit(*joined())


def links(prints: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links ``(a, b)`` that span the components of distinct fingerprints ``(fp)``.

    Buckets of more than ``bucket_rows`` fingerprints are cut by further equal bits, so that no task
    holds a whole large bucket, rows grow in proportion, and no pair is missed.
    """
    keyed = prints.select(F.explode(_keys()).alias("k"), "fp").select("k.key", "k.free", "fp")
    small = keyed.select("key", "fp")
    while True:
        large = keyed.groupBy("key").agg(F.count("*").alias("n"), F.max(F.bit_count("free")).alias("bits"))
        large = materialize(large.where((F.col("n") > bucket_rows) & (F.col("bits") > LEAST_FREE)).select(F.col("key").alias("large_key")), "large-buckets")
        if large.isEmpty():
            break
        split = materialize(keyed.join(large, F.col("key") == F.col("large_key")).select("key", "free", "fp").mapInArrow(_cut_buckets, "key long, free long, fp long"), "cut-buckets")
        small = small.join(large, F.col("key") == F.col("large_key"), "left_anti").union(split.select("key", "fp"))
        keyed = split
    dealt = small.repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_bucket_links, "a long, b long")


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, row_key, fp, component_id, root)`` of every row of ``docs``.

    ``row_key`` is a hash of id and text, ``root`` the smallest fingerprint of the class.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    lowest = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    linked = connected_components(links(lowest.select("fp")))
    named = materialize(lowest.join(linked, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "low"), "rooted")
    smallest = materialize(named.groupBy("root").agg(F.min("low").alias("component_id")), "smallest")  # plain scans, so that a hot root or
    classes = materialize(named.join(smallest, "root").select(F.col("fp").alias("class_fp"), "root", "component_id"), "class-table")  # fingerprint is split in the joins
    return prints.join(classes, F.col("fp") == F.col("class_fp")).select("doc_id", "row_key", "fp", "component_id", "root")


def fingerprint_hex(fp: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one_per_class(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stay when one document of each near-duplicate class is kept.

    Of a class the row with the smallest id stays, before those without an id; of rows with that id
    the one whose hash of id and text is smallest; of rows equal in both, one.
    """
    classes = materialize(near_duplicate_classes(docs), "classes")
    first = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key")).alias("first"))
    counts = classes.groupBy("row_key").agg(F.count("*").alias("n"))
    name, key = fresh(docs, "row_key"), F.xxhash64("doc_id", "text")
    keys = first.select(F.col("first.row_key").alias("row_key")).join(counts, "row_key").select(F.col("row_key").alias(name), "n")
    keys = materialize(keys, "kept")
    kept = docs.join(keys.select(name), key == F.col(name), "left_semi")
    copies = keys.where("n > 1").select(name)
    if copies.isEmpty():
        return kept
    once = kept.join(copies, key == F.col(name), "left_semi").withColumn(name, key).dropDuplicates([name]).drop(name)
    return kept.join(copies, key == F.col(name), "left_anti").unionByName(once)
