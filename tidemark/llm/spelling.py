"""Spelling variants by merging an errata trie along heavy paths.

Words are counted over all documents and form a trie. At each node the child with most words is heavy
and all others are light, as is the end of a word that has longer ones below it; a word passes at
most ``log2`` of the number of words light edges, since each halves what is below. Only at light edges
are words changed: what follows the edge is merged into the heavy child's subtree with the edge's
character skipped, replaced by the heavy one or preceded by it, and into the other light subtrees with
its character left open. Two words one edit apart part at one node, where at most one of their edges is
heavy, so exactly one of these four errata makes their terminals coincide: each near pair is found
once, from its smaller side, and ``n log n`` rows are made, not one for each place of each word.

Words under one open character differ in that character alone, so a group has no more rows than there
are letters (127); of a group each word needs its size and the two best. No pairs of a group are made.

Nodes are numbered by a 64-bit hash of the prefix. Should two prefixes share a number, their words
count together and only the choice of the heavy child is touched, which both sides of a pair see
alike; errata themselves are whole strings. Edges with more than 1 / ``LARGE`` of all rows
meet their words by a broadcast of fewer than ``LARGE`` rows, the rest by a shuffle in which no key
has more.

Defined results: null texts have no words; each row counts, repeated rows and ids too; a null id
stands as an empty string before the colon of the damage rule; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

BETWEEN = r"[^A-Za-zÀ-ÿ]+"
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: One run in so many loses a character.
DAMAGE = 97
#: A form is so many times as frequent as its variant at least.
RATIO = 2
#: Most edges that are broadcast.
LARGE = 100_000
_END = 0
_FACTOR = 0x9E3779B97F4A7C15
EDGES = "word_id long, at int, node long, char int"


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)``: the words of all texts, A-Z in lower case, some damaged by a rule, with their counts."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.split("text", BETWEEN)).alias("run")).where("run <> ''")
    ascii_only = F.octet_length("run") == F.length("run")  # lower() is then A-Z alone
    low = runs.select("id", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", string.ascii_uppercase, string.ascii_lowercase)).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("id", F.lit(":"), F.col("run")).cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    damaged = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = hashed.select(F.when(F.col("h") % DAMAGE == 0, damaged).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words to their edges: place, hash of what stands before it, and the character there or the end."""
    for batch in slices(batches, 2000):
        words = batch.column(1).to_pylist()
        sizes = np.array([len(w) for w in words])
        if not len(words):
            continue
        codes = np.frombuffer("".join(w + "\0" for w in words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        first = np.r_[0, np.cumsum(sizes + 1)[:-1]]
        place = np.arange(len(codes)) - np.repeat(first, sizes + 1)
        powers = np.full(int(sizes.max()) + 1, _FACTOR, dtype=np.uint64)
        powers[0] = 1
        with np.errstate(over="ignore"):
            powers = np.cumprod(powers, dtype=np.uint64)
            upto = np.r_[np.uint64(0), np.cumsum((codes + np.uint64(1)) * powers[place], dtype=np.uint64)[:-1]]
            prefix = upto - np.repeat(upto[first], sizes + 1)
            node = (prefix ^ (prefix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + place.astype(np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(np.repeat(np.arange(len(words)), sizes + 1))), pa.array(place.astype(np.int32)), pa.array(node.view(np.int64)), pa.array(codes.astype(np.int32))],
            names=["word_id", "at", "node", "char"])


def light_edges(words: DataFrame, large: int = LARGE) -> DataFrame:
    """``(word_id, at, heavy)``: the light edges of each word of ``(word_id, word)``, with the heavy character beside each."""
    edges = materialize(words.select("word_id", "word").mapInArrow(_prefixes, EDGES), "trie-edges")
    counts = materialize(edges.groupBy("node", "char").agg(F.count("*").alias("below")), "trie-counts")
    heavy = counts.where(F.col("char") != _END).groupBy("node").agg(F.min(F.struct(-F.col("below"), "char"))["char"].alias("heavy"))
    branches = materialize(counts.join(heavy, "node"), "trie-branches")
    limit = max(1, (edges.count() - 1) // large + 1)
    often = branches.where(F.col("below") > limit).select(F.col("node").alias("often_node"), F.col("char").alias("often_char"), F.col("heavy").alias("often_heavy"))
    known = edges.join(F.broadcast(often), (F.col("node") == F.col("often_node")) & (F.col("char") == F.col("often_char")), "left")
    hot = known.where("often_heavy is not null and often_heavy <> char").select("word_id", "at", F.col("often_heavy").alias("heavy"))
    rest = known.where("often_heavy is null").select("word_id", "at", "node", "char")
    light = branches.where((F.col("heavy") != F.col("char")) & (F.col("below") <= limit)).select("node", "char", "heavy")
    return hot.union(rest.join(light, ["node", "char"]).select("word_id", "at", "heavy"))


def errata(words: DataFrame, light: DataFrame) -> DataFrame:
    """``(word, n, target, open)``: strings that a word becomes at its light edges; ``open`` ones hold ``*`` for any light character."""
    met = light.join(words, "word_id").withColumn("before", F.substr("word", F.lit(1), F.col("at")))
    here, after = F.substr("word", F.col("at") + 1, F.lit(1)), F.substr("word", F.col("at") + 2)
    heavy = _character(F.col("heavy"))
    inside = F.col("at") < F.length("word")
    target = lambda s, is_open: F.struct(s.alias("target"), F.lit(is_open).alias("open"))
    made = F.array(
        target(F.when(inside & (here != F.substr("word", F.col("at") + 2, F.lit(1))), F.concat("before", after)), False),
        target(F.when(inside, F.concat(F.col("before"), heavy, after)), False),
        target(F.concat(F.col("before"), heavy, F.substr("word", F.col("at") + 1)), False),
        target(F.when(inside, F.concat(F.col("before"), F.lit("*"), after)), True))
    return met.select("word", "n", F.explode(made).alias("e")).where("e.target is not null").select("word", "n", "e.target", "e.open")


def _character(code: Column) -> Column:
    """The character of a code point below 256."""
    high = F.lpad(F.hex(code.cast("long")), 4, "0")
    return F.decode(F.unhex(high), "UTF-16BE")


def near_words(words: DataFrame, large: int = LARGE) -> DataFrame:
    """``(word, n_near, best)`` of words ``(word_id, word, n)`` that have near ones; ``best``: (minus n, word) of the first."""
    made = materialize(errata(words, light_edges(words, large)), "errata")
    other = words.select(F.col("word").alias("target"), F.col("n").alias("target_n"))
    pairs = made.where("not open").join(other, "target")
    rank = lambda n, w: F.struct((-F.col(n)).alias("minus_n"), F.col(w).alias("word"))
    both = F.array(F.struct("word", rank("target_n", "target").alias("best")), F.struct(F.col("target").alias("word"), rank("n", "word").alias("best")))
    merged = pairs.select(F.explode(both).alias("p")).select("p.word", F.lit(1).alias("c"), "p.best")
    groups = made.where("open").groupBy("target").agg(F.array_sort(F.collect_list(rank("n", "word"))).alias("members")).where(F.size("members") > 1)
    member = F.transform("members", lambda x, k: F.struct(x.word.alias("word"), F.element_at("members", F.when(k == 0, 2).otherwise(1)).alias("best")))
    within = groups.select((F.size("members") - 1).alias("c"), F.explode(member).alias("p")).select("p.word", "c", "p.best")
    return merged.unionByName(within).groupBy("word").agg(F.sum("c").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``(word, form)`` by pointer jumping; a form's count is at least twice its word's, so chains are short."""
    roots = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("of_word"), F.col("root").alias("next"))
        jumped = materialize(roots.join(further, F.col("root") == F.col("of_word"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return roots


def variants(counts: DataFrame, ratio: int = RATIO, large: int = LARGE) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``(word, n)``."""
    words = materialize(counts.select(F.monotonically_increasing_id().alias("word_id"), "word", "n"), "words")
    near = near_words(words, large).withColumnRenamed("word", "of_word")
    best_n = -F.col("best.minus_n")
    fits = best_n >= ratio * F.col("n")
    named = words.join(near, F.col("word") == F.col("of_word"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.word")).alias("form"), F.when(fits, best_n).alias("form_n"))
    named = materialize(named, "forms")
    roots = _roots(named.where("form is not null").select("word", "form")).withColumnRenamed("word", "of_word")
    return named.join(roots, F.col("word") == F.col("of_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
