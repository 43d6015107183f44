"""Benchmark decontamination by templates: typed placeholders, window join, slot consistency.

Numbers, measures and names of a text become the placeholders ``<num>``, ``<num><unit>`` and ``<name>``;
other words are lower-cased without marks. A number is written in digits or as number words, which run
on (``two hundred``, ``3 million``); a unit word makes a measure of the number before it, and is a word like
any other elsewhere. A name is a run of capitalised words that does not begin a sentence, with the
capitalised word before it that does, unless that is a word like ``The``; marks end such runs. A lone capitalised word that begins a
sentence may be a name or not: it has both readings. So a name or number of several words is one
placeholder, and windows of five run over placeholders and words, hashed once for each of their readings. Windows of documents meet windows of
benchmark items by a hash join; hits that lie on one alignment must fill the item's placeholders
consistently, one value for each of the item's values, so a re-parameterised question is found and a
chance pattern is not. Where a value is filled differently, the filling of most windows holds (of
equals, the first in order), and windows with another one are no hits; two values may get the same
filling. A document is contaminated by an item if consistent hits cover at least 0.8 of the item's
windows. Items shorter than a window are one window of their own; a reading of it that takes the
beginning of a sentence for a name must leave two literal words.

The rarest starts of an item are those whose windows fewest items have. A document that reaches the
share holds one of the ``n - ceil(0.8 n) + 1`` rarest of the ``n`` starts, so pairs are made of these
alone, and only those pairs are checked in all windows: a window that many items and many documents
have makes no pairs unless an item has nothing rarer.

Tasks hold the hashes of the item windows and of their literal words while there are at most
``BROADCAST`` windows, and beyond that a bitmap of the windows of ``BITMAP`` bits, so that hits leave
the tasks, with few others; the joins are the same either way. Words are what ``str.split`` gives,
for items and documents alike.

Defined results: null and empty texts match nothing, whether document or item; repeated rows give
their pairs once; rows with a null id are searched and kept under a null id; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, slices, small_batches, worker_cache
from .words import MARKS, WordTable, bare

WINDOW = 5
SHARE = 0.8
#: Most item windows that tasks hold, 8 bytes each and as much for each of their literal words.
BROADCAST = 1_000_000
#: Most literal words that tasks hold as words; more are held as hashes.
STRINGS = 200_000
#: Bits of the bitmap of item windows beyond that, a power of two.
BITMAP = 1 << 27
#: Unit words.
UNITS = frozenset(
    "mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons pound pounds ounce ounces "
    "ml cl l liter liters litre litres gallon gallons pint pints "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "hz khz mhz ghz w kw mw v kv a ma n j kj pa kpa k usd eur gbp dollar dollars euro euros cent cents percent degree degrees".split()
)
#: Number words.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion dozen".split()
)
#: Words that begin sentences and are no part of a name.
FIRST_WORDS = frozenset(
    "the a an this that these those it its he she they we you i his her their our my your there here then now so and but or if when while after before once until "
    "since because as at by for from in into of on over to under with within without during each every some any all both no not how what which who whom whose why where "
    "is are was were do does did can could will would should may might must let suppose given find assume consider calculate determine first next later finally also however".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
_MEASURE = re.compile(r"([+-]?\d[\d.,]*)([a-zµ°]+)")
HITS = "doc_id long, doc_key long, doc_at int, window long, slots array<string>"


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"), 11)


_NAME, _MEASURED = np.uint64(_hash("<name>")), np.uint64(_hash("<num><unit>"))
_NUM = _hash("<num>")
_NONE = np.uint64(0)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Kinds of words.
WORD, UNIT, NUMBER, NUMBER_WORD, MEASURE, FIRST_WORD = range(6)


class Tokens:
    """Words and placeholders of some texts in a row, a separator that matches nothing after each text."""

    def __init__(self, words: list[str], heads: np.ndarray, firsts: np.ndarray, template: np.ndarray, slot: np.ndarray, either: np.ndarray):
        self.words, self.heads, self.firsts, self.template, self.slot, self.either = words, heads, firsts, template, slot, either
        self.valued = slot | either

    def sizes(self) -> np.ndarray:
        """Number of tokens of each text."""
        return np.diff(np.r_[self.firsts, len(self.template)]) - 1

    def values(self, at: int, size: int) -> list[str | None]:
        """What fills each token of a window that is or may be a placeholder."""
        ends = self.heads[at : at + size + 1].tolist()
        return [" ".join(map(bare, self.words[ends[k] : ends[k + 1]])) if v else None for k, v in enumerate(self.valued[at : at + size].tolist())]


class Templates:
    """Templates of texts; with a vocabulary (words, or ascending hashes), other literal words are all one word that matches none."""

    def __init__(self, vocabulary: frozenset[str] | array | None = None):
        self.vocabulary = vocabulary
        self.table = WordTable(self.describe, (np.uint64, np.int8, bool, bool, bool))

    def describe(self, word: str) -> tuple:
        """(hash of the literal or typed word, kind, capitalised, ends a sentence, has a mark at its end)"""
        if not word:
            return 0, WORD, False, True, True
        ends = marked = False
        if word.isalpha():
            low = word.lower()
            capital = low != word and word[:1].isupper() and word[1:].islower()
        else:
            core = word.strip(MARKS)
            low = core.lower() or word
            bared = word.rstrip("\"')]}»”’")
            ends, marked = bared[-1:] in ".!?:;", bared != word or bared[-1:] in ".!?:;,"
            if not low.isalpha():
                if _NUMBER.fullmatch(low):
                    return _NUM, NUMBER, False, ends, marked
                if (m := _MEASURE.fullmatch(low)) and m[2] in UNITS:
                    return int(_MEASURED), MEASURE, False, ends, marked
                if "-" in low and all(x in NUMBER_WORDS for x in low.split("-")):
                    return _NUM, NUMBER_WORD, False, ends, marked
            capital = core[:1].isupper() and core[1:].islower()
        if low in NUMBER_WORDS:
            return _NUM, NUMBER_WORD, False, ends, marked
        kind = UNIT if low in UNITS else FIRST_WORD if low in FIRST_WORDS else WORD
        known = self.vocabulary
        if isinstance(known, frozenset):
            return _hash(low) if low in known else 0, kind, capital, ends, marked
        literal = _hash(low)
        if known is not None:
            at = bisect_left(known, literal)
            if at == len(known) or known[at] != literal:
                literal = 0
        return literal, kind, capital, ends, marked

    def of(self, texts: list[str]) -> Tokens:
        words: list[str] = []
        starts = []
        for text in texts:
            starts.append(len(words))
            words += text.split()
            words.append("")
        codes = self.table.codes(words)
        hashes, kind, capital, ends, marked = (self.table.column(k)[codes] for k in range(5))
        after = lambda flags: np.r_[False, flags[:-1]]
        joins = after(~marked)
        number = (kind == NUMBER) | (kind == NUMBER_WORD)
        unit = (kind == UNIT) & joins & after(number)
        capital &= ~unit
        begins = after(ends)
        begins[0] = True
        inner = capital & ~begins
        followed = np.r_[(inner & joins)[1:], False]
        first = capital & begins & followed & (kind != FIRST_WORD)
        name = inner | first
        further = unit | ((kind == NUMBER_WORD) & joins & after(number)) | (inner & joins & after(name))
        heads = np.flatnonzero(~further)
        token = np.cumsum(~further) - 1
        template = np.where(name, _NAME, hashes)
        template = template[heads]
        template[token[unit]] = _MEASURED
        slot = (name | number | (kind == MEASURE))[heads]
        return Tokens(words, heads, token[np.array(starts, dtype=np.int64)], template, slot, (capital & begins & ~first)[heads])


def _bits(flags: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """For each window that starts ``at``, the number whose bit j is the flag of its word j."""
    out = np.zeros(len(at), dtype=np.int64)
    for j in range(size):
        out |= flags[at + j].astype(np.int64) << j
    return out


def _readings(template: np.ndarray, slot: np.ndarray, either: np.ndarray, size: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, hashes) of the windows of each reading, without unknown words, not all placeholders.

    Readings with a name at the beginning of a sentence leave ``least`` literal words.
    """
    n = len(template) - size + 1
    if n <= 0:
        return
    hard = np.r_[0, np.cumsum((template == _NONE) & ~either)]
    at = np.flatnonzero(hard[size:] == hard[:-size])
    if not len(at):
        return
    rolled = np.zeros(len(at), dtype=np.uint64)
    for j in range(size):
        rolled = rolled * _FACTOR + template[at + j]
    unknown, slots, names = _bits(template == _NONE, at, size), _bits(slot, at, size), _bits(either, at, size)
    present = np.unique(names).tolist()
    literal = size - np.bitwise_count(slots).astype(np.int64)
    for mask in sorted({m for whole in present for m in _submasks(whole)}):
        used = np.flatnonzero((names & mask == mask) & (unknown & ~mask == 0) & (literal - mask.bit_count() >= (least if mask else 1)))
        if not len(used):
            continue
        hashes = rolled[used]
        for j in range(size):
            if mask >> j & 1:
                hashes = hashes + (_NAME - template[at[used] + j]) * _FACTOR ** np.uint64(size - 1 - j)
        yield at[used], (hashes ^ (hashes >> np.uint64(29))) * _FACTOR ^ np.uint64(size)


def _submasks(whole: int) -> Iterator[int]:
    part = whole
    while part:
        yield part
        part = (part - 1) & whole
    yield 0


def _consistent(windows: list) -> list[int]:
    """Starts of the windows ``(start, fills)`` that agree with the filling of most, value by value."""
    votes = Counter(pair for _, fills in windows for pair in {(f[0], f[1]) for f in fills})
    chosen: dict[str, str] = {}
    for value, filling in sorted(votes, key=lambda pair: (-votes[pair], pair)):
        chosen.setdefault(value, filling)
    return [at for at, fills in windows if all(chosen[f[0]] == f[1] for f in fills)]


class Wanted:
    """The item windows as tasks hold them: all their hashes, or a bitmap of some bits of each."""

    def __init__(self, hashes: np.ndarray | None, bitmap: np.ndarray | None):
        self.hashes, self.bitmap = hashes, bitmap
        if hashes is not None:
            self.low = np.zeros(1 << 16, dtype=bool)
            self.low[hashes & np.uint64(0xFFFF)] = True
        else:
            self.mask = np.uint64(8 * len(bitmap) - 1)

    def among(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be item windows; exactly those, if all hashes are held."""
        if self.hashes is None:
            low = hashes & self.mask
            return np.flatnonzero(self.bitmap[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8) & 1)
        at = np.flatnonzero(self.low[hashes & np.uint64(0xFFFF)])
        if not len(at) or not len(self.hashes):
            return at[:0]
        place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        return at[self.hashes[place] == hashes[at]]


def _windows(batches: Iterator[pa.RecordBatch], sizes: list[int], wanted: Wanted | None, vocabulary: frozenset[str] | array | None, item: bool) -> Iterator[pa.RecordBatch]:
    """Windows of texts: of the given sizes, the first of them the full one; only wanted hashes; not all placeholders.

    An item that is shorter than the full size is one window of its own size. ``slots`` has a value
    for each token of the window that is or may be a placeholder.
    """
    templates = worker_cache(("templates", vocabulary if vocabulary is None or isinstance(vocabulary, frozenset) else vocabulary.tobytes()), lambda: Templates(vocabulary))
    for batch in slices(batches):
        ids, keys, texts = (batch.column(k) for k in range(3))
        out: list[tuple[np.ndarray, ...]] = []
        slots: list[list[str | None]] = []
        tokens = templates.of([x or "" for x in texts.to_pylist()])
        owner = np.repeat(np.arange(len(batch)), tokens.sizes() + 1)
        short = tokens.sizes()
        for size in (sorted({*np.minimum(short, sizes[0]).tolist()} - {0}) if item else sizes):
            with np.errstate(over="ignore"):
                found = list(_readings(tokens.template, tokens.slot, tokens.either, size, 2 if size < sizes[0] else 1))
            for at, hashes in found:
                if item:  # of its own size only
                    hit = np.flatnonzero(np.minimum(short, sizes[0])[owner[at]] == size)
                    at, hashes = at[hit], hashes[hit]
                if wanted is not None:
                    hit = wanted.among(hashes)
                    at, hashes = at[hit], hashes[hit]
                out.append((owner[at], at - tokens.firsts[owner[at]], hashes))
                slots.extend(tokens.values(p, size) for p in at.tolist())
        rows, places, hashes = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        at = pa.array(rows)
        yield pa.RecordBatch.from_arrays(
            [ids.take(at), keys.take(at), pa.array(places.astype(np.int32)), pa.array(hashes.view(np.int64)), pa.array(slots, pa.list_(pa.string()))],
            names=["doc_id", "doc_key", "doc_at", "window", "slots"])
        templates.table.trim()


def _literals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(number of tokens, a literal word) of each item, null for an item without one."""
    for batch in slices(batches):
        templates = Templates()
        rows: set[tuple[int, str | None]] = set()
        for text in batch.column(0).to_pylist():
            if text and (words := text.split()):
                known = {bare(w) for w in set(words) if templates.describe(w)[1] in (WORD, UNIT, FIRST_WORD)}
                size = int(templates.of([text]).sizes()[0])
                rows.update((size, w) for w in known or {None})
        n, literal = zip(*rows, strict=True) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(literal, pa.string())], names=["n", "literal"])


def item_windows(benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """``(item_id, item_key, item_at, window, item_slots, item_windows, rare)`` as a table."""
    rows = small_batches(benchmark).select(F.col("item_id").cast("long"), F.xxhash64("item_id", "text").alias("key"), "text").distinct()
    found = materialize(rows.mapInArrow(lambda b: _windows(b, [window], None, None, True), HITS).withColumnsRenamed(
        {"doc_id": "item_id", "doc_key": "item_key", "doc_at": "item_at", "slots": "item_slots"}), "item-readings")
    common = found.groupBy("window").agg(F.count_distinct("item_key").alias("items"))
    starts = found.join(common, "window").groupBy("item_id", "item_key", "item_at").agg(F.max("items").alias("items"))
    item = Window.partitionBy("item_id", "item_key")
    starts = starts.withColumn("item_windows", F.count("*").over(item)).withColumn("place", F.row_number().over(item.orderBy("items", "item_at")))
    needed = F.ceil(share * F.col("item_windows"))
    starts = starts.select(
        F.col("item_id").alias("i"), F.col("item_key").alias("k"), F.col("item_at").alias("at"), "item_windows",
        (F.col("place") <= F.col("item_windows") - needed + 1).alias("rare"))
    same = F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_key") == F.col("k")) & (F.col("item_at") == F.col("at"))
    return materialize(found.join(starts, same).select("item_id", "item_key", "item_at", "window", "item_slots", "item_windows", "rare"), "item-windows")


def _bitmap(items: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the item windows: at most ``bits`` / 64 rows leave the executors."""
    low = F.col("window").bitwiseAND(F.lit(bits - 1))
    words = items.groupBy(F.shiftright(low, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(window & {bits - 1} & 63))")).alias("word"))
    table = words.toArrow()
    out = np.zeros(bits // 64, dtype="<i8")
    out[table["at"].to_numpy()] = table["word"].to_numpy()
    return out.view(np.uint8)


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, window: int = WINDOW, broadcast: int = BROADCAST, bitmap: int = BITMAP, strings: int = STRINGS) -> DataFrame:
    """``(doc_id, doc_key, item_id, matched, item_windows)`` of documents that hold an item."""
    items = item_windows(benchmark, window, share)
    literals = materialize(small_batches(benchmark).select("text").mapInArrow(_literals, "n int, literal string").distinct(), "item-words")
    sizes = [window, *sorted(r.n for r in literals.where(F.col("n") < window).select("n").distinct().collect())]
    vocabulary = None
    if items.count() <= broadcast:
        known = literals.where("literal is not null").select("literal").distinct().toArrow()["literal"].to_pylist()
        vocabulary = frozenset(known) if len(known) <= strings else array("Q", sorted(map(_hash, known)))
        wanted = Wanted(np.sort(items.select("window").distinct().toArrow()["window"].to_numpy().view(np.uint64)), None)
    else:
        wanted = Wanted(None, _bitmap(items, bitmap))
    texts = small_batches(docs).select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("doc_key"), "text")
    found = materialize(texts.mapInArrow(lambda b: _windows(b, sizes, wanted, vocabulary, False), HITS).distinct(), "document-hits")
    candidates = found.join(items.where("rare").select("window", F.col("item_id").alias("i"), F.col("item_key").alias("k")), "window")
    candidates = candidates.select(F.col("doc_id").alias("d"), F.col("doc_key").alias("dk"), "i", "k").distinct()
    named = found.join(candidates, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("doc_key") == F.col("dk"))).drop("d", "dk")
    of = items.withColumnRenamed("window", "item_window").drop("rare")
    same = F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_key") == F.col("k")) & (F.col("item_window") == F.col("window"))
    fills = F.filter(F.arrays_zip("item_slots", "slots"), lambda x: x.item_slots.isNotNull())
    pairs = named.join(of, same).select(
        "doc_id", "doc_key", "item_id", "item_key", "item_windows", (F.col("doc_at") - F.col("item_at")).alias("shift"),
        F.struct("item_at", F.transform(fills, lambda x: F.struct(x.item_slots, F.coalesce(x.slots, x.item_slots))).alias("fills")).alias("window"))
    aligned = pairs.groupBy("doc_id", "doc_key", "item_id", "item_key", "item_windows", "shift").agg(F.collect_set("window").alias("windows"))
    hits = aligned.withColumn("hit", F.explode(F.udf(_consistent, "array<int>", useArrow=True)("windows")))
    scored = hits.groupBy("doc_id", "doc_key", "item_id", "item_key", "item_windows").agg(F.count_distinct("hit").alias("matched"))
    return scored.where(F.col("matched") >= share * F.col("item_windows")).select("doc_id", "doc_key", "item_id", "matched", "item_windows")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, matched, item_windows, share)``, one row for each document and item."""
    found = contaminated(docs, benchmark).groupBy("doc_id", "item_id").agg(
        F.max(F.struct(F.col("matched") / F.col("item_windows"), "matched", "item_windows")).alias("m"))
    return found.select("doc_id", "item_id", "m.matched", "m.item_windows", F.round(F.col("m.matched") / F.col("m.item_windows"), 6).alias("share"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item; columns as they were."""
    name = fresh(docs, "gone_key")
    gone = materialize(contaminated(docs, benchmark).select(F.col("doc_key").alias(name)).distinct(), "leaks")
    return docs.join(gone, F.xxhash64("doc_id", "text") == F.col(name), "left_anti")
