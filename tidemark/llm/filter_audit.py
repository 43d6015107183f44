"""Interaction audit of five document filters by a subset-zeta transform.

Every document gets a mask of the filters it fails. Documents are counted by part and mask, with their
good and toxic labels, so all that follows works on 32 counts a part. The zeta transform sums the
counts over all subsets of a set of filters: those are the documents that fail nothing outside the
set, which survive once all other filters ran. What a filter removes at any place of any order is the
difference between two neighbouring subsets, and the same holds for the labelled documents.

Filters and failure: ``A`` under 50 words; ``B`` fewer distinct words than 65 in 100; ``C`` more than 5
capitals A-Z in 100 characters; ``D`` one of ``#$%&*|``; ``E`` the text of a smaller doc_id, anywhere in
the table. Words are what blanks (space, tab to carriage return) leave.

Defined results: a null text is an empty one (it fails ``A``, and ``E`` if a smaller id has one too), a
null source the part ``''``; each row is a document, so rows of one id all count, and neither of two
equal rows makes the other fail ``E``; a row with a null id neither fails ``E`` nor makes others fail, and
has no labels; a document with several label rows is good or toxic if any of them says so; labels of
unknown ids are ignored, as are other columns; no documents give no rows. Equal texts are found by
SHA-256.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
#: Fixed values of the filters: fewest words, least distinct words and most capitals in 100, marks.
LEAST_WORDS = 50
LEAST_DISTINCT = 65
MOST_CAPITALS = 5
MARKS = "[#$%&*|]"
_BLANKS = r"[\x20\x09-\x0D]+"


def text_mask(text: Column) -> Column:
    """Bits of the filters ``A`` to ``D`` that a text fails; ``A`` is bit 0."""
    words = F.filter(F.split(text, _BLANKS), lambda w: w != "")
    n = F.size(words)
    fails = [
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
        100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > MOST_CAPITALS * F.length(text),
        text.rlike(MARKS),
    ]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents by part and by the set of filters they fail."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("mask"))
    slim = materialize(slim, "masks")  # some 60 bytes a document; texts are read once
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("of_doc")).agg(*[F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    # rows without an id meet no label, and are kept out of the join so that they do not meet in one task
    named = slim.where("doc_id is not null").join(marks, F.col("doc_id") == F.col("of_doc"), "left")
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    named = named.select("doc_id", "part", "digest", "mask", *flags).groupBy("doc_id", "part", "digest", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    # of each text and kind: all its rows, and those of its smallest id
    texts = named.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("low"))
    texts = materialize(texts, "texts")
    first = texts.groupBy(F.col("digest").alias("of_digest")).agg(F.min("low.doc_id").alias("first_doc"))
    first_rows = F.when(F.col("low.doc_id") == F.col("first_doc"), F.col("low.n")).otherwise(0)
    split = texts.join(first, F.col("digest") == F.col("of_digest")).select(
        "part", "mask", "good", "toxic", F.explode(F.array(
            F.struct(F.lit(0).alias("copy"), first_rows.alias("n")),
            F.struct(F.lit(1 << FILTERS.index("E")).alias("copy"), (F.col("n") - first_rows).alias("n")))).alias("c"))
    split = split.select("part", (F.col("mask") + F.col("c.copy")).alias("mask"), "good", "toxic", F.col("c.n").alias("n"))
    nameless = slim.where("doc_id is null").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), F.lit(1).cast("long").alias("n"))
    total = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return split.unionByName(nameless).groupBy("part", "mask").agg(F.sum("n").alias("n"), total("good").alias("good"), total("toxic").alias("toxic")).where("n > 0")


def zeta(counts: Column) -> Column:
    """Sums over all subsets: of an array by mask, the array whose entry ``S`` sums the entries within ``S``."""
    within = lambda a, bit: F.transform(a, lambda x, s: x + F.when(s.bitwiseAND(bit) != 0, F.element_at(a, s - bit + 1)).otherwise(0))
    return F.reduce(F.array(*[F.lit(1 << k) for k in range(len(FILTERS))]), counts, within)


def survivors(counts: DataFrame) -> DataFrame:
    """``(part, n, good, toxic)``: arrays by set ``S`` of filters, of the documents that fail none outside ``S``."""
    by_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))  # 32 entries at most
    dense = counts.groupBy("part").agg(by_mask.alias("m"))
    masks = F.sequence(F.lit(0), F.lit(SETS - 1))
    of = lambda c: F.transform(masks, lambda s: F.coalesce(F.try_element_at(F.col("m"), s)[c], F.lit(0).cast("long")))
    arrays = {c: of(c) for c in ("n", "good", "toxic")}
    return dense.select("part", *[a.alias(c) for c, a in arrays.items()]).select("part", *[zeta(F.col(c)).alias(c) for c in arrays])


def _removed_in_all_orders(bit: Column) -> Column:
    """What a filter removes, summed over all orders: each set before it stands in |S|! (4 - |S|)! of them."""
    size = len(FILTERS)
    weights = F.array(*[F.lit(factorial(k) * factorial(size - 1 - k)).cast("long") for k in range(size)])
    left = lambda s: F.element_at("n", SETS - s)  # noqa: E731  (survivors of S are the entry of its complement)
    before = F.filter(F.sequence(F.lit(0), F.lit(SETS - 1)), lambda s: s.bitwiseAND(bit) == 0)
    return F.aggregate(before, F.lit(0).cast("long"), lambda acc, s: acc + F.element_at(weights, F.bit_count(s) + 1) * (left(s) - left(s + bit)))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step: ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost``, ``shapley``."""
    counts = survivors(mask_counts(docs, labels))
    full = SETS - 1
    bits = F.array(*[F.lit(1 << k) for k in range(len(FILTERS))])
    counts = counts.withColumn("in_all", F.transform(bits, _removed_in_all_orders))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = counts.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    before = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda acc, k: acc + F.when(k < F.col("step"), _bit(F.substr("filter_order", k, F.lit(1)))).otherwise(0))
    rows = rows.withColumn("before", before).withColumn("bit", _bit(F.substr("filter_order", F.col("step"), F.lit(1))))
    at = lambda c, filters: F.element_at(c, full - filters + 1)
    lost = lambda c: at(c, F.col("before")) - at(c, F.col("before") + F.col("bit"))
    fails = at("n", F.lit(0)) - at("n", F.col("bit"))
    return rows.select(
        "part", "filter_order", "step", at("n", F.col("before") + F.col("bit")).alias("kept"), lost("n").alias("removed"), (fails - lost("n")).alias("redundant"),
        (at("n", full - F.col("bit")) - at("n", F.lit(full))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        F.element_at("in_all", F.bit_count(F.col("bit") - 1) + 1).alias("shapley"))


def _bit(letter: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, c in enumerate(FILTERS) for x in (F.lit(c), F.lit(1 << k))]), letter)


_LETTERS = ", ".join(f"('{c}', {1 << k})" for k, c in enumerate(FILTERS))
#: The same by counting documents for each order and step.
SQL = f"""with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
 f as (select doc_id, min(doc_id) over (partition by text) as first_doc, part, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words from d),
 l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by 1),
 m as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
  (len(words) < {LEAST_WORDS})::int + 2 * (100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words))::int
  + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {MOST_CAPITALS} * length(text))::int
  + 8 * regexp_matches(text, '{MARKS}')::int + 16 * coalesce(doc_id > first_doc, false)::int as mask from f left join l using (doc_id)),
 c as (select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from m group by all),
 b(letter, bit) as (values {_LETTERS}),
 o as (select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order from b a, b b, b c, b d, b e
  where a.bit | b.bit | c.bit | d.bit | e.bit = {SETS - 1}),
 s as (select filter_order, step, b.bit as bit, coalesce((select sum(x.bit) from b x where position(x.letter in filter_order) < step), 0)::int as before
  from o, (select unnest(range(1, 6))::int as step), b where b.letter = substr(filter_order, step, 1)),
 r as (select part, filter_order, step, bit, sum(case when mask & (before + bit) = 0 then n else 0 end)::bigint as kept,
  sum(case when mask & before = 0 and mask & bit <> 0 then n else 0 end)::bigint as removed,
  sum(case when mask & before <> 0 and mask & bit <> 0 then n else 0 end)::bigint as redundant,
  sum(case when mask = bit then n else 0 end)::bigint as unique_fails,
  sum(case when mask & before = 0 and mask & bit <> 0 then good else 0 end)::bigint as good_lost,
  sum(case when mask & before = 0 and mask & bit <> 0 then toxic else 0 end)::bigint as toxic_lost from c, s group by all)
 select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, bit))::bigint as shapley from r"""
