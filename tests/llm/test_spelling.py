import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, spelling


def brute_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 97 == 0:
                k = h % len(low)
                low = low[:k] + low[k + 1 :]
            counts[low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute_variants(counts):
    words = sorted(counts)
    letters = sorted({c for w in words for c in w})
    known, near = set(words), {}
    for w in words:
        made = {w[:k] + w[k + 1 :] for k in range(len(w))}
        made |= {w[:k] + c + w[k + d :] for k in range(len(w) + 1) for c in letters for d in (0, 1) if k + d <= len(w)}
        near[w] = (made & known) - {w}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def result(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("large", [3, spelling.LARGE])
@pytest.mark.parametrize("seed,alphabet,count", [(1, "ab", 150), (2, "abé", 300), (3, "abcdefÿ", 400)])
def test_near_words_equal_brute_force(spark, seed, alphabet, count, large):
    rng = random.Random(seed)
    counts = {}
    while len(counts) < count:
        w = "".join(rng.choices(alphabet, k=rng.randint(5, 9)))
        counts[w] = 3 + int(rng.paretovariate(0.5)) % 5000
        for _ in range(2):  # words close to it
            k = rng.randrange(len(w))
            v = w[:k] + rng.choice(["", rng.choice(alphabet), rng.choice(alphabet) + w[k]]) + w[k + 1 :]
            if len(v) >= 5:
                counts.setdefault(v, rng.randint(3, 40))
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert result(spelling.variants(df, large=large)) == brute_variants(counts)


def test_query_equals_brute_force_on_driver_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    counts = brute_words(rows)
    assert len(counts) > 100
    df = queries.op12_spelling(spark, path)
    assert dict(df.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    assert result(df) == brute_variants(counts)


def test_nulls_repeats_long_runs_and_clashing_columns(spark):
    long_word = "ab" * 40_000
    rows = [(None, "Hello hello HELLO Ünïcode ünïcode Ünïcode"), (1, None), (2, ""), (3, f"{long_word} x{long_word} hallo hallo hallo"), (3, f"{long_word} x{long_word} hello"), (4, f"{long_word} x{long_word} ×÷×÷×"), (5, "×÷×÷× ×÷×÷× K" + "elvinK")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "id", "run", "node", "char")})
    counts = spelling.word_counts(docs)
    want = brute_words(rows)
    assert {(r.word, r.n) for r in counts.collect()} == set(want.items())
    assert long_word in want and "hello" in want
    assert result(spelling.variants(counts)) == brute_variants_short(want)


def brute_variants_short(counts):
    """As ``brute_variants``, with the long words' nearness known from how they are made."""
    short = {w: n for w, n in counts.items() if len(w) < 1000}
    out = brute_variants(short)
    long = sorted((w for w in counts if len(w) >= 1000), key=len)
    assert [len(w) for w in long] == [80_000, 80_001]
    return out | {(w, None, w, counts[w], 1, None) for w in long}


def test_chain_of_forms_and_ties(spark):
    counts = {"aaaaa": 100, "aaaab": 40, "aaabb": 10, "aabbb": 3, "zaaaa": 100, "zzzzz": 5}
    got = {r.word: (r.form, r.root, r.n_near) for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got["aabbb"] == ("aaabb", "aaaaa", 1) and got["aaaab"] == ("aaaaa", "aaaaa", 2) and got["aaaaa"] == (None, "aaaaa", 2)
    assert got["zzzzz"] == (None, "zzzzz", 0)


def test_empty_table(spark):
    assert spelling.variants(spelling.word_counts(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_light_edges_are_few(spark):
    """Each word passes at most log2 of the number of words light edges."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(5, 12))) for _ in range(4000)})
    df = spark.createDataFrame(list(enumerate(words)), "word_id long, word string")
    most = spelling.light_edges(df).groupBy("word_id").count().agg(F.max("count")).first()[0]
    assert most <= len(words).bit_length()
