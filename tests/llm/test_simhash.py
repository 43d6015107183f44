import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import queries, simhash
from tidemark.llm.components import connected_components


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)]
    value = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(g, 42) >> bit & 1 for g in grams) > len(grams):
            value |= 1 << bit
    return value


def brute_classes(prints):
    """prints: list of (doc_id, fp); smallest doc_id reachable over links of 3 bits or fewer."""
    top = list(range(len(prints)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    low = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            low[root(i)] = min(low.get(root(i), doc), doc)
    return [low.get(root(i)) for i in range(len(prints))]


def test_query_against_brute_force(documents):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        rows.append((k, " ".join(words)))
        for n in range(rng.randint(0, 3)):
            copy = list(words)
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((1000 + 10 * k + n, ("\n" if n else "\t\x0b ").join(copy).upper()))
    rows += [(5000, None), (5001, ""), (5002, " \n "), (4, rows[4][1]), (6000, "long " * 50_000), (None, "long " * 50_000), (None, "unique words of a row without id")]
    rng.shuffle(rows)
    folder, df = documents(rows)
    got = queries.op10_simhash(df.sparkSession, folder).collect()
    prints = [(d, brute_print(t)) for d, t in rows]
    want = [(d, f"{fp:016x}", c) for (d, fp), c in zip(prints, brute_classes(prints))]
    key = lambda x: tuple(str(v) for v in x)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_links_of_a_dense_cluster_with_small_buckets(spark):
    """Near prints share buckets; blocks of a large bucket must find the same components."""
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**63))
    values = {base}
    while len(values) < 400:
        x = rng.choice(sorted(values)[:40])
        for bit in rng.integers(0, 63, rng.integers(1, 7)):
            x = int(x) ^ (1 << int(bit))
        values.add(int(x))
    values = sorted(values)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    want = dict(zip(values, brute_classes([(v, v) for v in values])))
    for cap in (32_768, 16):
        rows = connected_components(simhash.links(df, cap)).collect()
        got = {v: v for v in values} | {r.node: r.root for r in rows}
        assert got == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(1001, 1400)] + [(5, 5), (None, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 1000 for k in range(1000, 1400)}


def test_keep_one_per_class(documents):
    text = "one two three four five six seven eight"
    folder, df = documents([(3, text), (1, text), (1, text), (2, "other words entirely here"), (None, text)])
    extra = df.withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1))
    kept = simhash.keep_one_per_class(extra)
    assert kept.columns == extra.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2"]


def test_one_of_each_class_whatever_the_ids(documents):
    """Ids that repeat on other texts and rows without an id: each class keeps one row, no clean text goes."""
    texts = ["one two three four five six seven eight", "nine ten eleven twelve thirteen", "all alone in this table of words", "without any id but twice here"]
    folder, df = documents([(1, texts[0]), (1, texts[1]), (5, texts[0]), (5, texts[1]), (5, texts[2]), (None, texts[3]), (None, texts[3]), (None, texts[0]), (9, texts[2]), (9, texts[2])])
    clash = df.withColumn("row_key", F.lit("clash")).withColumn("n", F.lit(2)).withColumn("_row_key", F.lit(1))
    kept = simhash.keep_one_per_class(clash)
    assert kept.columns == clash.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", texts[0]), ("1", texts[1]), ("5", texts[2]), ("None", texts[3])])


def test_large_buckets_are_cut_until_they_are_small(spark):
    """Fingerprints that share all but a few bits, so that cut buckets are large again."""
    rng = np.random.default_rng(9)
    values = sorted({int(x) for x in rng.integers(0, 1 << 14, 600)} | {int(x) << 40 for x in rng.integers(1, 1 << 9, 60)})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    want = dict(zip(values, brute_classes([(v, v) for v in values])))
    got = {v: v for v in values} | {r.node: r.root for r in connected_components(simhash.links(df, 8)).collect()}
    assert got == want


def test_empty_table(documents):
    folder, df = documents([])
    assert queries.op10_simhash(df.sparkSession, folder).count() == 0
    assert simhash.keep_one_per_class(df).count() == 0
