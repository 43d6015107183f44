import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import filter_audit, queries


def fails(text, doc, first):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    return {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
        "D": any(c in "#$%&*|" for c in text), "E": doc is not None and first[text] is not None and doc > first[text]}


def brute(rows, labels):
    good, toxic = ({row[0] for row in labels if row[k] == 1} - {None} for k in (1, 2))
    first = {}
    for doc, text, _ in rows:
        known = first.get(text or "")
        first[text or ""] = doc if known is None else known if doc is None else min(known, doc)
    docs = [(source or "", fails(text or "", doc, first), doc in good, doc in toxic) for doc, text, source in rows]
    out, removed_all = {}, Counter()
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                failing = sum(d[1][f] for d in mine)
                unique = sum(d[1][f] and sum(d[1].values()) == 1 for d in mine)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), unique, sum(d[2] for d in gone), sum(d[3] for d in gone)]
                removed_all[part, f] += len(gone)
    return {(*k, *v, removed_all[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def run(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("part", "mask", "n", "good", "quality", "digest")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    return filter_audit.audit(docs, marks)


def test_audit_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)] + ["Big", "CAPS", "é", "#tag", "a&b"]
    texts = [None, "", " \t\n", "\x1cword"] + [" ".join(rng.choices(vocabulary[: rng.choice([20, 60, 65])], k=rng.choice([0, 3, 49, 50, 51, 120]))) for _ in range(40)]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "s1", "s2"])) for _ in range(150)]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d in range(0, 70, 2)] + [(4, 1, 1), (None, 1, 1)]
    got = {tuple(r) for r in run(spark, rows, labels).collect()}
    want = brute(rows, labels)
    assert got == want and len(want) == 3 * 600


def test_query_equals_its_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    df = queries.op13_filter_audit(spark, path)
    want = con.sql(queries.ORACLES["op13_filter_audit"])
    assert sorted(df.columns) == sorted(want.columns)
    assert {tuple(r) for r in df.select(*want.columns).collect()} == set(want.fetchall())


def test_hot_text_and_long_text(spark):
    rows = [(k, "same " * 60, f"s{k % 2}") for k in range(300)] + [(1000, "Ab " * 200_000, "s0")]
    got = {(r.part, r.filter_order): r for r in run(spark, rows, []).where("step = 1").collect()}
    assert (got["s0", "EABCD"].kept, got["s0", "EABCD"].removed, got["s1", "EABCD"].kept) == (2, 149, 0)
    assert got["s0", "CABDE"].removed == 1


def test_empty_table(spark):
    assert run(spark, [], []).collect() == []


def test_zeta_sums_subsets(spark):
    rng = random.Random(1)
    counts = [rng.randrange(100) for _ in range(32)]
    got = spark.range(1).select(filter_audit.zeta(F.array(*[F.lit(c) for c in counts])).alias("z")).first().z
    assert got == [sum(counts[m] for m in range(32) if m & ~s == 0) for s in range(32)]


@pytest.mark.parametrize("bit", [1, 16])
def test_sets_before_a_filter_weigh_all_orders(spark, bit):
    row = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda s: F.lit(31) - s).alias("n")).select(filter_audit._removed_in_all_orders(F.lit(bit)).alias("x")).first()
    assert row.x == -120 * bit
