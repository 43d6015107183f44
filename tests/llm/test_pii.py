import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    total = 0
    for k, c in enumerate(reversed(number)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def fits(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in hit.split(".")),
            "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if fits(k, m[0])]


def joined(spans):
    return ",".join(":".join(map(str, s)) for s in spans)


def check(rows, got):
    assert len(got) == len(rows)
    for (doc, text), r in zip(rows, got, strict=True):
        want = brute(text)
        assert r.doc_id == doc
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in want) for k in PLAIN], text
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest(), (text, r.spans)
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert set(want) <= set(spans) and spans == sorted(spans, key=lambda s: (list(PLAIN).index(s[0]), s[1]))
        assert len(spans) == len(want) + r.n_added
        for k in PLAIN:  # no overlaps within a kind
            mine = [s for s in spans if s[0] == k]
            assert all(a[2] <= b[1] for a, b in zip(mine, mine[1:], strict=False))


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumns({c: F.lit("a@b.c") for c in ("spans", "kind", "n_email", "votes")})
    return pii.digest(pii.find(docs, rounds=3)).collect()


@pytest.mark.parametrize("seed", range(3))
def test_base_spans_equal_plain_patterns(spark, seed):
    rng = random.Random(seed)
    parts = ["@", ".", "-", "_", "+", " ", "(", ")", "1", "42", "255", "256", "0255", "4111111111111111", "4111 1111 1111-1111", "a", "b.c", "é", "😀", "x@y.z", "+1 (234) 555-", "\n", ":", "10.0.0.1", " at ", " dot ", "[at]", "(212) 555-1234", "5500005555555559", "::"]
    rows = [(k, "".join(rng.choices(parts, k=rng.randint(0, 40)))) for k in range(300)]
    check(rows, run(spark, rows))


def test_edges(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "a@b.c_d@e.f"), (3, "a@b.c-d@e.f.g@h.i"), (4, "1.2.3.4.5.6.7.8 1.2.3.256.1.1.1.1"), (5, "+1+23 45 67 89+"), (6, "4111-1111-1111-1111 4111111111111112 4111  1111"),
            (7, "é😀 me@x.org 😀 10.0.0.255"), (8, "000000001.00255.0.0"), (9, "@@a@b@c.d@.e"), (10, "+1 ()()--.. 2345678 .")]
    check(rows, run(spark, rows))


def test_long_texts_are_linear(spark):
    rows = [(1, "a" * 300_000), (2, "a@b" + ".c" * 100_000), (3, "1" * 300_000), (4, "1.1." * 50_000), (5, "+1" + "(" * 200_000), (6, "me@x.org +1 234 567 8901 " * 3000),
            (7, "a@" * 50_000), (8, "+1 " * 50_000), (9, "(at) " * 20_000 + "x at y dot z " * 2000)]
    got = run(spark, rows)
    keep = {2, 4, 6, 7}
    check([r for r in rows if r[0] in keep], [r for r in got if r.doc_id in keep])
    assert [r.n_email for r in got if r.doc_id == 6] == [3000]


def test_candidates_are_judged(spark):
    """Written-out addresses and cards of 15 digits in good company are added; number lists are not."""
    rng = random.Random(2)
    plain = [f"word {rng.choice(['call', 'mail', 'is'])} me.{k}@mail.example.com or +1 (2{k % 90 + 10}) 555-12{k % 90 + 10} card 4111 1111 1111 1111 end" for k in range(200)]
    written = ["please email john.smith at example dot com today", "contact jane [at] mail [dot] org now", "card 378282246310005 ok", "phone (212) 555-1234 ok"]
    clean = ["look at this dot matrix", "page 212 of 555, order 123-4567", "version 1.2.3.4000", "1234567890123456 token"]
    rows = list(enumerate(plain + written + clean))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in pii.digest(pii.find(docs)).collect()}
    added = [got[len(plain) + k].n_added for k in range(len(written))]
    assert added == [1, 1, 1, 1]
    assert [got[len(plain) + len(written) + k].spans for k in range(len(clean))] == [""] * len(clean)


def test_running_sum(spark):
    steps = [random.Random(1).randrange(9) for _ in range(2000)]
    for n in (0, 1, 2, 255, 256, 257, 2000):
        row = spark.createDataFrame([(steps[:n],)], "x array<int>").select(pii.running_sum(F.col("x")).alias("s")).first()
        assert row.s == [sum(steps[: k + 1]) for k in range(n)]


def test_reliabilities_follow_expectation_maximisation(spark):
    """The same estimate in plain loops."""
    from math import exp, log

    rng = random.Random(4)
    rows = {}
    for _ in range(160):
        y = rng.random() < 0.6
        votes = tuple(rng.choices([-1, 0, 1], weights=[1, 2, 5] if y else [4, 2, 1])[0] for _ in range(5))
        rows[rng.randrange(4), rng.random() < 0.5, votes] = rng.randint(1, 9)
    table = spark.createDataFrame([(k, b, list(v), n) for (k, b, v), n in rows.items()], "kind int, base boolean, votes array<int>, n long").coalesce(1)
    prior, weights = pii.reliabilities(table, 6)
    for kind in range(4):
        mine = [(b, v, n) for (k, b, v), n in rows.items() if k == kind]
        chance = {(b, v): 1 / (1 + exp(-sum(v))) for b, v, _ in mine}
        for _ in range(6):
            odds = {g: log((sum(n * chance[b, v] for b, v, n in mine if b == g) + 1) / (sum(n * (1 - chance[b, v]) for b, v, n in mine if b == g) + 1)) for g in (True, False)}
            w = []
            for j in range(5):
                yes, no = ({x: 1 + sum(n * abs(c - chance[b, v]) for b, v, n in mine if v[j] == x) for x in (-1, 1)} for c in (0, 1))
                w.append({x: x * max(0.0, x * log(yes[x] / sum(yes.values()) / (no[x] / sum(no.values())))) for x in (-1, 1)} | {0: 0.0})
            chance = {(b, v): 1 / (1 + exp(-odds[b] - sum(w[j][v[j]] for j in range(5)))) for b, v, _ in mine}
        assert abs(prior[kind] - odds[True]) < 1e-6 and abs(prior[4 + kind] - odds[False]) < 1e-6
        assert all(abs(weights[kind][j][x + 1] - w[j][x]) < 1e-6 for j in range(5) for x in (-1, 0, 1))


def test_query_on_driver_table(spark):
    path = "/root/testdata/sf0.001"
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect())
    df = queries.op11_pii(spark, path)
    assert [t for _, t in df.dtypes] == ["bigint"] * 5 + ["string"] * 2 + ["bigint"]
    check(rows, sorted(df.collect(), key=lambda r: r.doc_id))


def test_native_plan_and_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digest(pii.find(docs)).collect() == []
    plan = pii.candidates(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapInPandas" not in plan
