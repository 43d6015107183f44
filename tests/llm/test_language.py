import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.llm import language, queries

WORDS = {"aa": ["der", "und", "straße", "schön"], "bb": ["the", "and", "of", "thing"], "cc": ["niño", "para", "una", "día"]}


def gram_hash(g):
    p, q, r, m = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, (1 << 32) - 1
    c = [0 if x == " " else ord(x) for x in g]
    if len(c) == 1:
        return c[0] * p & m
    if len(c) == 2:
        return (c[0] * q + c[1] * p + 1) & m
    return (c[0] * r + c[1] * q + c[2] * p + 2) & m


def brute_grams(text):
    padded = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    out = [padded[k] for k in range(1, len(padded) - 1) if padded[k] != " "]
    out += [padded[k : k + 2] for k in range(len(padded) - 1) if padded[k : k + 2] != "  "]
    out += [padded[k : k + 3] for k in range(len(padded) - 2) if padded[k + 1] != " "]
    return [gram_hash(g) for g in out] if padded.strip() else []


def ranked(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][: language.PROFILE]


def test_query_against_brute_force(documents):
    rng = random.Random(3)
    rows = []
    for k in range(200):
        lang = rng.choice(sorted(WORDS))
        rows.append((k, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 30))) + rng.choice([".", "!\n", ""]), lang if k % 9 else None))
    rows += [(300, None, "aa"), (301, "", "aa"), (302, "12 !?", "bb"), (303, "The " * 30_000, "bb"), (5, rows[5][1], rows[5][2]), (None, "und der", "aa"), (304, "漢字", "bb")]
    folder, df = documents(rows)
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 3 == 1
    counts = defaultdict(Counter)
    for d, t, lang in rows:
        if t and lang and not out(d):
            counts[lang].update(brute_grams(t))
    profiles = {x: {g: k for k, g in enumerate(ranked(c))} for x, c in counts.items()}
    want = []
    for d, t, _ in rows:
        own = ranked(Counter(brute_grams(t or "")))
        if not own:
            want.append((d, out(d), "und", 0.0))
            continue
        away = {x: sum(abs(k - p[g]) if g in p else language.PROFILE for k, g in enumerate(own)) / len(own) / language.PROFILE for x, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        want.append((d, out(d), best, round(1 - away[best], 9)))
    got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in queries.op8_language(df.sparkSession, folder).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_keep_identified_and_nothing_learned(documents):
    folder, df = documents([(0, "der und der und", "aa"), (1, "?!", "aa"), (2, None, "aa"), (3, "the and the and", "bb")])
    extra = df.withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit(1))
    kept = language.keep_identified(extra, 0.3)
    assert kept.columns == extra.columns
    assert {r.doc_id for r in kept.collect()} <= {0, 3}
    nothing = language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert language.identify(df.limit(0)).count() == 0
