import random
from collections import defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tidemark.llm import decontaminate, language, packing, queries  # noqa: E402

from .test_decontaminate import brute as brute_leaks  # noqa: E402
from .test_simhash import brute_classes, brute_print  # noqa: E402
from .test_substrings import brute_pairs, runs_that_count  # noqa: E402
from .test_tokens import WORD, crc, ids  # noqa: E402


def corpus():
    rng = random.Random(12)
    syllables = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "i", "o", "un", "or")]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(k, prose(25)) for k in range(4)]
    passage = prose(70)
    rows = [(k, prose(rng.randint(40, 90)), "xx") for k in range(40)]
    rows += [(100 + k, rows[k][1], "xx") for k in range(5)]  # exact copies
    rows += [(200 + k, f"{prose(60)} {passage} {prose(60)}", "xx") for k in range(4)]
    rows += [(300 + k, f"{prose(60)} {items[k][1]} {prose(60)}", "xx") for k in range(4)]
    rows += [(400, "?!? 123", "xx"), (401, None, None), (402, "", "xx"), (403, prose(9000), "xx")]
    rng.shuffle(rows)
    return rows, items


def brute_pipeline(rows, items):
    """What the stages after language identification keep, and the pieces of the last."""
    kept = [(d, t) for d, t, _ in rows if t and any(c.isalpha() for c in t)]
    prints = [(d, brute_print(t)) for d, t in kept]
    kept = [(d, t) for (d, t), c in zip(kept, brute_classes(prints), strict=True) if d == c]
    owners = defaultdict(set)
    for d, t in kept:
        for p in brute_pairs(t.encode()):
            owners[t.encode()[p[0] : p[1]]].add(d)
    cut = []
    for d, t in kept:
        data, places = t.encode(), defaultdict(list)
        for p in brute_pairs(data):
            places[data[p[0] : p[1]]].append(p[0])
        pair = lambda p, data=data: data[p[0] : p[1]]
        again = lambda p, pair=pair, places=places: len(owners[pair(p)]) > 1 or len(places[pair(p)]) > 1
        gone = set()
        for p in (x for r in runs_that_count(data, again) for x in r):
            if d > min(owners[pair(p)]) or places[pair(p)][0] < p[0]:
                gone |= set(range(p[0], p[1]))
        cut.append((d, bytes(b for k, b in enumerate(data) if k not in gone).decode("utf-8", "ignore")))
    leaky = {d for d, *_ in brute_leaks(cut, items)}
    pieces = []
    for d, t in cut:
        if d not in leaky:
            x = ids(WORD, t) + [0]
            pieces += [(d, p, s, len(x[s : s + 2048]), crc(x[s : s + 2048])) for p, s in enumerate(range(0, len(x), 2048))]
    return sorted(pieces)


def test_pipeline_against_brute_force(documents, spark):
    rows, items = corpus()
    folder, df = documents(rows, benchmark=spark.createDataFrame(items, "item_id long, text string"))
    got = corpus_pipeline.run(spark, folder).collect()
    want = brute_pipeline(rows, items)
    assert sorted(tuple(r)[:5] for r in got) == want
    docs = {d for d, *_ in want}
    assert set(range(40)) <= docs and 403 in docs and not docs & {*range(100, 105), *range(300, 304), 400, 401, 402}
    assert {200, 201, 202, 203} <= docs
    assert len({r.sequence_id for r in got}) <= -(-sum(r.length for r in got) // packing.SIZE) + 1


def test_stages_keep_columns_and_empty_tables(documents, spark):
    folder, df = documents([], benchmark=spark.createDataFrame([], "item_id long, text string"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, folder)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == df.columns and dict(out.dtypes) == dict(df.dtypes)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "benchmark_leaks", "packing"]
    assert language.UNKNOWN == "und" and decontaminate.SHARE == 0.8 and "op10_simhash" in queries.QUERIES
