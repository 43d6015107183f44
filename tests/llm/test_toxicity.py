import collections
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import queries, toxicity
from tidemark.llm.words import MARKS


def tables(spark, n=1200):
    rng = random.Random(4)
    filler = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(filler) for _ in range(rng.randint(5, 40))]
        toxic = k % 6 == 0
        if toxic:
            words += [rng.choice(["moron!", "Scum", "trash,"]) for _ in range(2)]
        if rng.random() < (0.5 if toxic else 0.05):  # the group is named more often in toxic rows
            words.append("muslims" if toxic else rng.choice(["muslims", "christians"]))
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    return rows, spark.createDataFrame(labels + [(99_999, 1, 1), (1, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_query_on_held_out_rows(documents, spark):
    rows, labels = tables(spark)
    more = [(5000, None), (5001, ""), (5002, "moron " * 30_000), (7, rows[7][1]), (None, "nothing known")]
    folder, df = documents(rows + more, labels=labels)
    got = queries.op2_toxicity(spark, folder).collect()
    assert len(got) == len(rows) + len(more)
    truth = {k: k % 6 == 0 for k in range(len(rows))}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id in truth and r.held_out:
            assert r.predicted == truth[r.doc_id]
    by = {r.doc_id: r for r in got}
    assert by[5000].score == by[5001].score < 0.5 < by[5002].score
    # held-out labels change nothing
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.learn(df, labels), toxicity.learn(df, flipped)
    assert np.array_equal(one.words, two.words) and np.allclose(one.weights, two.weights)


def test_counterfactual_penalty_spares_neutral_mentions(documents, spark):
    rows, labels = tables(spark)
    folder, df = documents(rows)
    words, values, y = [], [], []
    for (k, text) in rows:
        w, v = toxicity.bag(text)
        words.append(w), values.append(v), y.append(float(k % 6 == 0))
    plain, fair = (toxicity.fit(words, values, np.array(y), fair=f) for f in (0.0, toxicity.FAIR))
    gap = lambda m: m.logit(*toxicity.bag("muslims met here")) - m.logit(*toxicity.bag("christians met here"))
    assert gap(plain) > 1 and abs(gap(fair)) < 0.2 * gap(plain)
    assert fair.logit(*toxicity.bag("you moron scum")) > 0 > fair.logit(*toxicity.bag("muslims met here"))


def test_degenerate_labels(documents, spark):
    folder, df = documents([(1, "a"), (2, "b"), (3, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score < 1e-6 for r in toxicity.classify(df, none).collect())
    ones = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert all(r.score > 1 - 1e-6 for r in toxicity.classify(df, ones).collect())
    assert toxicity.classify(df.limit(0), ones).count() == 0


def test_the_training_rows_keep_both_bounds(documents, spark, monkeypatch):
    """Ids and whole rows that repeat teach once; contradicting labels and a null id not at all."""
    rows = [(k, f"text number {k} " + "moron " * (k % 2)) for k in range(1, 41)]
    folder, df = documents(rows + [(2, "another text of two")] * 30 + [rows[3]] * 50 + [(None, "no id")])
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(1, 41)] + [(6, 1, 1), (4, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda words, values, y, **settings: seen.append(len(words)))
    usable = [k for k in range(1, 41) if k != 6 and zlib.crc32(str(k).encode()) % 5]
    for settings, want in (({}, len(usable)), ({"train": 2}, 2), ({"train_bytes": 60}, None), ({"train_bytes": 0}, 0)):
        toxicity.learn(df, labels, **settings)
        assert seen[-1] == want if want is not None else 0 < seen[-1] <= 4


def test_extra_columns_with_clashing_names(documents, spark):
    rows, labels = tables(spark, 300)
    folder, df = documents(rows)
    extra = df.withColumn("toxic", F.lit("clash")).withColumn("hash", F.lit(1)).withColumn("score", F.lit("x")).withColumn("upto", F.lit(0))
    got = {r.doc_id: round(r.score, 9) for r in toxicity.classify(extra, labels.withColumn("text", F.lit("clash"))).collect()}
    assert got == {r.doc_id: round(r.score, 9) for r in toxicity.classify(df, labels).collect()}


def plain_features(word):
    word = word.strip(MARKS).lower() or word
    return [word, *("\x01" + word[:k] for k in (4, 5, 6, 7) if len(word) > k)]


def plain_counts(text):
    return collections.Counter(f for w in (text or "").split() for f in plain_features(w))


def plain_scores(rows, labels, ridge, fair):
    """The whole method with dense matrices: features by name, every swapped text counted anew from its words."""
    first = {}
    for k, text in rows:
        if k is not None and k not in first:
            first[k] = text
    learn = [k for k, y in labels.items() if k in first and zlib.crc32(str(k).encode()) % 5]
    y = np.array([labels[k] for k in learn], float)
    counts = [plain_counts(first[k]) for k in learn]
    total, pos = collections.Counter(), collections.Counter()
    for c, t in zip(counts, y):
        total.update(c.keys())
        pos.update(c.keys() if t else ())
    share = y.mean()
    terms = {f for t in toxicity._SWAPS for f in plain_features(t)}
    chosen = sorted(f for f in total if f in terms or (total[f] >= 3 and abs(pos[f] - total[f] * share) / np.sqrt(total[f] * share * (1 - share)) >= 3))
    vector = lambda c: np.array([1 + np.log(c[f]) if c[f] else 0.0 for f in chosen])
    x = np.array([vector(c) for c in counts])
    changes = []
    for k in learn:
        words = [w.strip(MARKS).lower() for w in (first[k] or "").split()]
        for term in set(words) & set(toxicity._SWAPS):
            for other in toxicity._SWAPS[term]:
                changes.append(vector(plain_counts(" ".join(other if w == term else w for w in words))) - vector(plain_counts(" ".join(words))))
    d = np.array(changes).reshape(-1, len(chosen))
    penalty = np.zeros((len(chosen) + 1,) * 2)
    penalty[:-1, :-1] = ridge * np.eye(len(chosen)) + (fair * len(y) / len(d) * d.T @ d if len(d) else 0)
    x1, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(len(chosen) + 1)
    w[-1] = np.log(share / (1 - share))
    for _ in range(50):
        p = 1 / (1 + np.exp(-x1 @ w))
        w -= np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + penalty + 1e-9 * np.eye(len(w)), x1.T @ (p - y) + penalty @ w)
    return [1 / (1 + np.exp(-(vector(plain_counts(text)) @ w[:-1] + w[-1]))) for _, text in rows]


def test_query_equals_a_dense_fit(documents, spark):
    """Both terms of a group in one text, inflected forms, repeated terms, an empty and a very long text."""
    rng = random.Random(9)
    rows, labels = [], {}
    for k in range(400):
        labels[k] = int(k % 4 == 0)
        words = [rng.choice(["stone", "river", "walking", "cloud", "tables"]) for _ in range(rng.randint(3, 12))]
        words += rng.choices(["idiotic", "idiots", "Moronic,", "trash!"], k=2) if labels[k] else []
        words += rng.choices(["he", "she", "muslims", "christian", "Women"], k=rng.randint(0, 3 + 3 * labels[k]))
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
    rows += [(900, None), (901, ""), (902, "idiotically "), (903, "she he she " * 40_000), (None, "moronic river")]
    folder, _ = documents(rows, labels=spark.createDataFrame([(k, 1, y) for k, y in labels.items()], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in queries.op2_toxicity(spark, folder).collect()}
    for (k, _), want in zip(rows, plain_scores(rows, labels, toxicity.RIDGE, toxicity.FAIR)):
        assert abs(got[k] - want) < 2e-3, (k, got[k], want)


def test_the_penalised_change_is_that_of_the_swapped_text(spark):
    text = "she saw that he and he left the muslims"
    words, weights = toxicity.bag(text)
    count = {int(w): round(float(np.exp(v - 1))) for w, v in zip(words, weights)}
    for term, other in (("he", "she"), ("she", "he"), ("muslims", "christians")):
        change = toxicity.swapped(term, other, count, count[toxicity._hash(term)])
        after = dict(zip(*(x.tolist() for x in toxicity.bag(" ".join(other if w == term else w for w in text.split())))))
        before = dict(zip(words.tolist(), weights.tolist()))
        want = {h: after.get(h, 0) - before.get(h, 0) for h in before.keys() | after.keys()}
        assert {h: round(x, 9) for h, x in change.items() if abs(x) > 1e-12} == {h: round(x, 9) for h, x in want.items() if abs(x) > 1e-12}


def test_a_text_beyond_the_bound_is_scored_but_does_not_teach(documents, spark):
    rows, labels = tables(spark, 300)
    at = next(k for k in range(300) if k % 6 and zlib.crc32(str(k).encode()) % 5)
    rows[at] = (at, "moron scum trash " * 5_000)
    folder, df = documents(rows)
    got = {r.doc_id: r.score for r in toxicity.score(df, toxicity.learn(df, labels, text_bytes=10_000)).collect()}
    assert got[at] > 0.5 and sum((got[k] >= 0.5) == (k % 6 == 0) for k in range(300)) >= 295


def test_chosen_features_and_scores_equal_those_of_the_driver(documents, spark):
    rows, labels = tables(spark)
    folder, df = documents(rows)
    sample = df.join(labels.where("toxic is not null"), "doc_id").select("toxic", "text")
    local = sample.collect()
    y = np.array([r.toxic for r in local], float)
    assert toxicity._chosen(sample, len(y), int(y.sum())).tolist() == toxicity._choose([toxicity.bag(r.text)[0] for r in local], y, toxicity.FEATURES).tolist()
    model = toxicity.learn(df, labels)
    for _, text in rows[:200] + [(0, None), (0, "moron " * 1000)]:
        assert abs(model.logit(*toxicity.bag(text)) - model.logit_of(text)) < 1e-9
