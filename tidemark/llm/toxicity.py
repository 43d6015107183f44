"""Toxicity: a logistic classifier regularised by counterfactual identity swaps.

The features of a text are its words and the first 4, 5, 6 and 7 characters of longer words (so an inflected
or joined form counts for its stem), with weight ``1 + log(count)``. The classifier is fitted on at most ``TRAIN``
labelled documents (those of least hash) with ``TRAIN_BYTES`` of text together and ``TEXT_BYTES`` each, on the
features whose class counts differ most there.
Besides L2, the loss has ``FAIR`` times the mean squared change of the logit when an identity term
of a labelled text is replaced by another group's, all features of the text counted anew; a term by itself then
carries no weight, and neutral mentions of a group aren't marked.

Defined results: null, empty and unknown texts get the score of the intercept; labels that are null,
contradict each other or lack a document teach nothing; of documents that share an id one text
teaches, that of the smallest hash; a text longer than ``TEXT_BYTES`` is scored whole but doesn't teach; a null
``doc_id`` teaches nothing and stays null; without both classes the score is the labels' share (0 without
labels); repeated rows all get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, small_batches, worker_cache
from .words import WordTable, bare

#: Bound of the labelled rows that the fit uses, words that it may weigh, and strengths.
TRAIN = 12_000
TRAIN_BYTES = 64 << 20
TEXT_BYTES = 1 << 20
FEATURES = 4_096
RIDGE = 1.0
FAIR = 10.0
#: Identity terms that are swapped for each other, by kind.
GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("she", "he"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"), ("immigrants", "refugees", "natives"), ("old", "young"), ("disabled", "blind", "deaf"),
)
_SWAPS = {term: tuple(x for x in group if x != term) for group in GROUPS for term in group}
_SEED = 3
#: Lengths of the beginnings of words that are features too.
STEMS = (4, 5, 6, 7)
#: Least documents and standard errors of a feature that the fit weighs.
SEEN, ERRORS = 3, 3.0


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"), _SEED)


def features_of(word: str) -> list[int]:
    """Hashes of a word's features: the bare word and its beginnings, as far as they are shorter."""
    word = bare(word)
    return [_hash(word), *(_hash("\x01" + word[:k]) for k in STEMS if len(word) > k)]


def _describe(word: str) -> tuple:
    found = features_of(word)
    return (*found, *[found[0]] * (1 + len(STEMS) - len(found)))


def _table() -> WordTable:
    return worker_cache("toxicity", lambda: WordTable(_describe, (np.uint64,) * (1 + len(STEMS))))


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features of a text, ascending, with their weights."""
    table = _table()
    codes, counts = np.unique(table.codes((text or "").split()), return_counts=True)
    columns = [table.column(k)[codes] for k in range(1 + len(STEMS))]
    keep = [np.ones(len(codes), bool), *(c != columns[0] for c in columns[1:])]  # a short word fills up with itself
    words, at = np.unique(np.concatenate([c[k] for c, k in zip(columns, keep, strict=True)]), return_inverse=True)
    return words, 1 + np.log(np.bincount(at, np.concatenate([counts[k] for k in keep]), len(words)))


def _counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(word, total, pos)`` of rows ``(toxic, text)``: documents and toxic documents with a feature, by batch."""
    for batch in slices(rows):
        toxic = batch.column(0).to_numpy(zero_copy_only=False)
        words = [bag(x)[0] for x in batch.column(1).to_pylist()]
        seen, at = np.unique(np.concatenate(words), return_inverse=True)
        pos = np.bincount(at, np.repeat(toxic, [len(w) for w in words]), len(seen)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(np.bincount(at, minlength=len(seen))), pa.array(pos)], names=["word", "total", "pos"])
        _table().trim()


def _bags(chosen: np.ndarray):
    """``(toxic, words, weights)`` of rows ``(toxic, text)``, of the chosen features."""
    model = Model(chosen, np.zeros(len(chosen)), 0.0)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows):
            found = [model.weighed(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([chosen[at].view(np.int64) for at, _ in found], pa.list_(pa.int64())), pa.array([x.astype(np.float32) for _, x in found], pa.list_(pa.float32()))],
                names=["toxic", "words", "weights"])
            model.table().trim()

    return batches


class Model:
    """Weights of chosen features (ascending hashes) and an intercept."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, intercept: float):
        self.words, self.weights, self.intercept = words, weights, intercept
        self.key = ("toxicity model", xxhash.xxh3_64_intdigest(words.tobytes() + weights.tobytes()))

    def logit(self, words: np.ndarray, values: np.ndarray) -> float:
        if not len(self.words) or not len(words):
            return self.intercept
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return self.intercept + float(((self.words[at] == words) * self.weights[at] * values).sum())

    def table(self) -> WordTable:
        """Words to the places of their features among the chosen ones (-1: not chosen)."""
        return worker_cache(self.key, self._new_table)

    def _new_table(self) -> WordTable:
        spot = {int(w): k for k, w in enumerate(self.words)}

        def describe(word: str) -> tuple:
            found = [spot.get(h, -1) for h in features_of(word)]
            return (*found, *[-1] * (1 + len(STEMS) - len(found)))

        return WordTable(describe, (np.int32,) * (1 + len(STEMS)))

    def weighed(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places of a text's features among the chosen ones, ascending, with their weights in the text."""
        table = self.table()
        codes = table.codes((text or "").split())
        at = np.concatenate([table.column(k)[codes] for k in range(1 + len(STEMS))])
        at, counts = np.unique(at[at >= 0], return_counts=True)
        return at, 1 + np.log(counts)

    def logit_of(self, text: str | None) -> float:
        """``logit(*bag(text))``, looking only at features that weigh."""
        at, values = self.weighed(text)
        return self.intercept + float((self.weights[at] * values).sum())


def _identity() -> np.ndarray:
    return np.unique(np.array([h for term in _SWAPS for h in features_of(term)], dtype=np.uint64))


def _choose(words: list[np.ndarray], labels: np.ndarray, most: int) -> np.ndarray:
    """The features whose share of toxic rows is furthest from the mean, in standard errors."""
    flat = np.concatenate(words) if words else np.empty(0, np.uint64)
    seen, at = np.unique(flat, return_inverse=True)
    toxic = np.repeat(labels, [len(w) for w in words])
    total = np.bincount(at, minlength=len(seen))
    pos = np.bincount(at, weights=toxic, minlength=len(seen))
    share = labels.mean()
    z = np.abs(pos - total * share) / np.sqrt(total * share * (1 - share))
    z[total < SEEN] = 0
    top = np.argsort(-z, kind="stable")[:most]
    return np.union1d(seen[top[z[top] >= ERRORS]], np.intersect1d(_identity(), seen))


def swapped(term: str, other: str, count: dict[int, float], of_term: float) -> dict[int, float]:
    """Changes of a text's feature weights when the ``of_term`` places of a term hold another one."""
    moved: dict[int, float] = {}
    for h in features_of(term):
        moved[h] = moved.get(h, 0.0) - of_term
    for h in features_of(other):
        moved[h] = moved.get(h, 0.0) + of_term
    weight = lambda c: 1 + np.log(c) if c > 0.5 else 0.0
    return {h: weight(count.get(h, 0.0) + m) - weight(count.get(h, 0.0)) for h, m in moved.items() if m}


def fit(words: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, features: int = FEATURES, ridge: float = RIDGE, fair: float = FAIR,
        chosen: np.ndarray | None = None) -> Model:
    """Newton steps on the penalised logistic loss; on ``chosen``, or at most ``features`` words and the identity terms."""
    none = np.empty(0, dtype=np.uint64)
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        return Model(none, np.empty(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    chosen = _choose(words, labels, features) if chosen is None else chosen
    spot = {int(w): k for k, w in enumerate(chosen)}
    terms = {_hash(term): term for term in _SWAPS}
    identity = _identity()
    n = len(chosen)
    rows, cols, vals = [], [], []
    swap_rows, swap_cols, swap_vals, swaps = [], [], [], 0
    for r, (w, v) in enumerate(zip(words, values, strict=True)):
        at = np.minimum(np.searchsorted(chosen, w), max(n - 1, 0))
        hit = chosen[at] == w if n else np.zeros(len(w), bool)
        rows.append(np.full(hit.sum(), r))
        cols.append(at[hit])
        vals.append(v[hit])
        known = np.isin(w, identity)
        count = {int(x): float(np.exp(y - 1).round()) for x, y in zip(w[known], v[known], strict=True)}
        for h in [h for h in count if h in terms]:
            for other in _SWAPS[terms[h]]:
                change = [(spot[k], x) for k, x in swapped(terms[h], other, count, count[h]).items() if k in spot and x]
                swap_rows += [swaps] * len(change)
                swap_cols += [k for k, _ in change]
                swap_vals += [x for _, x in change]
                swaps += 1
    rows, cols, vals = (np.concatenate(x) if x else np.empty(0) for x in (rows, cols, vals))
    swap_rows, swap_cols, swap_vals = np.array(swap_rows, np.int64), np.array(swap_cols, np.int64), np.array(swap_vals)

    def penal(x: np.ndarray) -> np.ndarray:
        if not len(swap_vals):
            return ridge * x
        change = np.bincount(swap_rows, swap_vals * x[swap_cols], swaps)  # of the logit, by swap
        return ridge * x + fair * len(labels) / swaps * np.bincount(swap_cols, swap_vals * change[swap_rows], n)

    w, bias = np.zeros(n), float(np.log(share / (1 - share)))
    apply = lambda x: np.bincount(rows, weights=vals * x[cols], minlength=len(labels)) if len(rows) else np.zeros(len(labels))
    back = lambda x: np.bincount(cols, weights=vals * x[rows], minlength=n) if len(rows) else np.zeros(n)
    rows, cols = rows.astype(np.int64), cols.astype(np.int64)
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(bias + apply(w), -30, 30)))
        grad, grad_b = back(p - labels) + penal(w), float((p - labels).sum())
        if max(np.abs(grad).max(initial=0), abs(grad_b)) < 1e-3:
            break
        s = p * (1 - p) + 1e-6
        # conjugate gradients for the Newton step
        x, xb, r, rb = np.zeros(n), 0.0, grad.copy(), grad_b
        d, db, rr = r.copy(), rb, float(r @ r + rb * rb)
        for _ in range(60):
            q = s * (apply(d) + db)
            h, hb = back(q) + penal(d), float(q.sum())
            step = rr / float(d @ h + db * hb)
            x, xb, r, rb = x + step * d, xb + step * db, r - step * h, rb - step * hb
            new = float(r @ r + rb * rb)
            if new < 1e-8:
                break
            d, db, rr = r + new / rr * d, rb + new / rr * db, new
        w, bias = w - x, bias - xb
    return Model(chosen, w, bias)


def held_out(doc_id: F.Column, modulus: int = 5) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, train: int = TRAIN, train_bytes: int = TRAIN_BYTES, text_bytes: int = TEXT_BYTES) -> Model:
    """A model of the labelled documents that are not held out, or of the first of them within the bounds.

    Features are counted and chosen by Spark; the driver holds the chosen ones of the training rows.
    """
    usable = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    texts = docs.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), size.alias("bytes"))).alias("t")).where(F.col("t.bytes") <= text_bytes)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = usable.join(texts, "doc_id").orderBy(*order).limit(train)
    picked = picked.withColumn("upto", F.sum("t.bytes").over(Window.orderBy(*order))).where(F.col("upto") <= train_bytes)
    picked = picked.select(F.col("doc_id").alias("of_doc"), F.col("t.hash").alias("of_hash"), "toxic")
    rows = small_batches(docs).select("doc_id", "text").join(F.broadcast(picked), (F.col("doc_id") == F.col("of_doc")) & (F.xxhash64("text") == F.col("of_hash")))
    sample = rows.dropDuplicates(["doc_id"]).select("toxic", "text").persist(StorageLevel.DISK_ONLY)
    try:
        n, toxic = sample.agg(F.count("*"), F.sum("toxic")).first()
        chosen = _chosen(sample, n, toxic) if n and 0 < toxic < n else np.empty(0, np.uint64)
        table = sample.mapInArrow(_bags(chosen), BAGS).toArrow()
    finally:
        sample.unpersist()
    words = [np.asarray(x, dtype=np.int64).view(np.uint64) for x in _parts(table["words"])]
    values = [np.asarray(x, dtype=np.float64) for x in _parts(table["weights"])]
    order = sorted(range(len(words)), key=lambda k: xxhash.xxh64_intdigest(words[k].tobytes()))  # rows arrive in any order
    return fit([words[k] for k in order], [values[k] for k in order], table["toxic"].to_numpy().astype(np.float64)[order], chosen=chosen)


BAGS = "toxic int, words array<long>, weights array<float>"


def _chosen(sample: DataFrame, n: int, toxic: int, most: int = FEATURES) -> np.ndarray:
    """``_choose`` over the rows of a DataFrame ``(toxic, text)``, at most ``most`` features and the identity terms."""
    share = toxic / n
    counts = sample.mapInArrow(_counts, "word long, total long, pos long").groupBy("word").agg(F.sum("total").alias("total"), F.sum("pos").alias("pos"))
    z = F.abs(F.col("pos") - F.col("total") * share) / F.sqrt(F.col("total") * (share * (1 - share)))
    term = F.col("word").isin(_identity().view(np.int64).tolist())
    ranked = counts.withColumn("z", F.when(F.col("total") >= SEEN, z).otherwise(0.0)).withColumn("term", term).where((F.col("z") >= ERRORS) | F.col("term"))
    found = ranked.orderBy(F.desc("term"), F.desc("z"), "word").limit(most + len(_identity())).select("word").toArrow()
    return np.unique(found["word"].to_numpy().view(np.uint64))


def _parts(column: pa.ChunkedArray) -> Iterator[np.ndarray]:
    for chunk in column.chunks:
        at, flat = chunk.offsets.to_numpy(), chunk.values.to_numpy()
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield flat[a:b]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of every row of ``docs``."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows):
            z = np.array([model.logit_of(x) for x in batch.column(1).to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])
            model.table().trim()

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(batches, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``."""
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
