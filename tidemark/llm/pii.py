r"""Personal data by weak supervision, in DataFrame functions alone.

Base spans are what fixed rules find: e-mail addresses, IPv4 addresses, card numbers with a right Luhn
digit, international phone numbers. Wider patterns give candidates beside them: written-out and
bracketed addresses, IPv6 and bracketed IPv4, cards of 13 to 15 digits, phone numbers without a plus.
Every span, base or not, gets votes (for, against, none) from five labelers: its shape by regular
expressions, its check digits and lengths, gazetteers (top-level domains, issuers, country and area
codes), words before it, and the characters round it. Expectation-maximisation over all spans estimates
how reliable each labeler is on each kind, how many base spans and candidates of it are personal data, and
the probability that a span is; with these as soft labels a naive Bayes classifier of votes and surface
features is fitted on the candidates, about which it decides. Base spans always stay.

Texts are scanned once and leave one slim row each. The spans are counted by kind, votes and features,
a bounded table (``8 * 3**5 * 48`` rows at most) on which all estimation runs; its last form, the set
of accepted patterns, goes back into the plan as a literal. Nothing is joined, and no text is shuffled.

The patterns are written so that each is linear in the text: runs are taken whole (possessively), and an
e-mail's run is tried at its beginning only, or where the last match ended. They find what the plain
forms ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``, ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)``,
``[0-9]([\x20-]?[0-9])+`` and ``\+[0-9][\x20().0-9-]+[0-9]`` find from the left without overlaps; what
then fails a rule is dropped and not tried again. Candidates lie between the base pattern's matches, or
are such matches that a rule of base spans drops.

Defined results: null and empty texts have no spans; each row has its row, repeated rows and ids and null
ids too; an empty table gives no rows; other columns are ignored. Places are code points.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Patterns of candidates; a card candidate is a match of the base pattern.
WIDE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?: at |[\x20]?[\[({] ?at ?[\])}][\x20]?)[A-Za-z0-9-]{1,63}(?:(?: dot |[\x20]?[\[({] ?dot ?[\])}][\x20]?)[A-Za-z0-9-]{1,63}){1,4}(?![A-Za-z0-9-])",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3})(?![0-9A-Za-z:.])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
}
#: Strings without which no pattern of a kind matches; texts without them are not scanned.
NEEDS = {"email": "@", "phone": "+"}
LEFT, RIGHT = 40, 8
#: Labelers and features see so many characters of a span; base rules see all.
SEEN = 256
#: Fixed values of the gazetteers and context labelers.
TOP_DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|co|ai|app|dev|me|tv|eu|uk|de|fr|es|it|nl|be|ch|at|se|no|dk|fi|pl|pt|ie|cz|gr|hu|ro|ru|ua|tr|us|ca|mx|br|ar|cl|au|nz|jp|cn|kr|in|za"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6011|65|64[4-9]|35|62)"
RESERVED = r"^(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])[.\[]"
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
FOR = {
    "email": r"(?i)\b(?:e-?mails?|mail|contact|write|reach|address|correo|courriel|kontakt)\b",
    "ip": r"(?i)\b(?:ips?|ipv[46]|address|host|server|client|login|from|remote|source)\b",
    "card": r"(?i)\b(?:cards?|credit|debit|visa|mastercard|amex|payment|pan|tarjeta|carte|karte)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|contact|teléfono|téléphone|telefon)\b",
}
AGAINST = {
    "email": r"(?i)\b(?:example|meet|look|arrive)\b",
    "ip": r"(?i)\b(?:versions?|release|section|chapter|firmware|build|v)\b",
    "card": r"(?i)\b(?:order|invoice|isbn|serial|tracking|part|id|doi|token|sku|ref)\b",
    "phone": r"(?i)\b(?:order|invoice|isbn|serial|tracking|part|id|version|ref|sku)\b",
}
LABELERS = 5
#: Values of the surface features: length classes, separators, whether a digit is repeated throughout.
FEATURES = (4, 4, 3)
ROUNDS = 25
SMOOTH = 1.0
ACCEPT = 0.5
SPAN = "struct<kind:int,start:int,end:int,base:boolean,votes:array<int>,features:array<int>>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sum(steps: Column, block: int = 256) -> Column:
    """Inclusive running sums of an array, by blocks, so that no array is copied once for each of its entries."""
    add = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))
    none = F.array().cast("array<int>")

    def blocks(whole: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / block).cast("int"))
        return F.transform(starts, lambda k: F.aggregate(F.slice(whole, k * block + 1, F.lit(block)), none, add))

    def shifted(parts: Column) -> Column:
        totals = F.aggregate(F.transform(parts, lambda p: F.element_at(p, -1)), none, add)
        return F.flatten(F.zip_with(parts, F.concat(F.array(F.lit(0)), F.slice(totals, 1, F.size(parts) - 1)), lambda p, t: F.transform(p, lambda x: x + t)))

    summed = bound(steps, lambda whole: bound(blocks(whole), shifted))
    return F.when(F.size(steps) > 0, summed).otherwise(none)


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, hit, left, right, piece>>``: matches from the left, what surrounds them, and the piece before each.

    A last entry without a hit has the piece after the last match.
    """

    def placed(pieces: Column, hits: Column) -> Column:
        sizes = F.zip_with(pieces, hits, lambda p, h: F.length(p) + F.coalesce(F.length(h), F.lit(0)))
        following = F.zip_with(hits, F.slice(pieces, 2, F.size(hits)), lambda h, p: F.struct(h.alias("hit"), F.substr(p, F.lit(1), F.lit(RIGHT)).alias("right")))
        joined = F.zip_with(pieces, following, lambda p, f: F.struct(p.alias("piece"), f.hit.alias("hit"), f.right.alias("right")))
        return F.zip_with(joined, running_sum(sizes), lambda j, end: F.struct(
            (end - F.coalesce(F.length(j.hit), F.lit(0))).alias("start"), end.alias("end"), j.hit.alias("hit"), F.right(j.piece, F.lit(LEFT)).alias("left"), j.right.alias("right"), j.piece.alias("piece")))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return bound(F.split(text, pattern, -1), lambda pieces: bound(hits, lambda h: placed(pieces, h)))


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right Luhn digit."""
    value = lambda k: F.substr(number, F.length(number) - k, F.lit(1)).cast("int") * (1 + k % 2)
    total = F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), lambda acc, k: acc + value(k) - F.when(value(k) > 9, 9).otherwise(0))
    return total % 10 == 0


def is_base(kind: str, hit: Column) -> Column:
    """Whether a match of the base pattern keeps the kind's rule."""
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
        return hit.rlike(rf"^(?:{part}\.){{3}}{part}$")
    n = F.length(digits(hit))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits(hit))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def is_candidate(kind: str, hit: Column) -> Column:
    """Whether a match that is no base span may be one all the same: cards of 13 to 15 digits."""
    n = F.length(digits(hit))
    return F.when(n.between(13, 15), luhn(digits(hit)) & hit.rlike(ISSUERS)).otherwise(False) if kind == "card" else F.lit(False)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(good, 1).when(bad, -1).otherwise(0)


def labels(kind: str, m: Column) -> Column:
    """The votes of the five labelers on a match."""
    hit = F.left(m.hit, F.lit(SEEN))
    n = F.length(digits(hit))
    shape = {
        "email": _vote(hit.rlike(r"^[A-Za-z][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}$|^[A-Za-z]+[._0-9]|[\[({]"), hit.rlike(r"^[0-9._%+-]+(?:@| at )|\.[0-9]+$|^[A-Za-z]+ at [A-Za-z]+ dot [A-Za-z]+$")),
        "ip": _vote(hit.rlike(r"^[1-9][0-9]{0,2}(?:\.(?:0|[1-9][0-9]{0,2})){3}$"), hit.rlike(r"^0|[.]0[0-9]")),
        "card": _vote(hit.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})$"), hit.rlike(r"[ -][0-9][ -]")),
        "phone": _vote(hit.rlike(r"^(?:\+[0-9]{1,3})?[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}$"), hit.rlike(r"[.() -]{3}")),
    }[kind]
    checks = {
        "email": _vote(F.lit(False), F.length(hit) > 64),
        "ip": _vote(~hit.rlike("(?:^|[.])(?:0|255)(?:[.]|$)"), hit.rlike(r"^(?:0|255)[.]")),
        "card": _vote(luhn(digits(hit)), ~luhn(digits(hit))),
        "phone": _vote(n.between(10, 13), n < 9),
    }[kind]
    gazetteer = {
        "email": _vote(hit.rlike(rf"(?i)(?:[.\x20\])}}])(?:{TOP_DOMAINS})[)\]}}]?$"), ~hit.rlike(rf"(?i)(?:[.\x20\])}}])(?:{TOP_DOMAINS})[)\]}}]?$")),
        "ip": _vote(~hit.rlike(RESERVED), hit.rlike(RESERVED)),
        "card": _vote(hit.rlike(ISSUERS), hit.rlike("^[01789]")),
        "phone": _vote(hit.rlike(COUNTRY) | hit.rlike(r"^\(?[2-9][0-9]{2}"), hit.rlike(r"^\(?[01]")),
    }[kind]
    context = _vote(m.left.rlike(FOR[kind]), m.left.rlike(AGAINST[kind]))
    edges = _vote(m.left.rlike(r"(?:^|[\s(<\[:,;|])$") & F.coalesce(m.right, F.lit("")).rlike(r"^(?:$|[\s)>\],;:.!?|])"), m.left.rlike(r"[A-Za-z0-9=/_#]$") | F.coalesce(m.right, F.lit("")).rlike(r"^[A-Za-z0-9=/_]"))
    return F.array(shape, checks, gazetteer, context, edges)


def surface(hit: Column) -> Column:
    """Surface features of a match, small numbers below ``FEATURES``."""
    size, hit = F.length(hit), F.left(hit, F.lit(SEEN))
    length = F.when(size < 12, 0).when(size < 17, 1).when(size < 25, 2).otherwise(3)
    marks = F.when(~hit.rlike(r"[^A-Za-z0-9]"), 0).when(hit.rlike(r"[\x20]"), 1).when(hit.rlike(r"[()\[\]{}]"), 2).otherwise(3)
    same = F.when(hit.rlike(r"([0-9])\1{5}"), 2).when(hit.rlike("[0-9]"), 1).otherwise(0)
    return F.array(length, marks, same)


def _spans(text: Column, kind: str) -> Column:
    """Base spans and candidates of one kind, in order."""
    number = KINDS.index(kind)
    made = lambda m, start, base: F.struct(
        F.lit(number).alias("kind"), start.alias("start"), (start + F.length(m.hit)).alias("end"), base.alias("base"), labels(kind, m).alias("votes"), surface(m.hit).alias("features"))

    def of(found: Column) -> Column:
        hits = F.filter(found, lambda m: m.hit.isNotNull())
        ruled = F.transform(hits, lambda m: F.struct(m.alias("m"), is_base(kind, m.hit).alias("base"), is_candidate(kind, m.hit).alias("maybe")))
        spans = F.transform(F.filter(ruled, lambda r: r.base | r.maybe), lambda r: made(r.m, r.m.start, r.base))
        if kind not in WIDE:
            return spans
        pieces = F.filter(found, lambda m: m.piece.rlike(WIDE[kind]))
        inside = lambda piece, start: F.transform(F.filter(matches(piece, WIDE[kind]), lambda m: m.hit.isNotNull()), lambda m: made(m, start + m.start, F.lit(False)))
        wide = F.flatten(F.transform(pieces, lambda m: inside(m.piece, m.start - F.length(m.piece))))
        return F.when(F.size(pieces) > 0, F.array_sort(F.concat(spans, wide))).otherwise(spans)

    known = bound(matches(text, BASE[kind]), of)
    needed = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike(BASE[kind])
    return F.when(needed | text.rlike(WIDE[kind]) if kind in WIDE else needed, known).otherwise(F.array().cast(f"array<{SPAN}>"))


def candidates(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)`` of every row: base spans and candidates by kind and place, with votes and features."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.concat(*[_spans(text, k).cast(f"array<{SPAN}>") for k in KINDS]).alias("spans"))


def patterns(spans: DataFrame) -> DataFrame:
    """``(kind, base, votes, features, n)``: how many spans of each kind have the same votes and features."""
    return spans.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.base", "s.votes", "s.features").agg(F.count("*").alias("n"))


def _group() -> Column:
    """The class balance is one of base spans of a kind and another of its candidates."""
    return F.col("kind") + F.when(F.col("base"), 0).otherwise(len(KINDS))


def _log_odds(prior: list[float], weights: list[list[list[float]]], values: Column, shift: int) -> Column:
    """Log odds of a pattern; ``prior[group]``, and ``weights[kind][j][value]`` of its j-th value."""
    own = F.element_at(F.lit(weights), F.col("kind") + 1)
    parts = F.zip_with(own, values, lambda w, v: F.element_at(w, v + shift))
    return F.element_at(F.lit(prior), _group() + 1) + F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)


def _sums(table: DataFrame, chance: Column, values: Column, shift: int, sizes: list[int]) -> tuple[list[list[float]], list[list[list[list[float]]]]]:
    """Weights of the spans that are personal data, and of those that are not: of each group, and of each kind, place and value."""
    q = F.col("n") * chance
    sums = [F.sum(q).alias("yes"), F.sum(F.col("n") - q).alias("no")]
    for j, size in enumerate(sizes):
        for v in range(size):
            here = F.element_at(values, j + 1) == v + 1 - shift
            sums += [F.sum(F.when(here, x).otherwise(0.0)).alias(f"{c}_{j}_{v}") for c, x in (("yes", q), ("no", F.col("n") - q))]
    rows = table.groupBy("kind", "base", _group().alias("group")).agg(*sums).collect()  # a row for each kind, of base spans and of candidates
    groups = [[sum(r[c] for r in rows if r["group"] == g) for c in ("yes", "no")] for g in range(2 * len(KINDS))]
    kinds = [[[[sum(r[f"{c}_{j}_{v}"] for r in rows if r["kind"] == k) for c in ("yes", "no")] for v in range(size)] for j, size in enumerate(sizes)] for k in range(len(KINDS))]
    return groups, kinds


def _odds(yes: float, no: float) -> float:
    return log((yes + SMOOTH) / (no + SMOOTH))


def _shares(counts: list[list[float]]) -> list[float]:
    """For each value, the log of its share among ``yes`` over its share among ``no``."""
    yes, no = (sum(c[k] for c in counts) + SMOOTH * len(counts) for k in (0, 1))
    return [log((c[0] + SMOOTH) / yes) - log((c[1] + SMOOTH) / no) for c in counts]


def _vote_weights(counts: list[list[float]]) -> list[float]:
    """Weights of a vote against, none and for: none says nothing, and no labeler is believed to be worse than chance."""
    against, for_it = _shares([counts[0], counts[2]])
    return [min(against, 0.0), 0.0, max(for_it, 0.0)]


def reliabilities(table: DataFrame, rounds: int = ROUNDS) -> tuple[list[float], list[list[list[float]]]]:
    """Log odds of each group and of each vote (against, none, for) of each labeler on each kind, by expectation-maximisation.

    It begins with the majority's opinion.
    """
    votes = F.col("votes")
    odds = F.aggregate(votes, F.lit(0.0), lambda acc, x: acc + x)
    fitted = None
    for _ in range(rounds):
        groups, kinds = _sums(table, _chance(odds), votes, 2, [3] * LABELERS)
        before, fitted = fitted, ([_odds(*g) for g in groups], [[_vote_weights(place) for place in kind] for kind in kinds])
        odds = _log_odds(*fitted, votes, 2)
        if before and max(abs(a - b) for a, b in zip(_flat(before), _flat(fitted), strict=True)) < 1e-4:
            break
    return fitted


def _chance(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def _flat(x) -> list[float]:
    return [v for y in x for v in _flat(y)] if isinstance(x, list | tuple) else [x]


def scored_patterns(table: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The candidates of ``table`` with ``label``, the chance by the labelers, and ``score``, that of the span classifier fitted on it."""
    odds = _log_odds(*reliabilities(table, rounds), F.col("votes"), 2)
    labelled = table.where("not base").withColumn("label", _chance(odds))
    values = F.concat(F.transform("votes", lambda v: v + 1), "features")
    groups, kinds = _sums(labelled, F.col("label"), values, 1, [3] * LABELERS + list(FEATURES))
    classifier = _log_odds([_odds(*g) for g in groups], [[_shares(place) for place in kind] for kind in kinds], values, 1)
    return labelled.withColumn("score", F.round(_chance(classifier), 6))


def pattern_code(kind: Column, votes: Column, features: Column) -> Column:
    """One number for a span's kind, votes and features."""
    base = max(3, *FEATURES)
    values = F.concat(F.transform(votes, lambda v: v + 1), features)
    return F.aggregate(values, kind.cast("long"), lambda acc, v: acc * base + v)


def find(docs: DataFrame, accept: float = ACCEPT, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, spans)`` of every row: ``spans`` has ``(kind, start, end, base)``, all base spans and the candidates accepted."""
    spans = materialize(candidates(docs), "pii-spans")
    table = materialize(patterns(spans).coalesce(1), "pii-patterns")
    accepted = scored_patterns(table, rounds).where(F.col("score") >= accept).select(pattern_code(F.col("kind"), F.col("votes"), F.col("features")).alias("code"))
    codes = sorted(r.code for r in accepted.collect())  # a bounded table, see above
    fits = lambda s: F.array_contains(F.lit(codes), pattern_code(s.kind, s.votes, s.features)) if codes else F.lit(False)
    kept = F.filter("spans", lambda s: s.base | fits(s))
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s.kind + 1)
    return spans.select("doc_id", F.transform(kept, lambda s: F.struct(kind(s).alias("kind"), s.start.alias("start"), s.end.alias("end"), s.base.alias("base"))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)``; counts are of base spans, ``n_added`` of the others."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.filter("spans", lambda s: s.base)
    number = lambda k: F.size(F.filter("spans", lambda s: s.base & (s.kind == k))).cast("long")
    return found.select(
        "doc_id", *[number(k).alias(f"n_{k}") for k in KINDS], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s.base)).cast("long").alias("n_added"))
