import random
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import queries, substrings

GEAR = [xxhash.xxh32_intdigest(bytes([b]), 7) & 0xFFFF for b in range(256)]


BLANKS = b" \t\n\x0b\x0c\r"


def brute_chunks(data):
    """(start, end) of the chunks of one text, byte by byte."""
    proposed, hashes, h = [], [], 0
    for i, b in enumerate(data):
        h = (h << 1 & 0xFFFF) + GEAR[b] & 0xFFFF
        hashes.append(h)
        if i + 1 >= 16 and h < 65536 // 16:
            proposed.append(i + 1)
    cuts = [c for k, c in enumerate(proposed) if not k or c - proposed[k - 1] >= 8]
    ends = sorted({*cuts, len(data)} - {0})
    further, at = [], 0
    for e in ends:
        if e - at > 64:
            last = at
            for c in range(at + 16, e):
                if c >= 48 and c - last >= 16 and hashes[c - 1] == min(hashes[c - 32 : c]):
                    further.append(c)
                    last = c
        at = e
    out, at = [], 0
    for e in sorted({*ends, *further}):
        while e - at > 2048:
            out.append((at, at + 2048))
            at += 2048
        out.append((at, e))
        at = e
    return out, set(further)


def brute_pairs(data):
    """(start, end, where a passage may begin, where it may end) of each chunk with the next one, or of a lone chunk."""
    chunks, further = brute_chunks(data)
    if len(chunks) == 1:
        return [(*chunks[0], *chunks[0])]
    n = len(chunks)
    lead = lambda at: max(0, at - (48 if at in further else 24))
    return [(chunks[k][0], chunks[k + 1][1], lead(chunks[max(k - 1, 0)][0]), chunks[min(k + 2, n - 1)][1]) for k in range(n - 1)]


def runs_that_count(data, repeated):
    """Runs of repeated pairs of a text that overlap: over 50 words with what is around them, or 1024 bytes."""
    heads = [k for k in range(len(data)) if data[k] not in BLANKS and (not k or data[k - 1] in BLANKS)]
    run = []
    for p in [*brute_pairs(data), None]:
        if p and repeated(p) and (not run or p[0] < run[-1][1]):
            run.append(p)
            continue
        if run and (sum(run[0][2] <= k < max(x[3] for x in run) for k in heads) > 50 or run[-1][1] - run[0][0] >= 1024):
            yield run
        run = [p] if p and repeated(p) else []


def brute_spans(rows, within=True):
    owners, places, found = defaultdict(set), defaultdict(set), set()
    for n, (d, t) in enumerate(dict.fromkeys(rows)):
        data = (t or "").encode()
        for p in brute_pairs(data) if data else []:
            owners[data[p[0] : p[1]]].add(d)
            places[n, data[p[0] : p[1]]].add(p[0])
    twice = {x for (n, x), at in places.items() if len(at) > 1} if within else set()
    for n, (d, t) in enumerate(dict.fromkeys(rows)):
        data = (t or "").encode()
        if not data:
            continue
        again = lambda p: len(owners[data[p[0] : p[1]]]) > 1 or data[p[0] : p[1]] in twice
        for run in runs_that_count(data, again):
            extra = set()
            for p in run:
                x = data[p[0] : p[1]]
                if d > min(owners[x]) or within and min(places[n, x]) < p[0]:
                    extra |= set(range(p[0], p[1]))
            found.add((d, run[0][0], run[-1][1], len(run), len(extra)))
    return found


def rows_with_repeats():
    rng = random.Random(8)
    vocabulary = [f"{a}{b}é" if k % 5 == 0 else f"{a}{b}" for k, (a, b) in enumerate((x, y) for x in "bdfgklmn" for y in ("ara", "iso", "unte", "el"))]
    prose = lambda n: " ".join(rng.choice(vocabulary) + str(rng.randint(0, 99)) for _ in range(n))
    passages = [prose(60) for _ in range(4)]
    rows = [(k, prose(rng.randint(5, 120))) for k in range(20)]
    for k in range(20, 40):
        rows.append((k, prose(rng.randint(0, 50)) + " " + rng.choice(passages) + " " + prose(rng.randint(0, 50))))
    rows += [(50, None), (51, ""), (52, "a" * 9000), (53, "a" * 9000), (54, prose(20_000)), (25, rows[25][1])]
    return rows, passages


def test_query_against_brute_force(documents):
    rows, _ = rows_with_repeats()
    folder, df = documents(rows)
    got = [tuple(r) for r in queries.op3_substrings(df.sparkSession, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spans(rows)
    assert {r[0] for r in got} == {*range(20, 40), 52, 53}


def test_repeats_across_documents_alone(documents):
    rows, _ = rows_with_repeats()
    folder, df = documents(rows)
    got = [tuple(r) for r in substrings.spans(df, within=False).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spans(rows, within=False)


def test_repeats_within_a_document(documents):
    rows, passages = rows_with_repeats()
    a, b = passages[:2]
    rows = [x for x in rows if x[0] not in (25, 54)] + [(70, f"{a} {b} once more {a} in between {a}"), (71, "lines of one text\n" * 40), (72, "ab " * 800)]
    folder, df = documents(rows)
    got = [tuple(r) for r in substrings.spans(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spans(rows)
    assert {70, 71, 72} <= {r[0] for r in got}
    kept = {r.doc_id: r.text for r in substrings.remove_repeats(df.where("doc_id = 70")).collect()}
    assert kept[70].count(a[80:-80]) == 1 and b in kept[70]


def word_grams(text, size=51):
    """(text of the gram, its bytes) of each run of so many words."""
    words = list(re.finditer(rb"[^ \t\n\x0b\x0c\r]+", text.encode()))
    for k in range(len(words) - size + 1):
        yield b" ".join(w[0] for w in words[k : k + size]), words[k].start(), words[k + size - 1].end()


@pytest.mark.parametrize("n_words", [51, 60, 120, 401])
def test_every_repeated_gram_is_in_a_span(documents, n_words):
    """Passages of one period (a word, a line, 30 bytes) and of prose, in other surroundings each time: every gram of 51 words that stands twice is found."""
    rng = random.Random(n_words)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(n))
    units = ["ha ", "red fish swim past ", "lorem ", "one two three four five six\n", prose(6)[:30].strip() + " ", "aa bb ", prose(9) + " ", "x y zz "]
    passages = [((u * n_words).split(" ")) for u in units] + [prose(n_words).split(" ") for _ in range(6)]
    passages = [" ".join(p[:n_words]) for p in passages]
    rows = [(100 * k + j, f"{prose(rng.randint(0, 9))} {p} {prose(rng.randint(0, 60))}".strip()) for k, p in enumerate(passages) for j in range(2)]
    rows += [(5000 + k, prose(300)) for k in range(30)]
    folder, df = documents(rows)
    found = defaultdict(list)
    for r in substrings.spans(df).collect():
        found[r.doc_id].append((r.span_start, r.span_end))
    seen = defaultdict(list)
    for d, t in rows:
        for gram, a, b in word_grams(t):
            seen[gram].append((d, a, b))
    repeated = [x for places in seen.values() if len(places) > 1 for x in places]
    assert len(repeated) > 2 * len(passages)
    for d, a, b in repeated:
        assert any(s < b and a < e for s, e in found[d]), (d, a, b, found[d])
    assert set(found) == {d for d, _, _ in repeated}  # and no other document is marked


def test_characters_stay_whole(documents):
    rng = random.Random(3)
    prose = lambda n: "".join(rng.choice("漢字仮名交文日本語書") for _ in range(n))
    passage = prose(900)
    texts = [prose(200) + passage + prose(200), prose(300) + passage + prose(100)]
    folder, df = documents([(1, texts[0]), (2, texts[1])])
    kept = {r.doc_id: r.text for r in substrings.remove_repeats(df).collect()}
    assert kept[1] == texts[0] and len(kept[2]) < len(texts[1]) - 600
    begin, rest = 0, texts[1]
    while kept[2][begin : begin + 1] == rest[begin]:
        begin += 1
    assert begin >= 300 and rest.endswith(kept[2][begin:])


def test_remove_repeats_keeps_the_first(documents):
    rows, passages = rows_with_repeats()
    folder, df = documents(rows)
    extra = df.withColumn("digest", F.lit("clash"))
    kept = substrings.remove_repeats(extra)
    assert kept.columns == extra.columns and dict(kept.dtypes) == dict(extra.dtypes)
    texts = defaultdict(list)
    for r in kept.collect():
        texts[r.doc_id].append(r.text)
        assert r.n_chars == len(r.text or "")
    for p in passages:
        assert len({(d, t) for d, x in texts.items() for t in x if t and p in t}) == 1
    for d, t in rows[:20] + [(50, None), (51, "")]:
        assert texts[d] == [t]
    assert [set(t) for t in texts[52]] == [{"a"}] and len(texts[52][0]) < 100  # it repeats itself
    assert 53 not in texts  # nothing of it is left
    assert len(texts[25]) == 2


def test_null_ids_and_empty_table(documents):
    text = rows_with_repeats()[1][0]
    folder, df = documents([(None, text), (7, text)])
    assert {r.doc_id for r in substrings.spans(df).collect()} == {None, 7}
    assert [r.doc_id for r in substrings.remove_repeats(df).collect()] == [None]
    assert substrings.spans(df.limit(0)).count() == 0
