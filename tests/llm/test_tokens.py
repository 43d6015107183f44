import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import packing, queries, token_counts, token_orc, tokens

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n", "  two  blanks ", "Tab\tand\r\nline\n\nends \n mixed", "It's we'll DON'T o'clock 'tis", "x<|endoftext|>y <|ENDOFTEXT|> <|startoftext|>",
    "<|endoftext|>", " <|endoftext|> a", "Ünï ÀÉÎ ß ªº µ ¼ ² é", "é ño ́x İ Σασ ẞ", "漢字 かな 한국어 🙂👍🏽", "a b c\x1cd\x85e",
    "3.14 1,000 v2.0 100%", "...!!!", "word... (paren) \"quote\" a-b a_b", "a" * 5000, "the end.\nNew line", "\nlead", "trail\n", "tail ", "​ zero ﻿",
]


def texts():
    rng = random.Random(2)
    parts = ["the", "The", "straße", "niño,", "x1", "don't", ".", "\n", "  ", "\t", "<|endoftext|>", "Æther!", "é", "é", "Σ", "123", "ﬁ"]
    return ODD + ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(300)]


def ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids if path not in _libs else _libs[path].encode(text or "", add_special_tokens=False).ids


_libs = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


def test_word_ids_equal_the_library():
    encoder = tokens.WordIds(WORD)
    for _ in range(2):
        for t in texts():
            assert np.frombuffer(encoder.encode(t), "<u4").tolist() == ids(WORD, t), repr(t)


def test_frequent_words_outlive_a_full_cache(monkeypatch):
    monkeypatch.setattr(tokens, "CUTS", 20)
    monkeypatch.setattr(tokens, "WORDS", 20)
    encoder, asked = tokens.WordIds(WORD), []
    model = encoder.model
    encoder.model = type("Model", (), {"tokenize": staticmethod(lambda w: asked.append(w) or model.tokenize(w))})
    text = " ".join(f"the$$$ river, {chr(97 + k // 26 % 26)}{chr(97 + k % 26)}x" for k in range(200))
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids(WORD, text)
    assert asked.count("river") == 1 and asked.count("the") == 1 and asked.count("$$$") == 1


@pytest.mark.parametrize("frequent", [{}, {"the": 1}])
def test_counts_equal_the_library(frequent):
    counter = tokens.TieredCounts(BYTE, frequent)
    for _ in range(2):
        for t in texts():
            assert counter.count(t) == len(ids(BYTE, t)), repr(t)


def crc(x):
    return zlib.crc32(np.array(x, dtype="<u4").tobytes())


def table():
    rows = [(k, t) for k, t in enumerate(texts())]
    random.Random(1).shuffle(rows)
    return rows


def test_orc_query_and_round_trip(documents, tmp_path):
    rows = table() + [(3, ODD[3])]
    folder, df = documents(rows)
    got = queries.op1_token_orc(df.sparkSession, folder).collect()
    want, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        x = ids(WORD, text) + [2]
        want.append((doc, start, len(x), crc(x)))
        start += len(x)
    assert sorted(tuple(r) for r in got) == want
    path = f"{tmp_path}/orc"
    token_orc.write(df.withColumn("part", F.lit("clash")), path, WORD)
    found = token_orc.read(df.sparkSession, path, [18])
    assert [r.tokens for r in found.collect()] == [ids(WORD, ODD[18]) + [2]]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString() or "EqualTo(doc_id" in found._jdf.queryExecution().toString()


def test_a_small_cache_changes_no_id(monkeypatch):
    monkeypatch.setattr(tokens, "CUTS", 20)
    monkeypatch.setattr(tokens, "WORDS", 20)
    encoder, counter = tokens.WordIds(WORD), tokens.TieredCounts(BYTE)
    for t in texts():
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == ids(WORD, t) and counter.count(t) == len(ids(BYTE, t))
    assert max(map(len, (encoder, encoder.words, counter.cold))) <= 20


def test_clashing_columns_null_ids_and_long_texts(documents, tmp_path):
    rows = [(2, "long text, " * 40_000), (None, "no id"), (1, None), (1, "b"), (1, "a")]
    folder, df = documents(rows)
    clash = df.withColumn("n_tokens", F.lit("clash")).withColumn("tokens", F.lit(0)).withColumn("local_start", F.lit("x"))
    path = f"{tmp_path}/orc"
    token_orc.write(clash, path, WORD)
    got = [(r.doc_id, r.tokens) for r in token_orc.read(df.sparkSession, path).orderBy("part", "local_start").collect()]
    assert got == [(d, ids(WORD, t) + [2]) for d, t in [rows[1], rows[2], rows[4], rows[3], rows[0]]]
    counts = token_counts.count_tokens(clash, BYTE).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in counts) == sorted((str(d), len(ids(BYTE, t))) for d, t in rows)


def test_orc_files_have_row_indexes_bloom_filters_and_run_lengths(documents, tmp_path):
    folder, df = documents([(k, f"some text {k} " * 40) for k in range(12_000)])
    spark, path = df.sparkSession, tmp_path / "orc"
    token_orc.write(df.coalesce(1), f"{path}", WORD)
    orc, stripes = spark._jvm.org.apache.orc, 0
    for part in path.glob("*.orc"):
        reader = orc.OrcFile.createReader(spark._jvm.org.apache.hadoop.fs.Path(str(part)), orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
        rows = reader.rows()
        for stripe in reader.getStripes():
            stripes += 1
            footer = rows.readStripeFooter(stripe)
            streams = {(s.getKind().toString(), s.getColumn()) for s in footer.getStreamsList()}
            assert {("ROW_INDEX", c) for c in range(6)} <= streams and ("BLOOM_FILTER_UTF8", 3) in streams  # column 3 is doc_id
            assert {footer.getColumns(c).getKind().toString() for c in range(1, 7)} == {"DIRECT_V2"}
        rows.close()
        assert reader.getRowIndexStride() == 5000
    assert stripes >= 1
    ids_read = [r.doc_id for r in token_orc.read(spark, str(path)).orderBy("part", "local_start").select("doc_id").collect()]
    assert ids_read == list(range(12_000))


def test_counts_query(documents):
    rows = table() + [(3, ODD[3]), (None, "no id")]
    folder, df = documents(rows)
    got = queries.op7_token_counts(df.sparkSession, folder).collect()
    want = [(d, len((t or "").encode()), n := len(ids(BYTE, t)), n > 1024) for d, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_packing_query(documents):
    rng = random.Random(4)
    rows = table() + [(1000 + k, "word " * rng.randint(1, 6000)) for k in range(60)] + [(1000, "same id"), (None, "no id")]
    folder, df = documents(rows)
    got = queries.op5_packing(df.sparkSession, folder).collect()
    want = []
    for doc, text in rows:
        x = ids(WORD, text) + [0]
        want += [(doc, p, s, len(x[s : s + 2048]), crc(x[s : s + 2048])) for p, s in enumerate(range(0, len(x), 2048))]
    assert sorted(str(tuple(r)[:5]) for r in got) == sorted(map(str, want))
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 1


def test_stored_sequences_hold_the_tokens_in_order(documents, tmp_path):
    rng = random.Random(5)
    rows = [(k, "some words here " * rng.randint(0, 900)) for k in range(40)] + [(None, "no id"), (3, None)]
    folder, df = documents(rows)
    clash = df.withColumn("uid", F.lit("clash")).withColumn("block", F.lit(-1)).withColumn("tokens", F.lit("x"))
    path = f"{tmp_path}/sequences"
    packing.write_sequences(clash, path, WORD)
    whole = {}
    for r in packing.read_sequences(df.sparkSession, path).collect():
        at = 0
        for p in r.pieces:
            assert p.offset == at and p.length > 0
            whole.setdefault((p.doc_id, p.piece, p.start), []).append(tuple(r.tokens[at : at + p.length]))
            at += p.length
        assert at == len(r.tokens) <= packing.SIZE
    want = {}
    for doc, text in rows:
        x = ids(WORD, text) + [0]
        for p, s in enumerate(range(0, len(x), 2048)):
            want.setdefault((doc, p, s), []).append(tuple(x[s : s + 2048]))
    assert {k: sorted(v) for k, v in whole.items()} == {k: sorted(v) for k, v in want.items()}


def least_bins(lengths, size):
    """The fewest bins, by trying all ways."""
    best = [len(lengths)]

    def put(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for n in range(len(bins)):
            if bins[n] + lengths[k] <= size:
                put(k + 1, [*bins[:n], bins[n] + lengths[k], *bins[n + 1 :]])
        put(k + 1, [*bins, lengths[k]])

    put(0, [])
    return best[0]


def test_packing_of_few_pieces_against_all_ways():
    rng = random.Random(13)
    worse = first = 0
    for _ in range(150):
        lengths = [rng.randint(10, 70) for _ in range(rng.randint(1, 9))]
        least, bins = least_bins(lengths, 100), packing.pack(lengths, 100)
        assert least <= len(bins) <= least + 1
        worse += len(bins) > least
        first += len(packing.best_fit(lengths, 100)) > least
    assert worse <= first and worse <= 7


def brute_steps(lengths, bins, size):
    """Whether some move or exchange of one for one or two for one between underfull bins raises the sum of squares."""
    fill = lambda b: sum(lengths[i] for i in b)
    under = [b for b in bins if fill(b) < size]
    for a in under:
        for b in under:
            if a is b or fill(b) < fill(a):
                continue
            outs = [(i,) for i in a] + [(i, j) for i in a for j in a if i < j]
            backs = [()] + [(i,) for i in b] + [(i, j) for i in b for j in b if i < j]
            for out in outs:
                for back in backs:
                    gain = fill(out) - fill(back)
                    if gain > 0 and fill(b) + gain <= size and not (len(out) == 2 == len(back)):
                        return True
    return False


def test_local_search_ends_where_no_step_is_left():
    rng = random.Random(17)
    for n in range(25):
        lengths = [rng.randint(1, 70) for _ in range(rng.randint(2, 40))]
        bins = packing.pack(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert len(bins) == -(-sum(lengths) // 100) or not brute_steps(lengths, bins, 100)


def test_local_search_beats_best_fit():
    rng = random.Random(7)
    better = 0
    for _ in range(40):
        lengths = [rng.randint(1, 60) for _ in range(rng.randint(0, 60))]
        first, bins = packing.best_fit(lengths, 100), packing.pack(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 100 for b in bins)
        assert len(bins) <= len(first)
        better += len(bins) < len(first)
    assert packing.pack([40, 40, 40, 30, 30, 20], 100).__len__() == 2
    assert len(packing.best_fit([44, 44, 34, 34, 22, 22], 100)) >= len(packing.pack([44, 44, 34, 34, 22, 22], 100)) == 2


def test_empty_tables(documents):
    folder, df = documents([])
    for name in ("op1_token_orc", "op5_packing", "op7_token_counts"):
        assert queries.QUERIES[name](df.sparkSession, folder).count() == 0
    assert token_counts.frequent_words(df) == []
