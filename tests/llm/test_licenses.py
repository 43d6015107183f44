import random

from pyspark.sql import functions as F

from tidemark.llm import licenses, queries
from tidemark.llm.words import bare


def brute(docs, notices):
    """Whole occurrences of a template by words."""
    found = set()
    for d, t in docs:
        words = [bare(w) for w in (t or "").split()]
        for name, text in notices.items():
            own = [bare(w) for w in text.split()]
            for p in range(len(words) - len(own) + 1):
                if words[p : p + len(own)] == own:
                    found.add((d, name, p, p + len(own)))
    return found


def test_query_finds_every_whole_notice(documents):
    rng = random.Random(9)
    filler = lambda n: " ".join(rng.choice(["of", "the", "thing", "license", "work", "mit"]) for _ in range(n))
    names = sorted(licenses.NOTICES)
    docs = [(k, f"{filler(rng.randint(0, 70))} {licenses.NOTICES[names[k % len(names)]].upper() if k % 3 else licenses.NOTICES[names[k % len(names)]]} {filler(rng.randint(0, 70))}") for k in range(120)]
    docs += [(200, None), (201, ""), (202, filler(20_000)), (5, docs[5][1]), (None, docs[6][1]), (203, filler(3)), (204, "rights reserved")]
    folder, df = documents(docs)
    got = queries.op4_licenses(df.sparkSession, folder).collect()
    whole = {(r.doc_id, r.license, r.first_word, r.last_word) for r in got if r.containment == 1.0}
    want = brute(docs, licenses.NOTICES)
    assert whole == want and len(want) >= 120
    assert not {200, 201, 202, 203, 204} & {r.doc_id for r in got}
    assert len(got) == len({tuple(r) for r in got}) + 1  # the repeated row repeats its own


def test_edited_notice_and_bad_templates(documents):
    words = licenses.NOTICES["mit-grant"].split()
    words[20] = "changed"
    folder, df = documents([(1, "before it " + " ".join(words) + " after it"), (2, " ".join(words[:25]))])
    got = licenses.scan(df, {**licenses.NOTICES, "empty": "", "blank": " "}).collect()
    assert [(r.doc_id, r.license) for r in got] == [(1, "mit-grant")] and 0.8 <= got[0].containment < 1
    assert licenses.scan(df.limit(0)).count() == 0 and licenses.scan(df, {"e": ""}).count() == 0


def test_common_licenses_are_known(documents):
    lines = {
        "mit-notice": "Licensed under the MIT License", "lgpl-2.1": "Released under the GNU Lesser General Public License v2.1",
        "agpl-3.0": "SPDX-License-Identifier: AGPL-3.0-or-later", "gpl-2.0": "Licensed under the GNU General Public License, version 2.",
        "mpl-2.0": "Licensed under the Mozilla Public License 2.0.", "epl-2.0": "Distributed under the Eclipse Public License v2.0",
        "isc": "Licensed under the ISC License.", "unlicense": "Released under the Unlicense", "bsd-3-clause": "Licensed under the BSD 3-Clause License",
        "cc0-1.0": "Licensed under CC0 1.0.", "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0.",
    }
    bodies = {k: v for k, v in licenses.catalogue().items() if k.endswith(("-body", "-warranty"))}
    docs = list(enumerate([f"some text before. {x} and some text after" for x in [*lines.values(), *bodies.values()]]))
    folder, df = documents(docs)
    got = {}
    for r in queries.op4_licenses(df.sparkSession, folder).collect():
        got.setdefault(r.doc_id, {})[r.license] = r.containment
    for k, name in enumerate(lines):
        assert got[k] and all(x.startswith(name) for x in got[k]), (name, got[k])
    for k, name in enumerate(bodies, len(lines)):
        assert got[k][name] == 1.0
    assert len(bodies) >= 20


def test_headers_tell_versions_and_kinds(documents):
    header = "you can redistribute it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or any later version"
    cases = [("", "2", "gpl-2.0"), ("", "3", "gpl-3.0"), ("Lesser ", "2.1", "lgpl-2.1"), ("Lesser ", "3", "lgpl-3.0"), ("Affero ", "3", "agpl-3.0")]
    folder, df = documents([(k, header.format(a, b)) for k, (a, b, _) in enumerate(cases)])
    got = {(r.doc_id, r.license) for r in licenses.scan(df).collect() if r.license.endswith("-or-later-header")}
    assert got == {(k, f"{name}-or-later-header") for k, (_, _, name) in enumerate(cases)}


def test_recall_of_occurrences_that_hold_four_fifths(documents):
    """Templates of all classes with words changed so that just 0.8 of the shingles or more are left, anywhere in a text."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    notices = {f"t{n}": " ".join(word() for _ in range(n)) for n in (20, 31, 36, 64, 69, 120, 250)}
    docs, want = [], {}
    for k in range(420):
        name = rng.choice(sorted(notices))
        words = notices[name].split()
        for _ in range(max(1, (len(words) - 4) // 25)):  # a changed word costs five shingles at most
            words[rng.randrange(len(words))] = word()
        own = {tuple(notices[name].split()[p : p + 5]) for p in range(len(words) - 4)}
        kept = len(own & {tuple(words[p : p + 5]) for p in range(len(words) - 4)}) / len(own)
        docs.append((k, " ".join([*(word() for _ in range(rng.randrange(300))), *words, *(word() for _ in range(rng.randrange(300)))])))
        if kept >= licenses.CONTAINED:
            want[k] = (name, kept)
    folder, df = documents(docs)
    clash = df.withColumn("license", F.lit("clash")).withColumn("containment", F.lit("x"))
    got = {r.doc_id: (r.license, r.containment) for r in licenses.scan(clash, notices).collect()}
    assert len(want) > 300 and not set(got) - set(want)
    assert sum(k in got for k in want) >= 0.995 * len(want)
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in got)
