import random

from pyspark.sql import functions as F

from tidemark.llm import decontaminate, queries


def brute_template(text):
    """(literal or placeholder, value) of each token; as ``decontaminate`` but for lone capitals at the beginning of sentences."""
    out, begins, joins, last = [], True, False, None
    for w in text.split():
        core = w.strip(".,;:!?\"'()")
        low = core.lower() or w
        number = all(x in decontaminate.NUMBER_WORDS for x in low.split("-"))
        capital = core[:1].isupper() and core[1:].islower() and not number
        kind = "literal"
        if low in decontaminate.UNITS and joins and last in ("digits", "words"):
            out[-1] = ("<num><unit>", f"{out[-1][1]} {low}")
            kind = "unit"
        elif number and joins and last in ("digits", "words"):
            out[-1] = (out[-1][0], f"{out[-1][1]} {low}")
            kind = "words"
        elif number or low.replace(".", "").replace(",", "").isdigit():
            out.append(("<num>", low))
            kind = "words" if number else "digits"
        elif capital and not begins and joins and last in ("name", "first"):
            out[-1] = ("<name>", f"{out[-1][1] or out[-1][0]} {low}")
            kind = "name"
        elif capital and not begins:
            out.append(("<name>", low))
            kind = "name"
        else:
            out.append((low, None))
            kind = "first" if capital and low not in decontaminate.FIRST_WORDS else "literal"
        begins, joins, last = w[-1] in ".!?:;", w[-1] not in ".!?:;,", kind
    return out


def brute(docs, items):
    found = set()
    for d, t in docs:
        doc = brute_template(t or "")
        for i, x in items:
            item = brute_template(x or "")
            size = min(5, len(item))
            if not size:
                continue
            usable = [p for p in range(len(item) - size + 1) if any(v is None for _, v in item[p : p + size])]
            hits = set()
            for shift in range(-len(item), len(doc)):
                at = [p for p in usable if 0 <= p + shift <= len(doc) - size and [w for w, _ in doc[p + shift : p + shift + size]] == [w for w, _ in item[p : p + size]]]
                fills = {(item[q][1], doc[q + shift][1]) for p in at for q in range(p, p + size) if item[q][1] is not None}
                if len({a for a, _ in fills}) == len(fills) == len({b for _, b in fills}):
                    hits.update(at)
            if usable and len(hits) >= 0.8 * len(usable):
                found.add((d, i, len(hits), len(usable)))
    return found


def tables(spark):
    rng = random.Random(6)
    words = "which train reaches city first when speed grows while distance stays fixed under rule seven near old bridge".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, f"Q{k}x " + prose(20) + ".") for k in range(10)]
    items += [
        (100, "A train of 3 wagons leaves Paris at 9 with 3 crates and meets Rome after 40 km of slow track."),
        (101, "short one here"), (102, None), (103, ""), (104, "12 13 14 15 16 17"), (0, items[0][1]),
    ]
    docs = [(k, prose(80)) for k in range(15)]
    docs += [(20 + k, prose(30) + ". " + items[k][1] + " " + prose(30)) for k in range(5)]
    docs += [
        (40, "Then. A train of 5 wagons leaves Oslo at 7 with 5 crates and meets Bern after 60 km of slow track. End"),  # re-parameterised
        (41, "Then. A train of 5 wagons leaves Oslo at 7 with 6 crates and meets Bern after 60 km of slow track. End"),  # 3 became 5 and 6
        (42, "it is a short one here today"), (43, None), (44, ""), (45, "1 2 3 4 5 6 7 8"), (46, " ".join(items[2][1].split()[:8])),
        (47, prose(8_000)), (20, docs[0][1]), (None, items[3][1].upper()), (48, prose(1500) + ". " + items[6][1] + " " + prose(1500)),
    ]
    return docs, items, spark.createDataFrame(items, "item_id long, text string")


def test_query_against_brute_force(documents, spark):
    docs, items, benchmark = tables(spark)
    folder, df = documents(docs, benchmark=benchmark)
    got = {tuple(r)[:4] for r in queries.op6_decontaminate(spark, folder).collect()}
    want = brute(docs, items)
    assert got == want
    assert {(20, 0), (40, 100), (42, 101), (None, 3)} <= {x[:2] for x in got} and not {41, 43, 45, 46} & {x[0] for x in got}
    shuffled = {tuple(r)[:1] + tuple(r)[2:] for r in decontaminate.contaminated(df, benchmark, broadcast=0).collect()}
    assert shuffled == want


def test_drop_leaks(documents, spark):
    docs, items, benchmark = tables(spark)
    folder, df = documents(docs)
    extra = df.withColumn("window", F.lit("clash")).withColumn("doc_key", F.lit(1))
    kept = decontaminate.drop_leaks(extra, benchmark)
    assert kept.columns == extra.columns
    gone = {d for d, *_ in brute(docs, items)}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([str(d) for d, _ in docs if d not in gone] + ["20"])
    assert decontaminate.drop_leaks(df.limit(0), benchmark).count() == 0
    assert decontaminate.drop_leaks(df, benchmark.limit(0)).count() == len(docs)


def test_names_at_the_beginning_of_sentences(spark):
    items = [
        (1, "Tom has 3 apples. Tom buys 4 more. How many apples does Tom have now?"),
        (2, "Betty sold clips to 48 friends in April. Clara then sold half as many clips in May. Betty keeps 7 clips for later use. Betty and her friends ask how many clips were sold."),
        (3, "Jane ran 9 laps round the park. Jane then walked 4 laps back."),
        (4, "Yes please"), (5, "The dog runs"),
    ]
    docs = [
        (10, "Ann has 5 apples. Ann buys 7 more. How many apples does Ann have now?"),
        (11, "Ann has 5 apples. Ann buys 5 more. How many apples does Ann have now?"),  # 3 and 4 became one number
        (12, "so we ask. Tom has 5 apples. Ann buys 7 more. How many apples does Eve have now?"),  # three people
        (20, "First. Maria sold clips to 52 friends in June. Oscar then sold half as many clips in July. Maria keeps 9 clips for later use. Maria and her friends ask how many clips were sold. End"),
        (30, "Then Paul ran 9 laps round the park. Paul then walked 4 laps back."),  # begins a sentence on one side only
        (40, "Tom please"), (41, "They said yes please again"), (50, "now the dog runs"), (51, "Tom dog runs"),
    ]
    schema = ["doc_id long, text string", "item_id long, text string"]
    df, benchmark = spark.createDataFrame(docs, schema[0]), spark.createDataFrame(items, schema[1])
    want = {(10, 1, 1.0), (11, 1, 1.0), (20, 2, 1.0), (30, 3, 1.0), (41, 4, 1.0), (50, 5, 1.0), (51, 5, 1.0)}
    got = {(r.doc_id, r.item_id, r.share) for r in decontaminate.leaks(df, benchmark).collect()}
    assert got == want
    shuffled = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, benchmark, broadcast=0).collect()}
    assert shuffled == {x[:2] for x in want}


def test_reparameterised_questions_of_other_lengths(spark):
    items = [
        (1, "Mary Ann Smith walks 5 km to school and then Bob Jones walks 12 km home in the rain."),
        (2, "A farm keeps twenty five hens and 3 million bees near a lake."),
        (3, "We put a second coat on it in May, then wait 2 hours before the third coat is put on."),
    ]
    docs = [
        (10, "First. Otto walks seven km to school and then Eve walks 12.5 miles home in the rain. Last"),
        (11, "here a farm keeps 9 hens and two hundred bees near a lake."), (12, "So a farm keeps thirty-one hens and forty thousand bees near a lake now"),
        (13, "so we put a second coat on it in June, then wait 90 minutes before the third coat is put on."),
        (20, "so we put in second coat s it m June, then wait 90 minutes before the third coat is put on."),  # units as words differ
        (21, "Otto walks to school and then Eve walks home in the rain."), (22, "the hens and the bees live near a lake in the second year"),
        (23, "five hens, two bees and 3 million cows keep a farm near the lake"),
    ]
    df, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(10, 1), (11, 2), (12, 2), (13, 3)}
    for extra in ({}, {"strings": 0}, {"broadcast": 0}):
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, benchmark, **extra).collect()} == want


def test_templates():
    tokens = decontaminate.Templates().of(["Otto Mary Ann Smith, Bob Ray ate 2 hundred kg and five. In a second", "The Smith house 5km"])
    spans = [" ".join(tokens.words[a:b]) for a, b in zip(tokens.heads, [*tokens.heads[1:], len(tokens.words)], strict=True)]
    assert spans == ["Otto Mary Ann Smith,", "Bob Ray", "ate", "2 hundred kg", "and", "five.", "In", "a", "second", "", "The", "Smith", "house", "5km", ""]
    assert tokens.sizes().tolist() == [9, 4]


def test_one_other_filling_costs_its_windows_alone(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    item = " ".join(["of", *words[:5], "3", *words[5:30], "3", *words[30:55], "3", *words[55:]])
    doc = item.replace(" 3 ", " 8 ", 2).replace(" 3 ", " 9 ")
    df, benchmark = spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    n = len(item.split()) - 4
    assert [(r.matched, r.item_windows) for r in decontaminate.leaks(df, benchmark).collect()] == [(n - 5, n)]


def test_any_white_space_parts_words_on_both_paths(spark):
    items = [(1, "why\u00a0do seven\u3000old bridges never meet any slow trains?"), (2, "\nwhat is dna"), (3, "\t one\x1cpart two\u2028parts three\x85parts "), (4, "12 13 14 15 16")]
    docs = [
        (10, "so why do seven old bridges never meet any slow trains? because"), (11, "tell me what is dna now"), (12, "here one part two parts three parts end"),
        (13, "x why\u2003do seven old\nbridges never meet any\u00a0slow trains? y"), (14, "nothing of this"), (15, "what\u3000is\tdna"), (16, "12 13 14 15 16"), (17, "\u3000\n\t"),
    ]
    df, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(10, 1), (13, 1), (11, 2), (15, 2), (12, 3)}
    for extra in ({}, {"strings": 0}, {"broadcast": 0}, {"broadcast": 0, "bitmap": 64}):
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, benchmark, **extra).collect()} == want


def test_rare_windows_lose_no_pair(spark):
    rng = random.Random(11)
    common = "how many of these things are there in all of the boxes now".split()
    items = [(k, " ".join([*common, *(f"w{rng.randrange(4)}" for _ in range(rng.randint(0, 6)))])) for k in range(30)]
    docs = [(100 + k, " ".join(["so", *common, *(f"w{rng.randrange(4)}" for _ in range(6))])) for k in range(30)] + [(7, None)]
    df, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    clash = df.withColumn("item_id", F.lit("clash")).withColumn("window", F.lit(3)).withColumn("slots", F.lit("x"))
    got = {(r.doc_id, r.item_id, r.matched, r.item_windows) for r in decontaminate.leaks(clash, benchmark.withColumn("doc_id", F.lit(1))).collect()}
    assert got == brute(docs, items)
    assert len(got) > 100
