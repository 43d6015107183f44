from tidemark.llm import words


def test_table_starts_anew_beyond_its_bounds(monkeypatch):
    monkeypatch.setattr(words, "WORDS", 5)
    table = words.WordTable(lambda w: (len(w), w.isalpha()), ("int64", bool))
    for k in range(50):
        text = [f"w{k}" * n for n in range(1, 4)] + ["plain"]
        codes = table.codes(text)
        assert table.column(0)[codes].tolist() == [len(w) for w in text]
        assert table.column(1)[codes].tolist() == [False, False, False, True]
        table.trim()
        assert len(table) <= 9
