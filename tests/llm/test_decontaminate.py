import re

from sparkrules.llm import decontaminate as d

ITEM = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu."
SHORT = "café au lait"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items):
    w, hit, names = words(text), set(), set()
    for name, item in items:
        x = words(item)
        n = min(len(x), 10)
        for s in range(len(x) - n + 1) if n else ():
            for at in range(len(w) - n + 1):
                if w[at : at + n] == x[s : s + n]:
                    hit |= set(range(at, at + n))
                    names |= {str(name)} if name is not None else set()
    return len(w), len(hit), sorted(names)


def test_against_brute_force(spark, tables):
    items = [(1, ITEM), (10, ITEM.upper()), (2, SHORT), (3, ""), (4, None), (None, "nine ten"), (2, SHORT), (5, "x1 " * 12)]
    filler = "one two three four five six seven "
    texts = [ITEM, f"{filler}{ITEM}", f"a {ITEM} b {ITEM}", filler * 3, "", None, "CAFÉ au lait, café AU lait!", "eta theta iota kappa"]
    texts += [f"{'q ' * k}{ITEM} {'z ' * k}" for k in range(12)]
    texts += [filler * 4000 + ITEM, "nine, ten", "x1 " * 30, "alpha-beta gamma delta epsilon zeta eta theta iota kappa", ITEM, "w" * 50_000]
    rows = [*enumerate(texts), (3, ITEM), (3, filler), (None, ITEM), (None, "clean")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in d.report(tables(rows), bench).collect())
    want = sorted((i is None, i, *(x := brute(t, items)), x[1] > 0) for i, t in rows)
    assert got == want
    kept = sorted(((r.doc_id, r.text) for r in d.clean(tables(rows), bench).collect()), key=str)
    assert kept == sorted(((i, t) for i, t in rows if not brute(t, items)[1]), key=str)


def test_spans_are_cut_out_and_columns_stay(spark, tables):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = tables([(1, f"Start: {ITEM} End here"), (2, "clean text."), (3, None)])
    out = d.clean(docs, bench, remove="spans")
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "Start: End here", 2: "clean text.", 3: None}


def test_empty_tables(spark, tables):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in d.report(tables([(1, ITEM)]), bench).collect()] == [False]
    full = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert d.report(tables([]), full).collect() == []
