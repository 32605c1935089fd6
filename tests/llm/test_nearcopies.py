import random

from test_simhash import roots

import corpus_pipeline
from sparkrules.llm import nearcopies as n
from sparkrules.llm import paragraphs as p

random.seed(12)
VOCAB = ["".join(random.choices("abcdefgh", k=random.randint(2, 8))) for _ in range(900)]


def prose(k):
    return " ".join(random.choices(VOCAB, k=k))


def edited(text, k):
    w = text.split()
    for i in random.sample(range(len(w)), k):
        w[i] = random.choice(VOCAB)
    return " ".join(w)


def brute(rows):
    """The kept ids of distinct non-null ids: one of each component at a 5-word Jaccard of 0.8, short texts by equal words."""
    words = {i: (t or "").encode().lower().split() for i, t in rows}
    sets = {i: frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([(len(w), *w)]) for i, w in words.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return set(roots(sets, pairs).values())


def test_against_brute_force(spark, tables, sf_dir):
    base = [prose(random.randint(150, 300)) for _ in range(8)]
    texts = [edited(x, k) for x in base for k in (0, 1, 3, 5, 6, 9, 30)] + [base[0].upper(), "", None, " \n", "a b c", "A  b\tc", "a b d", prose(20_000)]
    rows = list(enumerate(texts))
    random.shuffle(rows)
    docs = tables(rows)
    out = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert out.columns == docs.columns
    want = brute(rows)
    assert {r.doc_id for r in out.collect()} == want and len(out.collect()) == len(want) < len(rows) - 20


def test_a_large_family_of_edited_copies(spark, monkeypatch):
    """Members with two to four edits; few are alike, and comparisons stay within a multiple of the members."""
    random.seed(31)
    base, size = prose(110), 500
    family = [base] + [edited(base, random.choice([1, 2, 3, 4, 4, 5, 6])) for _ in range(size)]
    rows = list(enumerate(family))
    compared = []
    real = p._verified

    def counted(pairs, texts, similarity):
        compared.append(pairs.count())
        return real(pairs, texts, similarity)

    monkeypatch.setattr(p, "_verified", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in n.clean(docs).collect()} == brute(rows)
    assert sum(compared) <= 3 * n.BANDS * size < size * size / 8


def test_possible_pairs_hold_all_similar_ones(spark):
    random.seed(32)
    bases = [prose(k) for k in (12, 40, 41, 90)]
    texts = {i.to_bytes(2): edited(b, random.randint(0, 6)) for i, b in enumerate(random.choices(bases, k=80))}
    texts |= {(200 + i).to_bytes(2): " ".join(bases[3].split()[: 70 + i]) for i in range(20)}
    df = spark.createDataFrame([(bytearray(f), t) for f, t in texts.items()], "form binary, words string")
    rest = df.selectExpr("1L as bucket", "form", "form as root")
    got = {(bytes(r.a), bytes(r.b)) for r in p._possible(rest, p._shingled(df), 0.8).collect()}
    sets = {f: set(zip(*(t.split()[k:] for k in range(5)))) for f, t in texts.items()}
    similar = {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert similar <= got and len(got) < len(sets) * (len(sets) - 1) / 4


def test_unlike_members_of_a_family_do_not_meet(spark):
    random.seed(33)
    base = prose(170)
    texts = {i.to_bytes(2): edited(base, 3 + i % 2) for i in range(150)}
    texts |= {(500 + i).to_bytes(2): edited(texts[i.to_bytes(2)], 1) for i in range(20)}
    df = spark.createDataFrame([(bytearray(f), t) for f, t in texts.items()], "form binary, words string")
    rest = df.selectExpr("1L as bucket", "form", "form as root")
    got = {(bytes(r.a), bytes(r.b)) for r in p._possible(rest, p._shingled(df), 0.8).collect()}
    sets = {f: set(zip(*(t.split()[k:] for k in range(5)))) for f, t in texts.items()}
    similar = {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert len(similar) >= 20 and similar <= got and len(got) < len(similar) + len(sets) * (len(sets) - 1) / 2 / 20


def test_repeats_nulls_and_empty_tables(tables):
    text = prose(90)
    got = n.clean(tables([(3, text), (3, text), (None, text), (None, prose(60)), (None, None)])).collect()
    assert sorted((r.doc_id is None for r in got)) == [False, True, True]
    assert n.clean(tables([])).collect() == []


def test_edited_copies_leave_the_test_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()} == want
    assert {1, 6} <= want and not {145, 177} & want  # Jaccard 0.83 each, over two bits apart
