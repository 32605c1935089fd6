import random
import re

import xxhash

from sparkrules.llm import simhash as s
from sparkrules.llm.components import components


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, pairs):
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    for text in (None, "", "One", "A  b\tC", "ä Ö x\x0by z", "same words " * 40_000, "É é È     q r s"):
        assert s.fingerprint(text) == brute(text)


def test_links_in_plain_and_crowded_buckets(spark):
    random.seed(2)
    centre = [random.getrandbits(64) for _ in range(6)]
    prints = {0, (1 << 64) - 1, *centre}
    for c in centre:
        for _ in range(60):
            prints.add(c ^ sum(1 << b for b in random.sample(range(64), random.choice((1, 2, 3, 4)))))
    prints = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    pairs = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    want = roots(prints, pairs)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    for bucket in (512, 3, 0):
        links = [(r.a, r.b) for r in s.links(df, bucket).collect()]
        if bucket == 512:
            assert sorted(map(sorted, links)) == sorted(map(sorted, pairs))
        assert roots(prints, links) == want


def test_components_of_chains_and_stars(spark):
    random.seed(4)
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(1, 90)] + [(5000, 5000), (6001, 6000), (6000, 6001)]
    random.shuffle(pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame([*pairs, (None, 1)], "a long, b long")).collect()}
    assert got == roots({n for p in pairs for n in p}, pairs)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_documents_with_nulls_copies_and_repeats(spark, tables):
    text = " ".join(f"word{k}" for k in range(400))
    rows = [(7, text), (3, text), (9, text + " tail"), (1, "quite another text with its own words"), (4, ""), (2, None), (None, text), (3, text), (5, " \n ")]
    docs = tables(rows)
    got = sorted(((r.doc_id, r.component_id) for r in s.near_duplicates(docs).collect()), key=str)
    near = 3 if (brute(text) ^ brute(text + " tail")).bit_count() <= 2 else 9
    assert got == sorted([(7, 3), (3, 3), (3, 3), (9, near), (1, 1), (4, 2), (2, 2), (5, 2), (None, 3)], key=str)
    kept = s.clean(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({1, 2, 3, near})
    assert s.near_duplicates(tables([])).collect() == [] and s.clean(tables([])).collect() == []
    none = tables([(None, text), (None, text), (None, "other words here")])
    assert sorted(r.text for r in s.clean(none).collect()) == sorted([text, "other words here"])
