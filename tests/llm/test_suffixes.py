import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sparkrules.llm import suffixes as s


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    counts = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - length + 1):
            gone[i + 1 : i + 1 + length] |= counts[r[i : i + length]] > 1
        edges = np.diff(gone.astype(int))
        spans = list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()))
        out.append((len(r), spans, bytes(x for x, g in zip(r, gone[1:]) if not g)))
    return out


def test_two_stage_order_and_common_prefixes():
    random.seed(3)
    for _ in range(300):
        length, signs = random.choice([3, 8, 20]), random.choice([b"ab", b"abc", b"abcdefgh", b"a"])
        pieces = [bytes(random.choices(signs, k=length + random.randint(0, 40))) for _ in range(random.randint(1, 8))]
        starts = [random.randint(1, len(p) - length + 1) for p in pieces]
        joined, order, equal = s.sorted_places(pieces, starts, length)
        begins = np.cumsum([0] + [len(p) for p in pieces])
        assert sorted(order.tolist()) == [int(b) + k for b, n in zip(begins, starts) for k in range(n)]
        strings = [joined[x : x + length] for x in order.tolist()]
        assert strings == sorted(strings)
        assert equal[:-1].tolist() == [a == b for a, b in zip(strings, strings[1:])]


def test_against_brute_force(tables):
    random.seed(3)
    words = ["ab", "cde", "f", "ghij", "é", "klm"]
    parts = [" ".join(random.choices(words, k=random.randint(5, 30))) for _ in range(12)]
    texts = [" ".join(random.choice(parts) if random.random() < 0.6 else " ".join(random.choices(words, k=8)) for _ in range(random.randint(1, 6))) for _ in range(90)]
    texts += [*texts[:5], "", None, "a" * 300, "ab" * 100, "xyz", "".join(random.choices("pqrstuvw", k=60_000))]
    rows = [*enumerate(texts), (0, texts[0]), (None, texts[7])]
    want = sorted(((i, n, spans, kept) for (i, _), (n, spans, kept) in zip(rows, brute([t for _, t in rows], 40))), key=str)
    for hot in (2000, 3):
        got = s.removed(tables(rows), "doc_id", "copies", length=40, hot=hot)
        got = sorted(((r.doc_id, r.n_bytes, [tuple(x) for x in r.removed], bytes(r.kept)) for r in got.collect()), key=str)
        assert got == want


def test_empty_and_clean_tables(tables):
    assert s.removed(tables([]), "doc_id").collect() == []
    out = s.removed(tables([(1, "a" * 399), (2, "b" * 300)]), "doc_id").select(F.size("removed").alias("n"), "n_bytes").collect()
    assert [(r.n, r.n_bytes) for r in out] == [(0, 399), (0, 300)]
