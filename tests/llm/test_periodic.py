import random
import zlib

import numpy as np
import pytest

from sparkrules.llm import periodic as p


def brute(words):
    """Every lag, every stretch, the smallest period of each."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e > s and e + q - s >= max(24, 3 * q) and (s, e + q) not in found:
                found[s, e + q] = q
            s = e + 1
    runs = sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))
    dropped = {i for s, n_, q in runs for i in range(s + q, s + n_)}
    return runs, " ".join(w for i, w in enumerate(words) if i not in dropped)


def planted(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    q = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % q] for i in range(n)]


def texts(seed):
    r = random.Random(seed)
    out = []
    for _ in range(60):
        kind, size = r.randrange(5), r.randrange(1, 160)
        vocabulary = [f"w{i}" for i in range(r.choice([1, 2, 3, 8, 60]))]
        words = r.choices(vocabulary, k=size)
        if kind == 1:
            block = r.choices(vocabulary, k=r.randrange(1, 12))
            words = words[: size // 3] + block * r.randrange(2, 20) + block[: r.randrange(len(block) + 1)] + words[size // 3 :]
        elif kind == 2:
            inner = r.choices(vocabulary, k=3) * 9 + ["x"]
            words = words[:5] + inner * 4 + words[5:]
        elif kind == 3:
            words = words * 3
        out.append(words)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed):
    for words in texts(seed):
        ids = np.unique(words, return_inverse=True)[1]
        runs, collapsed = brute(words)
        assert p.find_runs(ids) == runs
        assert sorted(p._plain(ids)) == sorted(runs)
        kept = p.kept_words(len(words), runs)
        assert " ".join(w for w, k in zip(words, kept) if k) == collapsed


def test_splitting_recurses(monkeypatch):
    monkeypatch.setattr(p, "BLOCK", 64)  # many blocks of lags
    words = ["a", "b"] * 2 + ["z"] + ["a"] + ["c", "d", "e"] * 9 + ["y"] + ["b"] * 10
    ids = np.unique(words, return_inverse=True)[1]
    assert p.survivors(ids) == [(6, 33)] and p.find_runs(ids) == brute(words)[0] == [(6, 27, 3)]
    far = np.arange(10**5)
    assert p.survivors(far) == [] and p.find_runs(np.zeros(5000, int)) == [(0, 5000, 1)]
    thue = np.array([bin(i).count("1") % 2 for i in range(1 << 12)])  # deceives sums of powers of two bytes
    assert p.find_runs(np.concatenate((thue, thue, thue))) == [(0, 3 << 12, 1 << 12)]


def test_frame(spark, tables):
    line = "buy now here " * 12
    rows = [(1, line), (2, ""), (3, None), (4, "a\tb\nc\x0bd\x0ce\rf  g "), (5, "pre " + "ä\u00a0ö " * 24 + "post"), (5, line), (None, "x " * 30), (6, "z " * 200_000)]
    got = p.collapse(tables(rows), "doc_id", "key").collect()
    assert len(got) == len(rows) and all(r.key == "x" for r in got)
    by = {(r.doc_id, r.collapsed): r for r in got}
    assert by[1, "buy now here"][2:8] == (1, 0, 36, 3, 12000, "0,36,3\n")
    assert by[2, ""][2:8] == by[3, ""][2:8] == (0, None, None, None, None, "")
    assert by[4, "a b c d e f g"].n_runs == 0
    assert by[5, "pre ä\u00a0ö post"].listed == "1,24,1\n"
    assert by[None, "x"].length == 30 and by[6, "z"].length == 200_000
    assert p.runs(tables([]), "doc_id").collect() == []
    assert [r.runs[0].asDict() for r in p.runs(tables([(1, line)]), "doc_id").collect()] == [{"start": 0, "length": 36, "period": 3}]


def test_ties_and_exact_exponents():
    assert p.best_run([(0, 30, 3), (5, 40, 4), (9, 31, 3)]) == (9, 31, 3)
    assert p.best_run([(0, 30, 3), (5, 40, 4)]) == (0, 30, 3) and p.best_run([]) is None
