import hashlib
import json
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrules.llm import quality as q

random.seed(5)
VOCAB = ["".join(random.choice("abcdefghijklmnop") for _ in range(random.randint(3, 9))) for _ in range(900)]


def prose(n):
    return " ".join(random.choice(VOCAB) for _ in range(n))


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = list(zip(w, w[1:], w[2:]))
    counts = Counter(runs)
    covered = {i + k for i, r in enumerate(runs) if counts[r] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    sizes = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    return *sizes, len(w) < 50 or 100 * len(covered) > 50 * len(w)


RIDGE = np.diag([1000.0**2, 60.0**2, 50.0**2, 120.0**2, 120.0**2])


def features(text):
    n, chars, symbols, copied, repeated, _ = brute(text)
    lines = len([x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
    chars_, n_ = max(chars, 1), max(n, 1)
    x = math.log1p(n), math.log(chars_ / n_), math.sqrt(symbols / chars_), math.sqrt(copied / max(lines, 1)), math.sqrt(repeated / n_)
    return tuple(math.floor(1000 * v + 0.5) for v in x)


def spread(points, weights):
    mean = weights @ points / weights.sum()
    return mean, (points - mean).T @ ((points - mean) * weights[:, None]) / weights.sum()


def distances(points, mean, scatter):
    off = points - mean
    return np.einsum("ij,ij->i", off, np.linalg.solve(scatter + RIDGE, off.T).T)


def estimate(key, points):
    """Mean and covariance from ``(point, weight)``: every start to its end, the least determinant, reweighted."""
    order = sorted(points, key=lambda p: (hashlib.md5(" ".join(map(str, [key, *p[0]])).encode()).hexdigest(), p[0]))
    x, w = np.array([p[0] for p in order], float), np.array([p[1] for p in order], float)
    half, best = w.sum() // 2 + 1, None
    for start in range(4):
        chosen = [i for i in range(min(24, len(x))) if (i + 1) % 4 == start]
        if not chosen:
            continue
        mean, scatter, least = *spread(x[chosen], np.ones(len(chosen))), math.inf
        while True:
            bands = np.floor(32 * np.log2(np.maximum(distances(x, mean, scatter), 1e-9)))
            share, before = np.zeros(len(x)), 0.0
            for band in sorted(set(bands)):
                rows = bands == band
                share[rows] = min(1.0, max(0.0, half - before) / w[rows].sum())
                before += w[rows].sum()
            new = spread(x, w * share)
            new = new[0], 1.9122 * new[1]
            determinant = np.linalg.slogdet(new[1] + RIDGE)[1]
            if not determinant < least - 1e-3:
                break
            (mean, scatter), least = new, determinant
        if best is None or least < best[0]:
            best = least, mean, scatter
    near = distances(x, *best[1:]) <= 12.8325
    mean, scatter = spread(x[near], w[near])
    return w.sum(), mean, 1.0555 * scatter


def verdicts(rows):
    """``(distance, kept)`` of every ``(text, lang, source)``, in order."""
    named = lambda **names: json.dumps({k: v for k, v in names.items() if v is not None}, separators=(",", ":"), ensure_ascii=False)
    keys = [(f"group {named(lang=lang, source=source)}", f"lang {named(lang=lang)}", "all") for _, lang, source in rows]
    found, failed = [features(r[0]) for r in rows], [brute(r[0])[-1] for r in rows]
    counts, points = Counter((k, x) for k, x, f in zip(keys, found, failed) if not f), defaultdict(list)
    for (levels, x), n in counts.items():
        for key in levels:
            points[key].append((x, n))
    own = {key: estimate(key, p) for key, p in points.items()}
    out = []
    for levels, x, f in zip(keys, found, failed):
        distance = None
        if "all" in own:
            mean, scatter = own["all"][1], np.zeros((5, 5))
            for key in reversed(levels):
                n, m, c = own.get(key, (0, mean, scatter))
                mean, scatter = (n * m + 30 * mean) / (n + 30), (n * c + 30 * scatter) / (n + 30)
            distance = float(distances(np.array([x], float), mean, scatter)[0])
        out.append((distance, not f and distance <= 51.0))
    return out


def test_distances_against_a_plain_version(spark):
    random.seed(11)
    rows = [(prose(random.randint(55, 500)), random.choice(["en", "en", "de", None]), random.choice(["a", "a", "a", "b", None])) for _ in range(150)]
    rows += [(prose(120), "en", "copies")] * 40 + [(prose(90), "en", "copies"), (prose(90), "fr", "one"), (" ".join(f"{w}##" for w in prose(90).split()), "en", "a")]
    rows += [("\n".join([prose(8)] * 3 + [prose(random.randint(60, 90))]), "de", "a") for _ in range(6)] + [(None, "xx", "none"), ("a b", "en", "none"), ("", None, None)]
    want = verdicts(rows)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    for parts in (1, 8):  # and the same bits on any partitioning
        got = {r.doc_id: r for r in q.report(docs.repartition(parts, F.col("doc_id") * 7 % 5)).collect()}
        assert {i: r.kept for i, r in got.items()} == {i: k for i, (_, k) in enumerate(want)}
        assert [got[i].distance for i in range(len(rows))] == [pytest.approx(d, rel=1e-6, abs=1e-6) for d, _ in want]
        assert parts == 1 or {i: r.distance for i, r in got.items()} == before
        before = {i: r.distance for i, r in got.items()}
    assert 0 < sum(not k for _, k in want) < 10


def test_statistics_and_outliers(tables):
    rows = [(i, prose(random.randint(60, 400))) for i in range(120)]
    odd = {500: " ".join(f"{w}###" for w in prose(200).split()), 501: "\n".join([prose(6)] * 4 + [prose(200)] * 1 + [prose(5)] * 30), 502: "Wwwwwwwwwwwwwwww " * 3 + " ".join("x" * 25 + w for w in prose(150).split())}
    texts = [None, "", "a b c a b c", "l1\n\n l1\nl1\n\t\n", "é ü\x0b\x0cß x", "w " * 30_000, prose(20_000)]
    rows += [*odd.items(), *((600 + k, t) for k, t in enumerate(texts)), (1, rows[1][1]), (None, prose(90)), *((700 + k, rows[0][1]) for k in range(60))]
    got = q.report(tables(rows)).collect()
    assert sorted(((r.doc_id, *r[1:7]) for r in got), key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i in range(120)) and kept[606] and kept[None]
    assert not kept[500] and not kept[501] and not kept[502] and not kept[600]
    docs = tables(rows)
    out = q.clean(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted((r.doc_id for r in got if r.kept), key=str)


def test_small_groups_and_empty_tables(spark, tables):
    rows = [(i, prose(80), None if i % 2 else "en", f"s{i}", 1) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert all(r.kept and r.distance < 1 for r in q.report(docs).collect())
    assert q.report(tables([])).collect() == []
    none = q.report(tables([(1, None), (2, "a b")])).collect()
    assert sorted((r.doc_id, r.distance, r.kept) for r in none) == [(1, None, False), (2, None, False)]


def test_small_groups_beside_large_ones(spark):
    junk = " ".join(f"{w}###" for w in prose(200).split())
    rows = [(i, prose(random.randint(60, 400)), "en", "large") for i in range(100)]
    rows += [(200 + i, prose(90), "en", "small") for i in range(4)] + [(300, junk, "en", "small"), (301, junk, None, "alone"), (302, prose(80), "xx", "alone"), (303, "a b", "xx", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in q.report(docs).collect()}
    assert len(got) == len(rows) and all(r.distance is not None for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {300, 301, 303}
