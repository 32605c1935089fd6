"""Retrieval and scoring: brute force, invariants and hand-worked scores."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkrules.operators import retrieve, runs, score


def texts(rng, n, vocabulary):
    return [" ".join(rng.choices(vocabulary, k=rng.randint(0, 6))) for _ in range(n)]


def grams(text, n):
    words = text.split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute_diverse(query_id, query, rows, k, seed):
    chosen, past, step = [], set(), 0
    while len(chosen) < k:
        step += 1
        n = (1, 2)[int(int(hashlib.md5(f"{query_id}:{step}:{seed}".encode()).hexdigest()[:8], 16) / 2**32 * 2)]
        ranking = sorted((-len(grams(t, n) & grams(query, n)), i, t) for i, t in rows if t not in past)
        used, now = set(), []
        for _, i, t in ranking:
            if len(chosen) < k and not used & set(t.split()):
                chosen.append(i)
                now.append(t)
                used |= set(t.split())
        past |= set(now)
        if not now:
            break
    return chosen


@pytest.mark.parametrize(("head", "block"), [(4, 7), (32, 4096)])
def test_diverse_exemplars_equal_brute_force(spark, monkeypatch, head, block):
    monkeypatch.setattr(retrieve, "WALK_BLOCK", block)
    monkeypatch.setattr(retrieve, "MASK_WORDS", 5)
    rng = random.Random(4)
    rows = list(enumerate(texts(rng, 120, [f"w{i}" for i in range(25)])))
    rows += [(200 + i, rows[i][1]) for i in range(0, 60, 2)] + [(300, ""), (301, " ")]  # copies and rows without words
    questions = list(enumerate(texts(rng, 5, [f"w{i}" for i in range(25)])))
    corpus = spark.createDataFrame(rows, "row_id bigint, text string").repartition(4)
    queries = spark.createDataFrame(questions, "query_id bigint, text string")
    got = retrieve.diverse_exemplars(queries, corpus, 12, 3, head=head).orderBy("query_id", "pick").collect()
    for query_id, query in questions:
        assert [r.row_id for r in got if r.query_id == query_id] == brute_diverse(query_id, query, rows, 12, 3)


def test_diverse_exemplars_stop_when_the_corpus_is_used_up(spark):
    corpus = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a b")], "row_id bigint, text string")
    queries = spark.createDataFrame([(1, "a")], "query_id bigint, text string")
    assert [r.row_id for r in retrieve.diverse_exemplars(queries, corpus, 10, 1).orderBy("pick").collect()] == [1, 2]


def test_ngram_topk_leaves_stop_words_out(spark):
    """Three words stand in every row; only rows that share a rare word with a query are counted."""
    rng = random.Random(6)
    rare = [f"r{i}" for i in range(300)]
    rows = [(i, " ".join(["the", "of", "and", *rng.choices(rare, k=rng.randint(1, 6))])) for i in range(1500)]
    # rows that hold much of a query, so that its bound is above what stop words alone give
    questions = [(q, " ".join(["the", "of", "and", *rare[10 * q : 10 * q + 8]])) for q in range(5)]
    rows += [(2000 + 10 * q + j, f"{text} {' '.join(f'long{i}' for i in range(20))}") for q, text in questions for j in range(4)]
    corpus = spark.createDataFrame(rows, "row_id bigint, text string").repartition(4)
    queries = spark.createDataFrame(questions, "query_id bigint, text string")
    k = 4
    got = retrieve.ngram_topk(queries, corpus, 1, k).collect()
    for query_id, text in questions:
        want = sorted((-len(grams(t, 1) & grams(text, 1)), i) for i, t in rows)[:k]
        assert [(r.row_id, r.overlap) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == query_id] == [(i, -o) for o, i in want]
    asked, own = retrieve.gram_index(queries, corpus, 1)
    # a stop word alone makes 7,500 pairs
    assert k * len(questions) <= retrieve.reachable(asked, own, k).count() <= 4 * k * len(questions)


@pytest.mark.parametrize("seed", range(3))
def test_ngram_topk_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = list(enumerate(texts(rng, 150, [f"w{i}" for i in range(30)] + ["the"] * 30)))
    questions = list(enumerate(texts(rng, 8, [f"w{i}" for i in range(40)] + ["the"] * 20)))
    corpus = spark.createDataFrame(rows, "row_id bigint, text string")
    queries = spark.createDataFrame(questions, "query_id bigint, text string")
    for n, k in ((1, 1), (1, 7), (2, 3), (1, 400)):
        got = retrieve.ngram_topk(queries, corpus, n, k).orderBy("query_id", "rank").collect()
        for query_id, text in questions:
            want = sorted((-len(grams(t, n) & grams(text, n)), i) for i, t in rows)[:k]
            assert [(r.row_id, r.overlap) for r in got if r.query_id == query_id] == [(i, -o) for o, i in want]


def test_ngram_topk_fills_with_zero_overlap(spark):
    corpus = spark.createDataFrame([(i, "x y") for i in range(5)] + [(9, "a b c")], "row_id bigint, text string")
    queries = spark.createDataFrame([(1, "a b"), (2, "none")], "query_id bigint, text string")
    got = retrieve.ngram_topk(queries, corpus, 1, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.row_id, r.overlap) for r in got] == [(1, 9, 2), (1, 0, 0), (1, 1, 0), (2, 0, 0), (2, 1, 0), (2, 2, 0)]


def test_growing_heads_pack_the_same(spark):
    rng = random.Random(8)
    rows = [(i, "c", t, "r") for i, t in enumerate(texts(rng, 80, [f"w{i}" for i in range(12)]))]
    corpus = spark.createDataFrame(rows, "row_id bigint, code string, text string, rule string")
    questions = spark.createDataFrame([(i, "q", f"w{i} w{i + 1}") for i in range(4)], "query_id bigint, code string, text string")
    key = lambda d: sorted(map(tuple, d.select("query_id", "rank", "row_id", "overlap", "n_tokens", "packed_tokens").collect()))
    whole = key(retrieve.pack_exemplars(questions, corpus, budget=120, head=1000))
    assert whole and key(retrieve.pack_exemplars(questions, corpus, budget=120, head=2)) == whole
    everything = key(retrieve.pack_exemplars(questions, corpus, budget=5000, head=2))
    assert len(everything) == 4 * 80


def test_prompts_from_a_given_ranking_and_in_a_layout(spark):
    corpus = spark.createDataFrame([(1, "c", "a b", "r1"), (2, "c", "b", "r2"), (3, "c", "x " * 50, "r3")], "row_id bigint, code string, text string, rule string")
    queries = spark.createDataFrame([(7, "q", "a"), (8, "q", "b")], "query_id bigint, code string, text string")
    ranked = spark.createDataFrame([(7, 1, 2), (7, 2, 1), (7, 3, 3)], "query_id bigint, rank bigint, row_id bigint")
    got = {r.query_id: r for r in retrieve.ranked_prompts(ranked, queries, corpus, budget=40, context="Ctx", closing="End").collect()}
    block = "Source: c {}\nTarget: {}"
    assert got[7].prompt == "Ctx" + block.format("b", "r2") + "\n\n" + block.format("a b", "r1") + "End\n\nSource: q a\nTarget: "
    assert (got[7].n_exemplars, got[8].n_exemplars, got[8].prompt) == (2, 0, "CtxEnd\n\nSource: q b\nTarget: ")
    walk = retrieve.diverse_exemplars(queries, corpus, 2, 1).withColumnRenamed("pick", "rank")
    assert retrieve.ranked_prompts(walk, queries, corpus, budget=100).filter("n_exemplars = 2").count() == 2
    given = retrieve.given_prompts(corpus, queries, budget=22, context="Ctx", layout=("exemplars", "context"), query=retrieve.reasoning_text(F.col("code"), F.col("text")))
    want = block.format("a b", "r1") + "\n\n" + block.format("b", "r2") + "\n\nCtx\n\nSource: q a\n"
    assert given.filter("query_id = 7").first().prompt == want
    none = retrieve.given_prompts(corpus, queries, budget=1).first()
    assert (none.n_exemplars, none.prompt) == (0, "\n\nSource: q a\nTarget: ")


def vectors_of(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(points)], "row_id bigint, embedding array<float>").repartition(3)


def brute_hits(points, asked, k):
    points = points.astype(np.float32).astype(np.float64)
    scores = np.round(points[asked] @ points.T, 9) + 0.0
    return {q: sorted(range(len(points)), key=lambda i: (-scores[n, i], i))[:k] for n, q in enumerate(asked)}


@pytest.mark.parametrize(("cells", "block"), [(None, 20_000), (1, 20_000), (7, 9)])
def test_vector_topk_equals_brute_force(spark, monkeypatch, cells, block):
    monkeypatch.setattr(retrieve, "ROW_BLOCK", block)
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(60, 5)), np.ones((30, 5)), np.zeros((2, 5))])  # copies, and ties at zero
    df = vectors_of(spark, points)
    queries = df.filter("row_id % 3 = 0").withColumnRenamed("row_id", "query_id")
    got = retrieve.vector_topk(queries, df, 6, cells=cells).orderBy("query_id", "rank").collect()
    want = brute_hits(points, range(0, len(points), 3), 6)
    assert {q: [r.row_id for r in got if r.query_id == q] for q in want} == want
    everything = retrieve.vector_topk(queries.limit(2), df, 500, cells=cells)
    assert everything.count() == 2 * len(points)


def test_cells_that_cannot_win_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "ROW_BLOCK", 50)  # a block for every cell, or more
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 10
    points = np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 16)) * 0.1
    df = vectors_of(spark, points)
    queries = df.filter("row_id % 100 = 0").withColumnRenamed("row_id", "query_id")
    k = 10
    _, index = retrieve.cell_index(df, cells=40)
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("v"))
    got = retrieve.vector_topk(queries, df, k, cells=40)
    theta = got.groupBy("query_id").agg(F.min("score").alias("theta"))
    first = retrieve.visits(asked.withColumn("theta", F.lit(None).cast("double")), index, k, True).count()
    later = retrieve.visits(asked.join(theta, "query_id"), index, k, False).count()
    assert first + later < 20 * 40 / 5  # of 20 queries x 40 cells
    want = brute_hits(points, range(0, 2000, 100), k)
    assert {q: [r.row_id for r in got.orderBy("rank").collect() if r.query_id == q] for q in want} == want


def test_vector_topk_without_rows_or_vectors(spark):
    schema = "row_id bigint, embedding array<float>"
    empty, df = spark.createDataFrame([], schema), spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], schema)
    asked = df.withColumnRenamed("row_id", "query_id")
    assert retrieve.vector_topk(asked, empty, 3).collect() == []
    assert [tuple(r) for r in retrieve.vector_topk(asked, df, 3).collect()] == [(1, 1, 1.0, 1)]


def test_packing_keeps_the_longest_prefix(spark):
    ranked = spark.createDataFrame([(1, 1, 5), (1, 2, 4), (1, 3, 3), (1, 4, 1), (2, 1, 99)], "query_id int, rank int, n_tokens int")
    kept = retrieve.pack_budget(ranked, 10).collect()
    assert sorted((r.query_id, r["rank"]) for r in kept) == [(1, 1), (1, 2)]


RULE = "if(and(is(pipe.type,waste),has(pipe,joint))),then(obligation(lessThan(pipe.length,50 mm)))"


def scores(spark, pred, ref):
    df = spark.createDataFrame([(1, pred, ref)], "row_id int, pred string, ref string")
    row = score.structure_score(df).first()
    return row.precision, row.recall


def test_scores_of_plain_cases(spark):
    assert scores(spark, RULE, RULE) == (1.0, 1.0)
    assert scores(spark, "", RULE) == (0.0, 0.0)
    assert scores(spark, "a(b)", "c(d)") == (0.0, 0.0)
    # reference elements: is 3 words, entity 3 words (weight 2); prediction shares relation and 2 words
    precision, recall = scores(spark, "is(a,b)", "is(a,b,c)")
    assert precision == 1.0
    assert recall == pytest.approx((2 / 3 + 2 * 2 / 3) / 3)
    # a repeated word counts once per occurrence
    assert scores(spark, "is(a,a)", "is(a,b)") == (0.5, 0.5)
    # a nested then starts a new top level on both sides
    assert scores(spark, "if(is(a,b),then(c(d)))", "if(is(a,b)),then(c(d))") == (1.0, 1.0)


def test_corpus_f1_is_f_of_means(spark):
    df = spark.createDataFrame([(1.0, 0.5), (0.0, 0.5)], "precision double, recall double")
    row = score.structure_f1(df).first()
    assert (row.f_score, row.precision, row.recall) == (50.0, 50.0, 50.0)


def test_post_process_is_applied_to_both_sides(spark):
    df = spark.createDataFrame([(1, "IF(A(B))", "if(a(b))")], "row_id int, pred string, ref string")
    row = score.structure_score(df, post_process=F.lower).first()
    assert (row.precision, row.recall) == (1.0, 1.0)


def test_bleu(spark):
    df = spark.createDataFrame([(1, "a b c d e", "a b c d e")], "row_id int, pred string, ref string")
    assert score.corpus_bleu(df).first().bleu == pytest.approx(1.0)
    short = spark.createDataFrame([(1, "a b c d", "a b c d e")], "row_id int, pred string, ref string")
    row = score.corpus_bleu(short).first()
    assert row.brevity_penalty == pytest.approx(np.exp(1 - 5 / 4)) and row.bleu == pytest.approx(row.brevity_penalty)
    clipped = spark.createDataFrame([(1, "the the the", "the cat")], "row_id int, pred string, ref string")
    assert score.corpus_bleu(clipped).first().precision_1 == pytest.approx(1 / 3)


@pytest.mark.parametrize("limit", [1, 7, 1_000_000])
def test_bleu_counts_keys_one_at_a_time(spark, limit, monkeypatch):
    monkeypatch.setattr(score, "MOST_GRAMS", limit)
    data = [(0, 1, "a b a b c", "a b b"), (0, 1, "c a b", "a b a"), (1, 1, "a", "a"), (0, None, "x  y", "x"), (0, None, "x", "x x"), (1, 2, "", ""), (1, 3, None, "z"), (2, 4, "", "")]
    df = spark.createDataFrame(data, "part int, row_id int, pred string, ref string").repartition(3)
    want = {}
    for part, key in {d[:2] for d in data}:
        grams = [collections.Counter(), collections.Counter()]
        for _, _, *texts in [d for d in data if d[:2] == (part, key) and None not in d[2:]]:
            for side, words in enumerate(t.split() for t in texts):
                grams[side].update(tuple(words[i : i + n]) for n in range(1, 5) for i in range(len(words) - n + 1))
        if any(grams):
            sums = want.setdefault(part, collections.Counter())
            for n in range(1, 5):
                p, r = ({g: c for g, c in side.items() if len(g) == n} for side in grams)
                sums.update({f"match_{n}": sum(min(c, r.get(g, 0)) for g, c in p.items()), f"total_{n}": sum(p.values())})
            sums["reference_length"] += sum(c for g, c in grams[1].items() if len(g) == 1)
    got = {r.part: {k: v for k, v in r.asDict().items() if k != "part"} for r in score.bleu_counts(df, ["part"]).collect()}
    assert got == {part: dict(sums) for part, sums in want.items()}
    # keys above the limit hand on their grams
    rows = sorted((d for d in data if None not in d), key=lambda d: d[:2])
    batch = pa.RecordBatch.from_pylist([{"group": {"by_0": d[0], "key": d[1]}, "pred": " ".join(d[2].split()), "ref": d[3]} for d in rows])
    out = [r for b in score._gram_counts(iter([batch.slice(0, 1), batch.slice(1)]), limit) for r in b.to_pylist()]
    assert sum(r["p"] for r in out if r["n"] == 1) == sum(len(d[2].split()) for d in rows)
    assert all(r["gram"] is None for r in out) == (limit > 100)


def test_bleu_keeps_no_table_of_grams(spark):
    """One task's memory: the grams of 3,000 pairs were rows of an aggregation of every gram."""
    df = spark.range(3000).selectExpr("id as row_id", "concat_ws(' ', transform(sequence(1, 50), x -> concat('w', x * id))) as pred", "'a b' as ref")
    found = score.bleu_counts(df)
    found.collect()
    grouped = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline" not in grouped and "MapInArrow" in grouped


def test_bag_overlap_counts_rows_without_words(spark):
    df = spark.createDataFrame([(1, "a a b", "a b b"), (2, "", "a")], "row_id int, pred string, ref string")
    assert {r.row_id: r.overlap for r in score.bag_overlap(df, "pred", "ref").collect()} == {1: 2, 2: 0}


def test_early_stop(spark):
    log = spark.createDataFrame([(1, i + 1, float(v)) for i, v in enumerate([1, 3, 2, 2, 4])], "run int, step int, value double")
    kept = runs.early_stop(log, 2).orderBy("epoch").collect()
    assert [(r.epoch, r.best_so_far, r.since_best) for r in kept] == [(1, 1.0, 0), (2, 3.0, 0), (3, 3.0, 1), (4, 3.0, 2)]
    assert runs.best_epoch(log).first().step == 5


def test_trim_padding(spark):
    df = spark.createDataFrame([(1, "", ""), (2, "a", ""), (3, "", ""), (4, "", "")], "row_id int, pred string, ref string")
    assert [r.row_id for r in score.trim_padding(df, "row_id").orderBy("row_id").collect()] == [1, 2]
