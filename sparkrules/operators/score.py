"""Scoring predictions: structural F1, corpus BLEU, agreement, extremes and best candidates."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sparkrules.functions import elements as E
from sparkrules.functions import text as T
from sparkrules.functions.tree import let
from sparkrules.operators.ranking import seed_hash

ENTITY_WEIGHT = 2.0
MAX_ORDER = 4
MOST_GRAMS = 500_000  # distinct n-grams of one key that a task counts at once


def bag_overlap(df: DataFrame, left: str, right: str, key: str = "row_id") -> DataFrame:
    """Multiset count of the words of ``left`` found in ``right``, per row.

    A row's words of both sides come from one explode with signed counts; rows dealt by their key are counted where they are.
    Rows without words count 0.
    """
    side = lambda c, p: F.transform(T.words(c), lambda w: F.struct(w.alias("word"), F.lit(p).alias("l"), F.lit(1 - p).alias("r")))
    both = df.repartition(key).select(key, F.inline_outer(F.concat(side(left, 1), side(right, 0))))
    counts = both.groupBy(key, "word").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    shared = F.when(F.col("word").isNotNull(), F.least("l", "r")).otherwise(0)
    return counts.groupBy(key).agg(F.sum(shared).alias("overlap"))


def rule_elements(df: DataFrame, rule: str = "rule", key: str = "row_id") -> DataFrame:
    """One row per scoring element of a rule: (row, position, relation, words, is_entity)."""
    found = df.select(key, F.posexplode(E.elements(F.col(rule))).alias("position", "e"))
    return found.select(key, "position", "e.relation", "e.words", "e.is_entity")


def structure_score(
    pairs: DataFrame,
    pred: str = "pred",
    ref: str = "ref",
    *,
    entity_weight: float = ENTITY_WEIGHT,
    post_process: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Add structural ``precision`` and ``recall`` (0 to 1) of each prediction. No shuffle.

    ``post_process`` is a Column function applied to both sides before scoring.
    """
    prepare = post_process or (lambda c: c)
    scores = E.match_shares(E.drop_clue(prepare(F.col(pred))), E.drop_clue(prepare(F.col(ref))), entity_weight)
    scored = pairs.withColumn("_scores", scores)
    return scored.select(*pairs.columns, F.col("_scores.there").alias("precision"), F.col("_scores.back").alias("recall"))


def f_score(precision: Column, recall: Column) -> Column:
    return F.when((precision == 0) | (recall == 0), F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def structure_f1(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean precision and recall in percent, and F from the two means (not a mean of F)."""
    means = scores.groupBy(*by).agg(F.avg("precision").alias("p"), F.avg("recall").alias("r"))
    return means.select(
        *by,
        (f_score(F.col("p"), F.col("r")) * 100).alias("f_score"),
        (F.col("r") * 100).alias("recall"),
        (F.col("p") * 100).alias("precision"),
    )


def _gram_counts(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Over ``(group, pred, ref)`` in order of the group: ``group, n, gram, p, r, m``.

    A group's counts are one row per order, without group key and gram, once its last row has passed. A group of more than
    ``limit`` grams (a key that many rows share) gives its grams instead, as often as the limit is reached, to be summed up later.
    """
    schema: pa.Schema | None = None
    last, counts, split = None, [], False

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)

    def grams() -> list[tuple]:
        out = [(last, n, " ".join(g), p[g], r[g], 0) for n, (p, r) in enumerate(counts, 1) for g in p.keys() | r.keys()]
        counts.clear()
        return out

    def settled() -> list[tuple]:
        if split:
            return grams()
        sums = [(n, p.total(), r.total(), (p & r).total()) for n, (p, r) in enumerate(counts, 1)]
        counts.clear()
        return [({**last, "key": None}, n, None, p, r, m) for n, p, r, m in sums if p or r]

    for batch in batches:
        out: list[tuple] = []
        if schema is None:
            types = [("group", pa.struct([f.with_nullable(True) for f in batch.schema.field("group").type])), ("n", pa.int32()), ("gram", pa.string()), *[(c, pa.int64()) for c in "prm"]]
            schema = pa.schema(types)
        for group, *texts in zip(*[c.to_pylist() for c in batch.columns]):
            if group != last:
                out += settled()
                last, split = group, False
            if not counts:
                counts += [(Counter(), Counter()) for _ in range(MAX_ORDER)]
            for side, text in enumerate(texts):
                words = text.split(" ") if text else []
                for n, both in enumerate(counts, 1):
                    both[side].update(zip(*(words[i:] for i in range(n))))
            if sum(len(p) + len(r) for p, r in counts) > limit:
                split = True
                out += grams()
                yield rows(out)
                out = []
        if out:
            yield rows(out)
    if last is not None and (out := settled()):
        yield rows(out)


def bleu_counts(pairs: DataFrame, by: Sequence[str] = (), key: str = "row_id", pred: str = "pred", ref: str = "ref") -> DataFrame:
    """Matched and total n-grams of 1 to 4 words per group, and the reference length. Counts of groups may be summed.

    The texts move once, to where their key is dealt; rows of one key stand together there, and their grams are counted one key at a time.
    """
    by = list(by)
    group = F.struct(*[F.col(c).alias(f"by_{i}") for i, c in enumerate(by)], F.col(key).alias("key")).alias("group")
    words = [F.array_join(T.words(c), " ").alias(side) for c, side in ((pred, "pred"), (ref, "ref"))]
    texts = pairs.repartition(key).select(group, *words).filter("pred is not null and ref is not null").sortWithinPartitions("group")
    nullable = StructType([StructField(f.name, f.dataType) for f in texts.schema["group"].dataType])  # counts that are settled name no key
    schema = StructType([StructField("group", nullable), *StructType.fromDDL("n int, gram string, p long, r long, m long").fields])
    limit = MOST_GRAMS
    found = texts.mapInArrow(lambda batches: _gram_counts(batches, limit), schema)
    sums = found.groupBy("group", "n", "gram").agg(*[F.sum(c).alias(c) for c in "prm"])
    match = F.when(F.col("gram").isNull(), F.col("m")).otherwise(F.least("p", "r"))
    names = [F.col(f"group.by_{i}").alias(c) for i, c in enumerate(by)]
    return sums.select(*names, "n", "p", "r", match.alias("_m")).groupBy(*by).agg(
        *[F.sum(F.when(F.col("n") == n, F.col("_m")).otherwise(0)).alias(f"match_{n}") for n in range(1, MAX_ORDER + 1)],
        *[F.sum(F.when(F.col("n") == n, F.col("p")).otherwise(0)).alias(f"total_{n}") for n in range(1, MAX_ORDER + 1)],
        F.sum(F.when(F.col("n") == 1, F.col("r")).otherwise(0)).alias("reference_length"),
    )


def bleu_scores(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """BLEU-4 with its parts from ``bleu_counts``; 0 when an order has no match."""
    precision = {n: F.when(F.col(f"total_{n}") > 0, F.col(f"match_{n}") / F.col(f"total_{n}")).otherwise(0.0) for n in range(1, MAX_ORDER + 1)}
    out = counts.select(
        *by,
        *[p.alias(f"precision_{n}") for n, p in precision.items()],
        F.col("total_1").alias("translation_length"),
        "reference_length",
    )
    orders = [F.col(f"precision_{n}") for n in precision]
    mean_log = sum((F.ln(p) for p in orders[1:]), F.ln(orders[0])) / MAX_ORDER
    ratio = F.col("translation_length") / F.col("reference_length")
    penalty = F.when(F.col("translation_length") == 0, 0.0).when(ratio > 1, 1.0).otherwise(F.exp(1 - 1 / ratio))
    bleu = F.when(F.least(*orders) > 0, F.exp(mean_log) * F.col("brevity_penalty")).otherwise(0.0)
    return out.withColumns({"length_ratio": ratio, "brevity_penalty": penalty}).withColumn("bleu", bleu)


def corpus_bleu(pairs: DataFrame, by: Sequence[str] = (), key: str = "row_id", pred: str = "pred", ref: str = "ref") -> DataFrame:
    """BLEU-4 over a corpus of whitespace tokens, per group."""
    return bleu_scores(bleu_counts(pairs, by, key, pred, ref), by)


def agreement_ratio(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of rows whose two passes agree exactly."""
    return df.agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"))


def extremes(df: DataFrame, score: str, order: str = "row_id") -> DataFrame:
    """The best and the worst row; of equal scores the first. Two aggregates in one pass."""
    row = F.struct(*[F.col(c) for c in df.columns])
    best = F.max_by(row, F.struct(F.col(score), -F.col(order)))
    worst = F.min_by(row, F.struct(F.col(score), F.col(order)))
    both = df.agg(
        F.array(F.struct(F.lit("best").alias("which"), best.alias("r")), F.struct(F.lit("worst").alias("which"), worst.alias("r"))).alias("x")
    )
    return both.select(F.inline("x")).select("which", "r.*")


def best_candidate(candidates: DataFrame, seed: int, key: str = "row_id") -> DataFrame:
    """The best candidate per row (the later run of equals) and its place in the seeded order, from 0.

    The place is counted, not read off a collected list, so a row may have any number of candidates.
    """
    own = F.struct(seed_hash(seed, key, "cand_id").alias("h"), F.col("cand_id"))
    drawn = candidates.withColumn("own", own)
    best = drawn.groupBy(key).agg(F.max_by(F.struct("cand_id", "score", "pred", "own"), F.struct("score", "cand_id")).alias("b"))
    earlier = drawn.select(key, "own").join(best.select(key, F.col("b.own").alias("_best")), key)
    places = earlier.groupBy(key).agg(F.sum((F.col("own") < F.col("_best")).cast("bigint")).alias("position"))
    return best.join(places, key).select(key, "b.cand_id", "b.score", "b.pred", "position")


def trim_padding(df: DataFrame, order: str, pred: str = "pred", ref: str = "ref") -> DataFrame:
    """Drop the trailing rows whose prediction and label are both empty."""
    filled = df.filter((F.col(pred) != "") | (F.col(ref) != ""))
    return df.filter(F.col(order) <= filled.agg(F.max(order)).scalar())
