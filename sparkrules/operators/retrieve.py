"""Exemplar retrieval, budget packing and prompt tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrules.functions import fixed
from sparkrules.functions import text as T
from sparkrules.functions.tree import let
from sparkrules.operators.ranking import hash_fraction, null_safe, rank_rows, rank_within, running, seed_hash
from sparkrules.operators.sample import as_matrix, nearest
from sparkrules.storage import stored

QUERY_BLOCK, ROW_BLOCK = 1024, 20_000  # query and corpus vectors that meet in one product, about
MOST_CELLS, CELL_SAMPLE, CELL_ROUNDS = 1024, 16, 3  # cells, rows per cell that fit the centres, and passes over these
BOUND_SLACK = 1e-8  # more than rounding can add to a score
PACK_HEAD = 32  # exemplars of a first ranking
SEED_ROWS = 4  # rows per wanted one that give the first bound of a ranking
MORE = 4  # grams looked up beyond the least number, so that one chance hit is not enough
MASK_WORDS = 62  # frequent words with a bit of their own
LOOK = 8  # rows per wanted one whose words a walk compares at once
WALK_BLOCK, WALK_WIDTH = 1024, 16  # rows of a block, and blocks, that a walk reads ahead at first
SCORE_DIGITS = 9


def ngrams(text: str | Column, n: int) -> Column:
    """Distinct word n-grams of a text."""

    def grams(ws: Column) -> Column:
        if n == 1:
            return F.array_distinct(ws)
        starts = F.slice(ws, F.lit(1), F.greatest(F.size(ws) - (n - 1), F.lit(0)))
        joined = F.transform(
            starts, lambda w, i: F.concat_ws(" ", w, *[F.get(ws, i + j) for j in range(1, n)])
        )
        return F.array_distinct(joined)

    return let(T.words(text), grams)


def _overlaps(queries: DataFrame, corpus: DataFrame, n: int, carry: Sequence[str] = ()) -> DataFrame:
    rows = corpus.select("row_id", *carry, F.explode(ngrams("text", n)).alias("gram"))
    asked = queries.select("query_id", F.explode(ngrams("text", n)).alias("gram"))
    kept = [F.first(c).alias(c) for c in carry]
    return rows.join(asked, "gram").groupBy("query_id", "row_id").agg(F.count(F.lit(1)).alias("overlap"), *kept)


def ngram_overlap(queries: DataFrame, corpus: DataFrame, n: int) -> DataFrame:
    """Shared distinct n-grams of every (query, row) that share one.

    An inverted-index equi join on the gram. A small query side is broadcast by its measured size;
    else AQE splits hot grams. If the corpus is dealt by ``row_id`` and the query side is broadcast, the
    counts are complete where the row is, and nothing is shuffled; else they combine before their shuffle.
    """
    return _overlaps(queries, corpus, n)


def gram_index(queries: DataFrame, corpus: DataFrame, n: int, carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``asked(query_id, grams)`` and ``rows(row_id, *carry, grams)``, with the distinct n-grams of the queries as numbers.

    Rows hold the grams that any query holds and no others, so texts are read once and everything after it compares numbers. The
    grams of a query come rarest first, as (df, gram); those that no row holds are left out.
    """
    texts = queries.select("query_id", F.explode(ngrams("text", n)).alias("text"))
    words = stored(texts.select("text").distinct().withColumn("gram", F.monotonically_increasing_id()))  # stored, so numbers stay
    found = corpus.select("row_id", *carry, F.explode(ngrams("text", n)).alias("text")).join(words, "text")
    kept = [F.first(c).alias(c) for c in carry]
    rows = stored(found.groupBy("row_id").agg(*kept, F.collect_list("gram").alias("grams")))
    held = rows.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    asked = texts.join(words, "text").join(held, "gram").groupBy("query_id")
    return stored(asked.agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("grams"))), rows


def _numbers(grams: str | Column) -> Column:
    return F.transform(grams, lambda g: g["gram"])


def _meeting(keys: DataFrame, rows: DataFrame) -> DataFrame:
    """How many grams of ``keys(query_id, gram)`` each row holds, if any: (query_id, row_id, met)."""
    pairs = rows.select("row_id", F.explode("grams").alias("gram")).join(keys, "gram")
    return pairs.groupBy("query_id", "row_id").agg(F.count(F.lit(1)).alias("met"))


def _counted(pairs: DataFrame, asked: DataFrame, rows: DataFrame) -> DataFrame:
    """(query, row) pairs with their whole overlap and the other columns of the row, each counted beside the row's own grams."""
    own = rows.withColumnRenamed("grams", "_own")
    overlap = F.size(F.array_intersect("_own", "_asked")).cast("bigint").alias("overlap")
    both = pairs.select("query_id", "row_id").join(asked.select("query_id", _numbers("grams").alias("_asked")), "query_id").join(own, "row_id")
    return both.select("query_id", *[c for c in own.columns if c != "_own"], overlap)


def reachable(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, row_id) of every row that may be among the best ``k``, from the tables of ``gram_index``.

    If k rows are known to hold F grams of a query or more, a row that holds fewer is not among the best k, and of the query's m
    grams it misses m - F at most. So it holds one of the m - F + 1 rarest, and ``MORE`` + 1 of the m - F + 1 + ``MORE`` rarest; the
    other, frequent ones need not be looked up. F is the k-th best overlap among rows that are likely to hold many: those with the most grams of
    all, and those that the query's rarest grams lead to, ``SEED_ROWS`` times k of either. It is a proven bound, though not the best one.
    """
    upto = F.aggregate("g", F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(x["df"] + F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)))))
    rare = asked.select("query_id", F.slice("grams", 1, SEED_ROWS * k).alias("g")).withColumn("_upto", upto)
    rare = rare.select("query_id", F.explode(F.filter(_numbers("g"), lambda x, i: F.get("_upto", i) <= SEED_ROWS * k)).alias("gram"))
    longest = rows.select("row_id", "grams").orderBy(F.size("grams").desc(), "row_id").limit(SEED_ROWS * k)
    keys = asked.select("query_id", F.explode(_numbers("grams")).alias("gram"))
    long = _meeting(keys, longest).withColumnRenamed("met", "overlap")
    seeds = long.unionByName(_counted(_meeting(rare, rows), asked, rows.select("row_id", "grams"))).distinct()
    best = rank_within(seeds, ["query_id"], [F.col("overlap").desc(), F.col("row_id")]).filter(F.col("rank") == k)
    m, least = F.size("grams"), F.coalesce("_f", F.lit(1))
    bound = asked.join(best.select("query_id", F.col("overlap").cast("int").alias("_f")), "query_id", "left")
    prefix = bound.select("query_id", F.least(m - least + 1 + MORE, m).alias("_r"), (least - m).alias("_short"), "grams")
    prefix = prefix.select("query_id", (F.col("_r") + F.col("_short")).alias("_least"), F.slice(_numbers("grams"), F.lit(1), F.col("_r")).alias("g"))
    met = _meeting(prefix.select("query_id", F.explode("g").alias("gram")), rows)
    return met.join(prefix.select("query_id", "_least"), "query_id").filter("met >= _least").select("query_id", "row_id")


def ngram_topk(queries: DataFrame, corpus: DataFrame, n: int, k: int, carry: Sequence[str] = ()) -> DataFrame:
    """The ``k`` rows with the highest overlap per query; ties and rows without overlap go by id.

    Only the rare grams of a query are looked up in the corpus (``reachable``), so a word that stands in every row fans out to no row. The
    rows met are then counted in full, each beside its own grams. Rows without overlap can only enter among the k lowest ids, so those
    are added with zero; of a row that is there twice the zero goes, which the first 2k ranks leave room for. The rank
    filter becomes a per-task top-k ahead of the shuffle by query. ``carry`` names columns of the corpus to bring along.
    """
    asked, rows = gram_index(queries, corpus, n, carry)
    lowest = corpus.select("row_id", *carry).orderBy("row_id").limit(k).agg(F.collect_list(F.struct("row_id", *carry))).scalar()
    fill = queries.select("query_id", F.inline(lowest)).withColumn("overlap", F.lit(0).cast("bigint"))
    order = [F.col("overlap").desc(), F.col("row_id")]
    found = _counted(reachable(asked, rows, k), asked, rows)
    head = rank_within(found.unionByName(fill), ["query_id"], order).filter(F.col("rank") <= 2 * k)
    kept = [F.first(c).alias(c) for c in carry]
    single = head.groupBy("query_id", "row_id").agg(F.max("overlap").alias("overlap"), *kept)
    return rank_within(single, ["query_id"], order).filter(F.col("rank") <= k)


# --- diverse exemplars ------------------------------------------------------------------------------


def _draw(sizes: Sequence[int], seed: int, *ids: str) -> Column:
    """The n-gram size of a pass, from a seeded hash of query and pass."""
    at = F.floor(hash_fraction(seed_hash(seed, *ids)) * len(sizes)).cast("int")
    return F.get(F.array(*[F.lit(n) for n in sizes]), at)


def _walkable(corpus: DataFrame, k: int) -> DataFrame:
    """``row_id, text, words, mask, pos, block``: the rows a walk can ever choose, numbered by id.

    Of rows with one text only the lowest id can be chosen: a copy shares its words in the same pass and is excluded after it. Rows without words
    clash with nothing, so the ``k`` lowest ids of them are enough. Bit i of ``mask`` tells whether a row holds the i-th of the
    corpus' most frequent words, so most clashes show in one comparison of numbers.
    """
    texts = corpus.select(F.col("row_id").cast("bigint").alias("row_id"), "text")
    bare = F.size(T.words("text")) == 0
    single = texts.filter(~bare).groupBy("text").agg(F.min("row_id").alias("row_id"))
    rows = single.select("row_id", "text").unionByName(texts.filter(bare).orderBy("row_id").limit(k))
    rows = rank_rows(rows, ["row_id"], name="pos").withColumn("words", F.array_distinct(T.words("text")))
    often = rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    marks = often.orderBy(F.col("df").desc(), "word").limit(MASK_WORDS).agg(F.collect_list("word").alias("marks"))
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.array_position("marks", w) - 1).cast("int"))
    mask = F.aggregate(F.array_intersect("words", "marks"), F.lit(0).cast("bigint"), lambda a, w: a.bitwiseOR(bit(w)))
    rows = rows.join(F.broadcast(marks), F.lit(True), "left").withColumn("mask", F.coalesce(mask, F.lit(0)))
    return stored(rows.drop("marks").withColumn("block", F.floor(F.col("pos") / WALK_BLOCK)))


def _folded(candidates: Column, k: int) -> Column:
    """Walk candidates in order: take each that shares no word with those taken in this pass, up to ``k`` in all."""

    def step(acc: Column, row: Column) -> Column:
        free = (F.size(acc["picked"]) < k) & ~F.arrays_overlap(acc["used"], row["words"]) & ~F.array_contains(acc["picked"], row["row_id"])
        taken = F.struct(
            F.array_union(acc["used"], row["words"]).alias("used"),
            acc["mask"].bitwiseOR(row["mask"]).alias("mask"),
            F.concat(acc["picked"], F.array(row["row_id"])).alias("picked"),
            (acc["now"] + 1).alias("now"),
        )
        return F.when(free, taken).otherwise(acc)

    return F.aggregate(candidates, F.struct("used", "mask", "picked", "now"), step)


def diverse_exemplars(
    queries: DataFrame, corpus: DataFrame, k: int, seed: int, *, sizes: Sequence[int] = (1, 2), head: int = 32
) -> DataFrame:
    """``k`` word-diverse rows per query as (query_id, pick, row_id).

    A pass ranks the rows not chosen yet by overlap (its n-gram size is drawn per query and pass) and takes every row that shares no
    word with those taken in the pass; passes repeat until ``k`` rows are chosen or a pass takes none.

    The walk is exact without sorting a whole ranking, since only rows that are still eligible matter. Its state is a table with one row
    per query, written anew each round; a round joins the state to the corpus and folds the rows found, a bounded head per query:

    * a pass begins with the best ``head`` of a ranking made once per n-gram size, ``head + k`` long, so that rows chosen before can go;
    * then come rows that hold a gram of the query with no used word, by overlap, and among those without overlap the
      next blocks of rows in the order of their ids, each round eight times as many. A row with a used word is never sent on.

    Nothing passes through the driver but whether any query is unfinished.
    """
    rows = _walkable(corpus, k)
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "text")
    grams = F.map_from_arrays(F.array(*[F.lit(n) for n in sizes]), F.array(*[ngrams("text", n) for n in sizes]))
    texts = stored(asked.select("query_id", grams.alias("grams")))
    slim = rows.select("row_id", "text")
    ranking = stored(reduce(DataFrame.unionByName, [ngram_topk(asked, slim, n, head + k).select("query_id", F.lit(n).alias("n"), "row_id", "overlap") for n in sizes]))
    wanted = texts.select(F.explode("grams").alias("n", "g")).select("n", F.explode("g").alias("gram")).distinct()
    postings = [rows.select("row_id", "mask", F.lit(n).alias("n"), F.explode(ngrams("text", n)).alias("gram")) for n in sizes]
    postings = stored(reduce(DataFrame.unionByName, postings).join(wanted, ["n", "gram"]))
    slim = rows.select("row_id", "pos", "block", "words", "mask")

    zero = F.lit(0).cast("bigint")
    state = texts.select(
        "query_id", F.lit(1).alias("step"), F.lit(True).alias("fresh"), F.array().cast("array<string>").alias("used"), zero.alias("mask"),
        F.array().cast("array<bigint>").alias("picked"), F.lit(0).alias("now"), zero.alias("cursor"), F.lit(WALK_WIDTH).cast("bigint").alias("width"), F.lit(k < 1).alias("done"),
    )
    state = stored(state.withColumn("n", _draw(sizes, seed, "query_id", "step")))
    n_blocks = rows.agg((F.max("block") + 1).alias("n_blocks"))
    while not state.filter("not done").isEmpty():
        state = stored(_next_round(state, texts, ranking, postings, slim, n_blocks, k, head, sizes, seed))
    return state.select("query_id", F.posexplode("picked").alias("pick", "row_id")).withColumn("pick", (F.col("pick") + 1).cast("bigint"))


def _next_round(
    state: DataFrame, texts: DataFrame, ranking: DataFrame, postings: DataFrame, rows: DataFrame, n_blocks: DataFrame, k: int, head: int, sizes: Sequence[int], seed: int
) -> DataFrame:
    """The state after one round of ``diverse_exemplars``."""
    open_ = state.filter("not done")
    order = [F.col("overlap").desc(), F.col("row_id")]
    fresh = open_.filter("fresh").join(ranking, ["query_id", "n"]).filter(~F.array_contains("picked", F.col("row_id")))
    fresh = rank_within(fresh.select("query_id", "row_id", "overlap"), ["query_id"], order).filter(F.col("rank") <= head)
    first = fresh.join(rows, "row_id").select("query_id", "row_id", "overlap", "pos", "words", "mask")

    later = open_.filter("not fresh").join(texts, "query_id").withColumn("_g", F.col("grams")[F.col("n")])
    # a gram with a used word stands in no eligible row; the words of a gram are joined by one blank
    free = F.filter("_g", lambda g: ~F.arrays_overlap(F.split(g, " "), "used"))
    keys = later.select("query_id", "n", F.col("mask").alias("_m"), F.explode(free).alias("gram"))
    met = postings.join(keys, ["n", "gram"]).filter(F.col("mask").bitwiseAND(F.col("_m")) == 0)
    met = met.groupBy("query_id", "row_id").agg(F.count(F.lit(1)).alias("overlap"))
    begin = F.floor(F.col("cursor") / WALK_BLOCK)
    ahead = later.select("query_id", F.col("mask").alias("_m"), "cursor", F.explode(F.sequence(begin, begin + F.col("width") - 1)).alias("block"))
    passed = ahead.join(rows.select("row_id", "pos", "block", "mask"), "block")
    passed = passed.filter((F.col("mask").bitwiseAND(F.col("_m")) == 0) & (F.col("pos") >= F.col("cursor")))
    # words are compared for the first rows only that share none of the frequent ones
    passed = rank_within(passed.select("query_id", "row_id", "pos"), ["query_id"], [F.col("pos")]).filter(F.col("rank") <= LOOK * head)
    seen = passed.groupBy("query_id").agg(F.max("rank").alias("_seen"), F.max("pos").alias("_last"))
    pairs = met.unionByName(passed.select("query_id", "row_id", F.lit(0).cast("bigint").alias("overlap")))
    eligible = ~F.arrays_overlap("words", "used") & ~F.array_contains("picked", F.col("row_id"))
    later = pairs.join(later.select("query_id", "used", "picked"), "query_id").join(rows, "row_id").filter(eligible)
    later = later.select("query_id", "row_id", "overlap", "pos", "words", "mask").withColumn("_near", F.col("overlap") > 0)
    later = rank_within(later, ["query_id", "_near"], order).filter(F.col("rank") <= head).drop("rank", "_near")

    # a row that is near as well as ahead counts as near: the fold meets it first and knows it the second time
    item = F.struct((-F.col("overlap")).alias("o"), "row_id", "pos", "words", "mask")
    heads = first.unionByName(later).groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("rows"))
    joined = open_.join(heads, "query_id", "left").withColumn("rows", F.coalesce("rows", F.expr("filter(array(named_struct('o', 0L, 'row_id', 0L, 'pos', 0L, 'words', array(''), 'mask', 0L)), x -> false)")))
    n_near = F.size(F.filter("rows", lambda r: r["o"] < 0))
    ahead_rows = F.filter("rows", lambda r: r["o"] == 0)
    full = ~F.col("fresh") & (n_near >= head)  # more near rows may follow, so no row ahead is walked yet
    joined = joined.withColumn("_full", full).withColumn("_ahead", ahead_rows)
    walked = F.when(F.col("_full"), F.filter("rows", lambda r: r["o"] < 0)).otherwise(F.col("rows"))
    joined = joined.withColumn("_w", _folded(walked, k)).join(F.broadcast(n_blocks), F.lit(True), "left").join(seen, "query_id", "left")

    end = (F.floor(F.col("cursor") / WALK_BLOCK) + F.col("width")) * WALK_BLOCK
    cut = F.size("_ahead") >= head  # the blocks hold more eligible rows than were sent
    held = F.coalesce(F.col("_seen") >= LOOK * head, F.lit(False))  # or more rows to compare
    after = F.when(cut, F.get("_ahead", F.size("_ahead") - 1)["pos"] + 1).when(held, F.col("_last") + 1).otherwise(end)
    cut = cut | held
    cursor = F.when(F.col("fresh"), F.lit(0)).when(F.col("_full"), F.col("cursor")).otherwise(after)
    over = ~F.col("fresh") & ~F.col("_full") & ~cut & (F.floor(cursor / WALK_BLOCK) >= F.coalesce("n_blocks", F.lit(0)))
    moved = joined.select(
        "query_id", "step", "n", "_w.*", cursor.cast("bigint").alias("cursor"), over.alias("_over"),
        F.when(F.col("fresh"), F.lit(WALK_WIDTH)).when(F.col("_full") | cut, F.col("width")).otherwise(F.col("width") * 8).cast("bigint").alias("width"),
    )
    moved = moved.withColumn("done", (F.size("picked") >= k) | (F.col("_over") & (F.col("now") == 0)))
    anew = F.col("_over") & ~F.col("done")
    moved = moved.withColumn("step", F.when(anew, F.col("step") + 1).otherwise(F.col("step")))
    moved = moved.select(
        "query_id", "step", anew.alias("fresh"), F.when(anew, F.array().cast("array<string>")).otherwise(F.col("used")).alias("used"),
        F.when(anew, F.lit(0)).otherwise(F.col("mask")).cast("bigint").alias("mask"), "picked", F.when(anew, F.lit(0)).otherwise(F.col("now")).alias("now"),
        F.when(anew, F.lit(0)).otherwise(F.col("cursor")).cast("bigint").alias("cursor"), F.when(anew, F.lit(WALK_WIDTH)).otherwise(F.col("width")).cast("bigint").alias("width"),
        "done", F.when(anew, _draw(sizes, seed, "query_id", "step")).otherwise(F.col("n")).alias("n"),
    )
    return state.filter("done").unionByName(moved)


# --- embeddings -------------------------------------------------------------------------------------


@dataclass
class Cells:
    """Cells of vectors: per cell a centre, the distance of the farthest row from it, the number of rows, and its blocks.

    Small cells share a block; a large one is cut into several, ``parts`` from ``block`` on. There are at most ``MOST_CELLS`` cells, so they
    travel with the tasks.
    """

    centres: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray
    block: np.ndarray
    parts: np.ndarray

    def blocks(self, chosen: np.ndarray) -> np.ndarray:
        """By query and block: whether it holds rows of a chosen cell."""
        out = np.zeros((len(chosen), int((self.block + self.parts).max())), bool)
        for cell in np.flatnonzero(self.sizes):
            out[:, self.block[cell] : self.block[cell] + self.parts[cell]] |= chosen[:, cell, None]
        return out

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """By query and cell: no row of the cell has a larger dot product. ``q.v = q.c + q.(v - c) <= q.c + |q| r``."""
        scores = vectors @ self.centres.T
        return scores + np.linalg.norm(vectors, axis=1)[:, None] * self.radius[None] + BOUND_SLACK * (1 + np.abs(scores))

    def nearest_cells(self, vectors: np.ndarray, k: int) -> np.ndarray:
        """By query and cell: whether it is among the best cells that hold ``k`` rows together."""
        order = np.argsort(-(vectors @ self.centres.T), axis=1, kind="stable")
        held = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, held < k, axis=1)
        return out


def cell_index(corpus: DataFrame, vector: str = "embedding", cells: int | None = None, seed: int = 0) -> tuple[DataFrame, Cells]:
    """``rows(row_id, v, cell)`` and their cells, some root of n unless given. Every row lies in the cell of its nearest centre; the
    centres are fitted on the first ``CELL_SAMPLE`` rows per cell by a seeded hash."""
    rows = stored(corpus.filter(F.col(vector).isNotNull()).select(F.col("row_id").cast("bigint").alias("row_id"), F.col(vector).cast("array<double>").alias("v")))
    cells = min(cells or max(1, math.isqrt(rows.count())), MOST_CELLS)
    drawn = rows.select(seed_hash(seed, "row_id").alias("h"), "v").orderBy("h", "v").limit(CELL_SAMPLE * cells).collect()
    vectors = np.array([r.v for r in drawn], np.float64).reshape(len(drawn), len(drawn[0].v) if drawn else 0)
    centres = vectors[:cells].copy()
    for _ in range(CELL_ROUNDS if drawn else 0):
        own = nearest(vectors, centres)
        for c in np.unique(own):
            centres[c] = vectors[own == c].mean(axis=0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = as_matrix(batch.column(1))
            cell = nearest(found, centres)
            gap = np.linalg.norm(found - centres[cell], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(gap)], ["row_id", "v", "cell", "gap"])

    dealt = stored(rows.mapInArrow(deal, "row_id bigint, v array<double>, cell int, gap double"))
    radius, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in dealt.groupBy("cell").agg(F.max("gap").alias("gap"), F.count(F.lit(1)).alias("n")).collect():  # one row per cell
        radius[r.cell], sizes[r.cell] = r.gap, r.n
    return dealt.drop("gap"), Cells(centres, radius, sizes, *_packed(sizes, corpus.sparkSession.sparkContext.defaultParallelism))


def _packed(sizes: np.ndarray, cores: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of every cell: blocks of ``ROW_BLOCK`` rows or, in a small table, one for every two cores."""
    target = max(1, min(ROW_BLOCK, -(-int(sizes.sum()) // max(1, cores // 2))))
    block, parts, at, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for cell, n in enumerate(sizes.tolist()):
        if held and held + n > target:
            at, held = at + 1, 0
        block[cell] = at
        if n > target:
            parts[cell] = -(-n // target)
            at += int(parts[cell])
        else:
            held += n
    return block, parts


def visits(queries: DataFrame, cells: Cells, k: int, first: bool) -> DataFrame:
    """``query_id, v, theta, block``: the blocks of rows a query looks into.

    First those of the cells nearest to it that hold ``k`` rows; then, knowing ``theta``, its k-th score so far, the others with a cell that may
    hold a better one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(at, QUERY_BLOCK)
                vectors = as_matrix(part.column(1))
                chosen = cells.blocks(cells.nearest_cells(vectors, k))
                if not first:
                    theta = part.column(2).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    chosen = ~chosen & cells.blocks(cells.bounds(vectors) >= theta[:, None])
                query, block = np.nonzero(chosen)
                taken = part.take(pa.array(query))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(block.astype(np.int32))], ["query_id", "v", "theta", "block"])

    return queries.select("query_id", "v", "theta").mapInArrow(run, "query_id bigint, v array<double>, theta double, block int")


def _looked_up(found: DataFrame, rows: DataFrame, cells: Cells, k: int) -> DataFrame:
    """The best ``k`` rows of every visit, with scores not below its query's theta: (query_id, row_id, score).

    Rows and visits of a block meet in one partition, rows first: a task holds one block as a matrix and streams the queries past it.
    Neither side is copied for the other but for the visits themselves, and blocks without a visit are not sent.
    """
    numbers = lambda x: F.array(*[F.lit(int(n)) for n in x])
    part = F.pmod(F.xxhash64("row_id"), F.get(numbers(cells.parts), F.col("cell")))
    rows = rows.withColumn("block", (F.get(numbers(cells.block), F.col("cell")) + part).cast("int"))
    rows = rows.join(F.broadcast(found.select("block").distinct()), "block", "left_semi")  # one row per block
    none = F.lit(None).cast("double").alias("theta")
    both = rows.select("block", F.lit(0).alias("side"), F.col("row_id").alias("id"), none, "v").unionByName(
        found.select("block", F.lit(1).alias("side"), F.col("query_id").alias("id"), "theta", "v")
    )
    both = both.repartition("block").sortWithinPartitions("block", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, matrix = None, [], [], None
        for batch in batches:
            block, side = (batch.column(i).to_numpy() for i in range(2))
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(block)]):
                if a == b:
                    continue
                if key != block[a]:
                    key, ids, vectors, matrix = block[a], [], [], None
                piece = batch.slice(a, b - a)
                if side[a] == 0:
                    ids.append(piece.column(2).to_numpy())
                    vectors.append(as_matrix(piece.column(4)))
                elif ids:
                    if matrix is None:
                        matrix, row_ids = np.concatenate(vectors), np.concatenate(ids)
                    for at in range(0, b - a, QUERY_BLOCK):
                        some = piece.slice(at, QUERY_BLOCK)
                        theta = some.column(3).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                        yield _block_topk(some.column(2).to_numpy(), as_matrix(some.column(4)), theta, row_ids, matrix, k)

    return both.mapInArrow(run, "query_id bigint, row_id bigint, score double")


def _block_topk(ids: np.ndarray, queries: np.ndarray, theta: np.ndarray, row_ids: np.ndarray, rows: np.ndarray, k: int) -> pa.RecordBatch:
    """Best ``k`` rows per query of one block of rows, by rounded dot product, not below theta. Ties at the end stay for the order by id."""
    scores = np.round(queries @ rows.T, SCORE_DIGITS) + 0.0
    k = min(k, scores.shape[1])
    least = np.maximum(np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k], theta)
    at, row = np.nonzero(scores >= least[:, None])
    return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(row_ids[row]), pa.array(scores[at, row])], ["query_id", "row_id", "score"])


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int, vector: str = "embedding", cells: int | None = None) -> DataFrame:
    """The ``k`` rows with the highest dot product per query, exact; ties by id. Rows and queries without a vector have no pairs.

    Rows lie in cells with a centre and a radius, which bound the score of every row of a cell. A query looks into its nearest cells first; its
    k-th score there rules out all cells whose bound is lower. Its rows in the others complete the ranking.
    """
    rows, index = cell_index(corpus, vector, cells)
    if not index.sizes.any():  # no row has a vector
        return queries.select(F.col("query_id").cast("bigint").alias("query_id"), *[F.lit(None).cast(t).alias(c) for c, t in (("row_id", "bigint"), ("score", "double"), ("rank", "bigint"))]).limit(0)
    asked = queries.filter(F.col(vector).isNotNull())
    asked = asked.select(F.col("query_id").cast("bigint").alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    order = [F.col("score").desc(), F.col("row_id")]
    begin = visits(asked.withColumn("theta", F.lit(None).cast("double")), index, k, True)
    head = stored(rank_within(_looked_up(begin, rows, index, k), ["query_id"], order).filter(F.col("rank") <= k).drop("rank"))
    theta = head.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("theta"))
    more = _looked_up(visits(asked.join(theta, "query_id", "left"), index, k, False), rows, index, k)
    return rank_within(head.unionByName(more), ["query_id"], order).filter(F.col("rank") <= k)


def hit_union(hits: DataFrame) -> DataFrame:
    """The distinct first hits over all queries."""
    return hits.filter(F.col("rank") == 1).select("row_id").distinct()


# --- packing and prompts ----------------------------------------------------------------------------


def block_text(code: Column, text: Column, rule: Column) -> Column:
    return F.concat(query_text(code, text), rule)


def query_text(code: Column, text: Column) -> Column:
    return F.concat(F.lit(fixed.SOURCE_MARK), code, F.lit(" "), text, F.lit("\n" + fixed.TARGET_MARK + " "))


def token_count(text: Column) -> Column:
    return F.size(T.words(text)).cast("bigint")


def max_pair_tokens(df: DataFrame, pair: Column) -> DataFrame:
    """Tokens of the longest input and output pair."""
    return df.agg(F.max(token_count(pair)).alias("max_pair_tokens"))


def exemplar_bound(corpus: DataFrame, room: int, tokens: str = "n_tokens") -> int:
    """How many exemplars can fit: no more than the room holds of the shortest one."""
    shortest = corpus.agg(F.min(tokens)).first()[0]
    return max(0, room // max(1, shortest)) if shortest is not None else 0


def pack_budget(ranked: DataFrame, room: Column | int, tokens: str = "n_tokens") -> DataFrame:
    """Keep each query's longest prefix of exemplars whose tokens fit in ``room``.

    A query has at most ``exemplar_bound`` ranked rows, so the running sum is a small window.
    """
    window = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    room = F.lit(room) if isinstance(room, int) else room
    summed = ranked.withColumn("packed_tokens", F.sum(tokens).over(window))
    return summed.filter(F.col("packed_tokens") <= room)


def reasoning_text(code: Column, text: Column, *, step_by_step: bool = False) -> Column:
    """The query of a reasoning prompt: it asks for no target, but for steps if wanted."""
    return F.concat(F.lit(fixed.SOURCE_MARK), code, F.lit(" "), text, F.lit("\n" + (fixed.STEP_BY_STEP if step_by_step else "")))


#: What a prompt is made of, in order: the context, the exemplars, and a closing text ahead of the query.
LAYOUT = ("context", "exemplars", "closing")


def _in_layout(blocks: Column, query: Column, context: str, closing: str, layout: Sequence[str]) -> Column:
    """Parts in their order. Exemplars that come first are parted from what follows by a blank line, as is the query from all."""
    parts = {"context": F.lit(context), "exemplars": F.coalesce(F.array_join(blocks, "\n\n"), F.lit("")), "closing": F.lit(closing)}
    if layout[0] == "exemplars":
        parts["exemplars"] = F.concat(parts["exemplars"], F.lit("\n\n"))
    return F.concat(*[parts[name] for name in layout], F.lit("\n\n"), query)


def assemble_prompts(
    packed: DataFrame,
    queries: DataFrame,
    query: Column,
    *,
    context: str = "",
    closing: str = "",
    layout: Sequence[str] = LAYOUT,
    nearest_last: bool = False,
) -> DataFrame:
    """One prompt per query: context, exemplar blocks in rank order (or reversed), a closing text, the query itself."""
    blocks = F.array_sort(F.collect_list(F.struct("rank", "block")))
    joined = packed.groupBy("query_id").agg(blocks.alias("_blocks"))
    ordered = F.reverse("_blocks") if nearest_last else F.col("_blocks")
    texts = F.transform(ordered, lambda b: b["block"])
    return queries.join(joined, "query_id", "left").select(
        "query_id",
        F.coalesce(F.size("_blocks"), F.lit(0)).cast("bigint").alias("n_exemplars"),
        _in_layout(texts, query, context, closing, layout).alias("prompt"),
    )


def _room(queries: DataFrame, budget: int, *texts: str) -> int:
    """Tokens left for exemplars beside the given texts and the longest query."""
    longest = max_pair_tokens(queries, query_text(F.col("code"), F.col("text"))).first()[0] or 0
    return budget - sum(len(t.split()) for t in texts) - longest


def ranked_prompts(
    ranked: DataFrame,
    queries: DataFrame,
    corpus: DataFrame,
    *,
    budget: int,
    context: str = "",
    closing: str = "",
    layout: Sequence[str] = LAYOUT,
    nearest_last: bool = False,
    query: Column | None = None,
) -> DataFrame:
    """Prompts from any ranking (query_id, rank, row_id): the diverse walk, a vector ranking, a table of one's own."""
    block = block_text(F.col("code"), F.col("text"), F.col("rule")).alias("block")
    room = _room(queries, budget, context, closing)
    sized = ranked.select("query_id", "rank", "row_id").join(corpus.select("row_id", block), "row_id").withColumn("n_tokens", token_count(F.col("block")))
    packed = pack_budget(sized, room)
    own = query_text(F.col("code"), F.col("text")) if query is None else query
    return assemble_prompts(packed, queries, own, context=context, closing=closing, layout=layout, nearest_last=nearest_last)


def given_prompts(
    exemplars: DataFrame,
    queries: DataFrame,
    *,
    budget: int,
    order: Sequence[str] = ("row_id",),
    context: str = "",
    closing: str = "",
    layout: Sequence[str] = LAYOUT,
    nearest_last: bool = False,
    query: Column | None = None,
) -> DataFrame:
    """Prompts that all show the same exemplars: the longest prefix of ``exemplars(code, text, rule)`` in ``order`` that fits.

    The prefix is found once by carried totals, and holds no more blocks than the budget has tokens.
    """
    room = _room(queries, budget, context, closing)
    block = block_text(F.col("code"), F.col("text"), F.col("rule"))
    sized = exemplars.select(*order, token_count(block).alias("n_tokens"))
    totals = running(sized, list(order), {"_sum": ("sum", F.col("n_tokens")), "_at": ("count", F.lit(1))}, keep_below=("_sum", max(room, 0) + 1))
    kept = totals.filter(F.col("_sum") <= room).select(*[F.col(c).alias(f"_{c}") for c in order], "_at")
    fitting = exemplars.select(*order, block.alias("block")).join(kept, null_safe(exemplars, kept, order, "_"))
    ordered = F.array_sort(F.collect_list(F.struct("_at", "block")))
    shown = fitting.agg((F.reverse(ordered) if nearest_last else ordered).alias("_blocks"))
    texts = F.transform("_blocks", lambda b: b["block"])
    own = query_text(F.col("code"), F.col("text")) if query is None else query
    return queries.join(F.broadcast(shown), F.lit(True), "left").select(  # one row
        "query_id", F.size("_blocks").cast("bigint").alias("n_exemplars"), _in_layout(texts, own, context, closing, layout).alias("prompt")
    )


def pack_exemplars(
    queries: DataFrame, corpus: DataFrame, *, budget: int, n: int = 1, context: str = "", head: int = PACK_HEAD
) -> DataFrame:
    """Ranked exemplars that fit: (query_id, row_id, overlap, n_tokens, rank, packed_tokens).

    ``queries`` has (query_id, code, text), ``corpus`` has (row_id, code, text, rule). Only ids and
    token counts go through ranking and packing. A ranking starts with the best ``head`` rows; for queries that these do not fill, with
    four times as many, until they are full or hold as many as the shortest exemplar could ever let fit.
    """
    sized = corpus.select("row_id", "text", token_count(block_text(F.col("code"), F.col("text"), F.col("rule"))).alias("n_tokens"))
    longest = max_pair_tokens(queries, query_text(F.col("code"), F.col("text"))).first()[0] or 0
    room = budget - len(context.split()) - longest
    most, open_, packed = max(1, exemplar_bound(sized, room)), queries, []
    while True:
        head = min(head, most)
        ranked = stored(ngram_topk(open_, sized, n, head, ["n_tokens"]))
        if head == most:
            return reduce(DataFrame.unionByName, [*packed, pack_budget(ranked, room)])
        # a head that is shorter than asked for is the whole corpus
        full = ranked.groupBy("query_id").agg(F.sum("n_tokens").alias("_sum"), F.count(F.lit(1)).alias("_n")).filter(f"_sum > {room} or _n < {head}").select("query_id")
        packed.append(pack_budget(ranked.join(full, "query_id", "left_semi"), room))
        open_ = stored(open_.join(full, "query_id", "left_anti"))
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, packed)
        head *= 4


def exemplar_prompts(
    queries: DataFrame,
    corpus: DataFrame,
    *,
    budget: int,
    n: int = 1,
    context: str = "",
    nearest_last: bool = False,
) -> DataFrame:
    """For each query text: retrieve exemplars, pack them into the budget, assemble the prompt.

    The texts are looked up for the exemplars that made it into a prompt only.
    """
    packed = pack_exemplars(queries, corpus, budget=budget, n=n, context=context).select("query_id", "rank", "row_id")
    block = block_text(F.col("code"), F.col("text"), F.col("rule")).alias("block")
    texts = corpus.select("row_id", block).join(packed, "row_id")
    return assemble_prompts(
        texts, queries, query_text(F.col("code"), F.col("text")), context=context, nearest_last=nearest_last
    )


def exemplar_counts(packed: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Mean number of exemplars used per run, with smallest and largest."""
    counts = packed.groupBy(*by, "query_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.avg("n").alias("mean_exemplars"),
        F.min("n").alias("min_exemplars"),
        F.max("n").alias("max_exemplars"),
    )


def reflection_prompts(
    candidates: DataFrame, rows: DataFrame, mode: str, seed: int, *, with_answer: bool = False, key: str = "row_id"
) -> DataFrame:
    """Prompts over the candidates of a row, in a seeded order: ``choose``, ``options`` or ``improve``.

    ``candidates`` has (row, cand_id, score, pred), ``rows`` has (row, code, text, rule). With an answer
    the prompt is an exemplar: the best candidate, its option number, or the rule itself. Of equal
    scores the later run wins.
    """
    return reflection_variants(candidates, rows, (mode,), seed, answers=(with_answer,), key=key).select(key, "prompt")


def reflection_variants(
    candidates: DataFrame,
    rows: DataFrame,
    modes: Sequence[str],
    seed: int,
    *,
    answers: Sequence[bool] = (False, True),
    key: str = "row_id",
) -> DataFrame:
    """``(key, mode, with_answer, prompt)`` for every mode, without and with the answer, from one list of candidates per row."""
    drawn = candidates.groupBy(key).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    seed_hash(seed, key, "cand_id").alias("h"), F.col("cand_id"), F.col("score"), F.col("pred")
                )
            )
        ).alias("_c")
    )
    option = lambda c, i: F.concat(F.lit("Option "), i, F.lit(": "), c["pred"])
    scored = F.transform("_c", lambda c, i: F.struct(c["score"], c["cand_id"], i.alias("at"), c["pred"]))
    right = {
        "choose": F.array_max(scored)["pred"],
        "options": F.concat(F.lit("Option "), F.array_max(scored)["at"]),
        "improve": F.col("rule"),
    }
    head = F.concat(F.lit(fixed.SOURCE_MARK), F.col("code"), F.lit(" "), F.col("text"), F.lit("\n"))
    variants = []
    for mode in modes:
        lines = F.transform("_c", option if mode == "options" else lambda c: c["pred"])
        asked = F.concat(head, F.array_join(lines, "\n"), F.lit("\n" + fixed.TARGET_MARK + " "))
        for answer in answers:
            prompt = F.concat(asked, right[mode]) if answer else asked
            variants.append(F.struct(F.lit(mode).alias("mode"), F.lit(answer).alias("with_answer"), prompt.alias("prompt")))
    return rows.join(drawn, key).select(key, F.inline(F.array(*variants)))
