"""Splits, samples, folds, mixtures and clusters. Every random choice takes a seed."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrules.operators.curate import contains_any, stack
from sparkrules.operators.ranking import null_safe, rank_rows, seed_hash, top_n
from sparkrules.storage import stored

CENTRE_ROWS = 64  # rows per centre among which the first centres are sought
FIXED_POINT = 1 << 30  # steps of a vector component in exact sums
MATRIX_CELLS = 1 << 20  # numbers of a block of differences
BLOCK_ROWS, MOST_TASKS = 512, 256  # vectors of a block; tasks of a round of k-means, unless the cluster has more cores


def tail_split(df: DataFrame, order: Sequence[str], frac: float) -> DataFrame:
    """Keep the order: the last ``ceil(n * frac)`` rows are ``test``, the others ``train``.

    Only the order columns are ranked; the row at the boundary then splits the whole rows where they are.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    first_test = total - F.ceil(total * F.lit(float(frac))) + 1
    ranked = rank_rows(df.select(*order), order, name="_rank")
    boundary = ranked.filter(F.col("_rank") == first_test).agg(F.min(F.struct(*order))).scalar()
    return df.withColumn("split", F.when(F.struct(*order) >= boundary, "test").otherwise("train"))


def _seeded(df: DataFrame, key: str, seed: int | str) -> DataFrame:
    return df.withColumn("_seeded", seed_hash(seed, key))


def sample_n(df: DataFrame, n: int, seed: int, key: str = "row_id") -> DataFrame:
    """Exactly ``n`` rows (or all), the same ones on every run and engine."""
    ranked = rank_rows(_seeded(df, key, seed), ["_seeded", key], name="_rank", hashed=True, at_most=n)
    return ranked.drop("_seeded", "_rank")


def sample_fraction(df: DataFrame, frac: float, seed: int, key: str = "row_id") -> DataFrame:
    """``floor(n * frac)`` rows; input and label of a row stay together."""
    wanted = df.agg(F.floor(F.count(F.lit(1)) * F.lit(float(frac)))).scalar()
    ranked = rank_rows(_seeded(df, key, seed), ["_seeded", key], name="_rank", hashed=True, at_most=wanted)
    return ranked.drop("_seeded", "_rank")


def sample_per_group(df: DataFrame, group: str, k: int, seed: int, key: str = "row_id") -> DataFrame:
    """At most ``k`` rows per group; of a large group only the buckets that hold its first ``k`` are ranked."""
    hashed = _seeded(df, key, seed)
    return rank_rows(hashed, ["_seeded", key], [group], name="_rank", hashed=True, at_most=k).drop("_seeded", "_rank")


def shuffle(df: DataFrame, seed: int, key: str = "row_id", name: str = "position") -> DataFrame:
    """A seeded permutation as a position column 1..n."""
    return rank_rows(_seeded(df, key, seed), ["_seeded", key], name=name, hashed=True).drop("_seeded")


def shuffle_within(df: DataFrame, by: str, seed: int, key: str, name: str = "position") -> DataFrame:
    """A seeded permutation of the rows of each group, for groups of any size."""
    hashed = df.withColumn("_seeded", seed_hash(seed, by, key))
    return rank_rows(hashed, ["_seeded", key], [by], name=name, hashed=True).drop("_seeded")


def nested_samples(df: DataFrame, sizes: Sequence[int], seed: int, key: str = "row_id") -> DataFrame:
    """Samples of several sizes, each containing the smaller ones, as (sample_size, row)."""
    ranked = rank_rows(_seeded(df, key, seed), ["_seeded", key], name="_rank", hashed=True, at_most=max(sizes))
    fitting = F.filter(F.array(*[F.lit(s).cast("bigint") for s in sizes]), lambda s: s >= F.col("_rank"))
    return ranked.withColumn("sample_size", F.explode(fitting)).drop("_seeded", "_rank")


def every_nth(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Rows 1, n+1, 2n+1, ... in order. Only the order columns are ranked."""
    ranked = rank_rows(df.select(*order), order, name="_rank")
    picked = ranked.filter(F.pmod(F.col("_rank") - 1, F.lit(n)) == 0).select(*[F.col(c).alias(f"_{c}") for c in order])
    return df.join(picked, null_safe(df, picked, order, "_"), "left_semi")


def document_folds(
    df: DataFrame,
    folds: Mapping[str, Sequence[str]],
    train_n: int,
    seed: int,
    *,
    doc: str = "file",
    key: str = "row_id",
) -> DataFrame:
    """Per fold: rows of the held-out documents as ``valid``, and ``train_n`` seeded others as ``train``."""
    member = F.array(
        *[F.struct(F.lit(f).alias("fold"), contains_any(doc, names).alias("held")) for f, names in folds.items()]
    )
    rows = df.select("*", F.inline(member))
    valid = rows.filter("held").withColumn("split", F.lit("valid")).drop("held")
    others = rows.filter("not held").drop("held").withColumn("_seeded", seed_hash(seed, key, "fold"))
    train = rank_rows(others, ["_seeded", key], ["fold"], name="_rank", hashed=True, at_most=train_n)
    return stack([valid, train.drop("_seeded", "_rank").withColumn("split", F.lit("train"))])


def repeat_rows(df: DataFrame, k: int | Column, name: str = "copy") -> DataFrame:
    """Every row ``k`` times, numbered from 1."""
    times = F.lit(k) if isinstance(k, int) else k
    return df.withColumn(name, F.explode(F.sequence(F.lit(1).cast("bigint"), times.cast("bigint"))))


def cap_rows(df: DataFrame, caps: Mapping[str, int], order: Sequence[str], by: str = "dataset") -> DataFrame:
    """The first rows of each capped dataset; datasets without a cap, a null one among them, stay whole.

    Only the order columns are ranked. The last row within each cap then bounds the whole rows.
    """
    cap = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])[F.col(by)]
    slim = df.select(by, *order).filter(F.col(by).isin(list(caps)))
    ranked = rank_rows(slim, order, [by], name="_rank", at_most=max(caps.values())).filter(F.col("_rank") <= cap)
    last = ranked.groupBy(F.col(by).alias("_by")).agg(F.max(F.struct(*order)).alias("_last"))
    bounded = df.join(F.broadcast(last), df[by] == last["_by"], "left")  # one row per cap
    whole = ~F.coalesce(F.col(by).isin(list(caps)), F.lit(False))
    return bounded.filter(whole | (F.struct(*order) <= F.col("_last"))).drop("_by", "_last")


def build_mixture(
    datasets: DataFrame,
    *,
    order: Sequence[str],
    caps: Mapping[str, int] | None = None,
    weights: Mapping[str, int] | None = None,
    swap: tuple[str, DataFrame] | None = None,
    by: str = "dataset",
) -> DataFrame:
    """Cap some datasets, repeat others, and optionally replace one dataset by another table."""
    mixed = datasets
    if swap is not None:
        out, replacement = swap
        mixed = stack([mixed.filter(~F.col(by).eqNullSafe(out)), replacement])
    if caps:
        mixed = cap_rows(mixed, caps, order, by)
    weight = F.lit(1)
    for name, times in (weights or {}).items():
        weight = F.when(F.col(by) == name, F.lit(times)).otherwise(weight)
    return repeat_rows(mixed, weight)


def add_training_rows(df: DataFrame, extra: DataFrame, splits: Sequence[str], code: int = 1) -> DataFrame:
    """Append generated rows with fixed split codes."""
    return stack([df, extra.withColumns({s: F.lit(code) for s in splits})])


def one_per_cluster(df: DataFrame, seed: int, cluster: str = "cluster", key: str = "row_id") -> DataFrame:
    """One seeded representative per cluster, by an aggregate with map-side combine."""
    row = F.struct(*[F.col(c) for c in df.columns])
    order = F.struct(seed_hash(seed, key).alias("h"), F.col(key).alias("k"))
    return df.groupBy(F.col(cluster).alias("_c")).agg(F.min_by(row, order).alias("_row")).select("_row.*")


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the closest centre of every vector, the lowest of equal ones. Rows do not depend on each other, nor on their batch.

    Matrix products tell most centres apart; where two are closer to each other than such products may err, the sums of squares decide.
    """
    out = np.empty(len(vectors), np.int64)
    squares = (centres * centres).sum(axis=1)
    error = 8 * (centres.shape[1] + 8) * np.finfo(np.float64).eps
    step = max(1, MATRIX_CELLS // max(centres.shape))
    for at in range(0, len(vectors), step):
        part = vectors[at : at + step]
        with np.errstate(invalid="ignore", over="ignore"):
            gaps = squares - 2 * (part @ centres.T)  # but for the square of the vector
            best = gaps.argmin(axis=1)
            margin = error * ((part * part).sum(axis=1) + squares.max())
            clear = (gaps <= (gaps[np.arange(len(part)), best] + margin)[:, None]).sum(axis=1) == 1
        out[at : at + step] = best
        rest = np.flatnonzero(~clear)
        out[at + rest] = _nearest_by_squares(part[rest], centres)
    return out


def _nearest_by_squares(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(vectors), np.int64)
    step = max(1, MATRIX_CELLS // centres.size)
    for at in range(0, len(vectors), step):
        gaps = vectors[at : at + step, None, :] - centres[None]
        out[at : at + step] = (gaps * gaps).sum(axis=2).argmin(axis=1)
    return out


def spread_centres(df: DataFrame, k: int, seed: int, vector: str, key: str) -> np.ndarray:
    """Up to ``k`` vectors far from each other: the first by seeded hash, then always the one farthest from those chosen, among the first
    ``CENTRE_ROWS`` times k rows by that hash. That many rows are all the driver ever holds."""
    rows = df.select(seed_hash(seed, key).alias("h"), F.col(vector).cast("array<double>").alias("v"))
    drawn = top_n(rows.filter(F.col("v").isNotNull()), ["h", "v"], CENTRE_ROWS * k).collect()
    vectors = np.array([r.v for r in drawn], np.float64).reshape(len(drawn), len(drawn[0].v) if drawn else 0)
    chosen, gap = [0] if len(drawn) else [], np.full(len(drawn), np.inf)
    while chosen and len(chosen) < k:
        gap = np.minimum(gap, ((vectors - vectors[chosen[-1]]) ** 2).sum(axis=1))
        if not gap.max() > 0:
            break
        chosen.append(int(gap.argmax()))
    return vectors[chosen]


def as_matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def cluster(df: DataFrame, k: int, seed: int, vector: str = "embedding", key: str = "row_id") -> DataFrame:
    """K-means cluster numbers of an embedding column, from 0; the rows with ``cluster``.

    Starts from ``spread_centres`` and goes on until no centre moves: every row is then at its nearest centre and every centre is the mean of
    its rows. Sums are whole numbers (components times ``FIXED_POINT``, below 2^19 before it), so neither the partitioning nor a lost
    executor changes a digit. A round is one stage over blocks of vectors, which stay in the executors or on their disks meanwhile; k sums per
    task, of a bounded number of tasks, come to the driver. Rows without a vector have no cluster.
    """
    kept = df.filter(F.col(vector).isNotNull())
    centres = spread_centres(kept, k, seed, vector, key)
    if len(centres):
        tasks = df.sparkSession.sparkContext.defaultParallelism
        vectors = kept.select(F.col(vector).cast("array<double>").alias("v"))
        # dealt out, since a table of one file would be one task in every round
        blocks = stored(vectors.repartition(tasks).mapInArrow(_packed_blocks, "v binary")).coalesce(max(tasks, MOST_TASKS))
        centres = _fitted(blocks, centres)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = nearest(as_matrix(batch.column(1)), centres)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["_row", "cluster"])

    others = [c for c in df.columns if c != "cluster"]
    packed = kept.select(F.struct(*others).alias("_row"), F.col(vector).cast("array<double>").alias("_v"))
    schema = packed.select("_row", F.lit(0).cast("bigint").alias("cluster")).schema
    none = df.filter(F.col(vector).isNull()).select(*others, F.lit(None).cast("bigint").alias("cluster"))
    return packed.mapInArrow(assigned, schema).select("_row.*", "cluster").unionByName(none)


def _packed_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as the bytes of blocks of them: a round then copies memory instead of reading lists number by number."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array([as_matrix(batch.column(0).slice(at, BLOCK_ROWS)).tobytes()], pa.binary())], ["v"])


def _block_sums(centres: np.ndarray):
    """``_sums`` over blocks, as arrays."""
    dims = centres.shape[1]

    def run(blocks: Iterator[bytes]) -> Iterator[list[np.ndarray]]:
        numbers = (pa.Array.from_buffers(pa.float64(), len(b) // 8, [None, pa.py_buffer(b)]) for b in blocks)
        lists = (pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, dims), pa.int32()), x) for x in numbers)
        for part in _sums(centres)(pa.RecordBatch.from_arrays([x], ["v"]) for x in lists):
            yield [c.to_numpy() for c in part.columns]

    return run


def _fitted(blocks: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centres when none moves any more."""
    held, seen = blocks.rdd.map(lambda row: bytes(row.v)).persist(StorageLevel.MEMORY_AND_DISK), set()
    try:
        while True:
            parts = held.mapPartitions(_block_sums(centres)).collect()
            moved = _moved(centres, *map(np.concatenate, zip(*parts)))
            if np.array_equal(moved, centres) or moved.tobytes() in seen:
                return centres
            seen.add(moved.tobytes())
            centres = moved
    finally:
        held.unpersist()


def _moved(centres: np.ndarray, cluster: np.ndarray, dim: np.ndarray, n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The means of all parts; a centre without rows stays. Totals are added as two halves of 32 bits, which do not overflow."""
    halves, counts = np.zeros((2, *centres.shape), np.int64), np.zeros(centres.shape, np.int64)
    for part, values in ((halves[0], total >> 32), (halves[1], total & 0xFFFFFFFF), (counts, n)):
        np.add.at(part, (cluster, dim), values)
    out = centres.copy()
    for place in zip(*np.nonzero(counts)):
        out[place] = ((int(halves[0][place]) << 32) + int(halves[1][place])) / int(counts[place]) / FIXED_POINT
    return out


def _sums(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros(centres.shape, np.int64), np.zeros(len(centres), np.int64)
        for batch in batches:
            vectors = as_matrix(batch.column(0))
            found = nearest(vectors, centres)
            held, order = np.bincount(found, minlength=len(centres)), np.argsort(found, kind="stable")
            filled = np.flatnonzero(held)
            if len(filled):
                fixed = np.rint(vectors * FIXED_POINT).astype(np.int64)[order]
                totals[filled] += np.add.reduceat(fixed, (np.cumsum(held) - held)[filled])
            counts += held
            if np.abs(totals).max() > 1 << 61:
                yield _parts(totals, counts)
                totals[:], counts[:] = 0, 0
        yield _parts(totals, counts)

    def _parts(totals: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        held = np.flatnonzero(counts)
        dims = totals.shape[1]
        columns = [np.repeat(held, dims), np.tile(np.arange(dims, dtype=np.int32), len(held)), np.repeat(counts[held], dims), totals[held].reshape(-1)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cluster", "dim", "n", "total"])

    return run


def centre(df: DataFrame, vector: str = "embedding") -> Column:
    """The mean vector as a scalar subquery: one map-side combined average per dimension."""
    dims = df.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim")
    means = dims.agg(F.avg(F.col("x").cast("double")).alias("mean"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "mean")))
    return means.agg(F.transform(ordered, lambda d: d["mean"])).scalar()


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def representative(
    df: DataFrame, near: DataFrame, away: DataFrame, k: int, vector: str = "embedding", key: str = "row_id"
) -> DataFrame:
    """The ``k`` rows closest to the centre of ``near`` relative to the centre of ``away``."""
    centred = df.withColumns({"_near": centre(near, vector), "_away": centre(away, vector)})
    score = cosine(F.col(vector), F.col("_near")) - cosine(F.col(vector), F.col("_away"))
    scored = centred.withColumn("score", score).drop("_near", "_away")
    return top_n(scored, [F.col("score").desc(), F.col(key)], k)
