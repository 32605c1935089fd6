"""K-means at size: the nearest centre is that of the sums of squares, at the cost of a matrix product."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkrules.operators import sample


def test_nearest_is_exact():
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(40, 64))
    centres[7] = centres[3]  # equal centres, and vectors in the middle of two
    centres[9] = centres[4] + 1e-9
    middle = (centres[:20] + centres[20:]) / 2
    vectors = np.concatenate([draw.normal(size=(500, 64)), centres, middle, np.nextafter(middle, 9), 1e8 + centres, np.full((1, 64), np.nan), np.full((1, 64), np.inf)])
    gaps = vectors[:, None, :] - centres[None]
    assert (sample.nearest(vectors, centres) == (gaps * gaps).sum(axis=2).argmin(axis=1)).all()


def test_a_round_costs_a_matrix_product():
    draw = np.random.default_rng(4)
    vectors, centres = draw.normal(size=(60_000, 64)), draw.normal(size=(40, 64))
    column = pa.ListArray.from_arrays(pa.array(np.arange(0, vectors.size + 1, 64), pa.int32()), pa.array(vectors.reshape(-1)))
    batch = pa.RecordBatch.from_arrays([column], ["v"])
    start = time.monotonic()
    out = pa.Table.from_batches(sample._sums(centres)(iter([batch] * 3)))
    assert time.monotonic() - start < 2
    assert sum(out["n"].to_pylist()) == 3 * 64 * 60_000
    found = sample._nearest_by_squares(vectors[:1000], centres)
    small = pa.Table.from_batches(sample._sums(centres)(iter([batch.slice(0, 1000)])))
    whole = np.rint(vectors[:1000] * sample.FIXED_POINT).astype(np.int64)
    assert small["total"].to_pylist() == [x for c in np.unique(found) for x in whole[found == c].sum(axis=0).tolist()]


def plain(vectors, centres):
    """Rounds with Python's whole numbers until nothing moves."""
    seen, rounds = set(), 0
    while True:
        gaps = vectors[:, None, :] - centres[None]
        own, moved, rounds = (gaps * gaps).sum(axis=2).argmin(axis=1), centres.copy(), rounds + 1
        for c in set(own.tolist()):
            rows = [[round(float(x) * sample.FIXED_POINT) for x in v] for v in vectors[own == c]]
            moved[c] = [sum(column) / len(rows) / sample.FIXED_POINT for column in zip(*rows)]
        if np.array_equal(moved, centres) or moved.tobytes() in seen:
            return own, rounds
        seen.add(moved.tobytes())
        centres = moved


def test_a_round_is_one_stage_and_equals_plain_rounds(spark):
    draw = np.random.default_rng(6)
    vectors = draw.normal(size=(700, 6)).astype(np.float32).astype(np.float64)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(9000, None), (9001, vectors[3].tolist())]
    df = spark.createDataFrame(rows, "row_id long, embedding array<float>").repartition(3)
    start = sample.spread_centres(df, 8, 42, "embedding", "row_id")
    want, rounds = plain(np.concatenate([vectors, vectors[3:4]]), start)
    tracker, group = spark.sparkContext.statusTracker(), "a fit"
    vectors = df.filter("embedding is not null").select(F.col("embedding").cast("array<double>").alias("v"))
    blocks = sample.stored(vectors.mapInArrow(sample._packed_blocks, "v binary"))
    spark.sparkContext.setJobGroup(group, "k-means")
    sample._fitted(blocks, start)
    spark.sparkContext.setJobGroup("", "")
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    assert len(jobs) == rounds > 5 and all(len(j.stageIds) == 1 for j in jobs)
    got = {r.row_id: r.cluster for r in sample.cluster(df, 8, 42).collect()}
    assert got == {**dict(enumerate(want[:700].tolist())), 9000: None, 9001: want[700]}
    assert {r.cluster for r in sample.cluster(df.filter("embedding is null"), 8, 42).collect()} == {None}


def test_means_of_parts_that_would_overflow_together():
    centres, full = np.zeros((2, 3)), np.full(6, (1 << 62) + 12345)
    cluster, dim, n = np.ones(6, np.int64), np.arange(6) % 3, np.full(6, 1 << 33)
    assert sample._moved(centres, cluster, dim, n, full).tolist() == [[0.0] * 3, [((1 << 63) + 24690) / (1 << 34) / sample.FIXED_POINT] * 3]
