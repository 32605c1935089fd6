"""Ranks, running totals and samples: equal to plain windows, also with one group holding most rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkrules.operators import curate, ranking, sample


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, clustered ids, several partitions."""
    return spark.range(6000).select(
        (F.col("id") * F.when(F.col("id") < 3000, 1).otherwise(1000)).alias("row_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("file"),
        (F.col("id") % 17).alias("v"),
    ).repartition(5)


@pytest.mark.parametrize("by", [[], ["file"]])
def test_running_equals_window(skewed, by):
    totals = {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "m": ("max", F.col("v"))}
    window = Window.partitionBy(*by).orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0)
    got = ranking.running(skewed, ["row_id"], totals, by, buckets=16)
    plain = skewed.withColumns({"n": F.count(F.lit(1)).over(window), "s": F.sum("v").over(window), "m": F.max("v").over(window)})
    assert got.select(*plain.columns).exceptAll(plain).count() == 0
    assert got.count() == plain.count()


def test_exclusive_running(skewed):
    window = Window.orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    got = ranking.running(skewed, ["row_id"], {"m": ("max", F.col("v"))}, inclusive=False, buckets=8)
    plain = skewed.withColumn("m", F.max("v").over(window))
    assert got.select(*plain.columns).exceptAll(plain).count() == 0


def test_rank_at_most_and_hashed(skewed):
    hashed = skewed.withColumn("h", ranking.seed_hash(3, "row_id"))
    got = ranking.rank_rows(hashed, ["h", "row_id"], ["file"], hashed=True, at_most=7)
    plain = hashed.withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy("h", "row_id")).cast("bigint")).filter("rank <= 7")
    assert sorted(got.select("row_id", "rank").collect()) == sorted(plain.select("row_id", "rank").collect())


def test_buckets_spread_one_order_over_tasks(spark, skewed):
    big = ranking.rank_rows(skewed, ["row_id"], buckets=64)
    sizes = big.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 6000 * 0.6
    plan = big._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_small_tables_equal_the_plain_window(skewed):
    window = Window.orderBy("row_id")
    got = ranking.rank_rows(skewed, ["row_id"])
    plain = skewed.withColumn("rank", F.row_number().over(window).cast("bigint"))
    assert got.select(*plain.columns).exceptAll(plain).count() == 0
    assert ranking.rank_rows(skewed.limit(0), ["row_id"]).count() == 0


def test_samples_are_exact_nested_and_stable(skewed):
    assert sample.sample_n(skewed, 100, 1).count() == 100
    assert sample.sample_n(skewed, 10**6, 1).count() == 6000
    large = sample.rank_rows(skewed.withColumn("h", ranking.seed_hash(1, "row_id")), ["h", "row_id"], hashed=True, at_most=100)
    assert {r.row_id for r in large.collect()} == {r.row_id for r in sample.sample_n(skewed, 100, 1).collect()}
    again = sample.sample_n(skewed.repartition(1), 100, 1)
    assert {r.row_id for r in again.collect()} == {r.row_id for r in sample.sample_n(skewed, 100, 1).collect()}
    nested = sample.nested_samples(skewed, [1, 3, 5], 1).collect()
    ids = {s: {r.row_id for r in nested if r.sample_size == s} for s in (1, 3, 5)}
    assert ids[1] < ids[3] < ids[5] and [len(ids[s]) for s in (1, 3, 5)] == [1, 3, 5]


def test_splits_cover_and_do_not_overlap(skewed):
    split = sample.tail_split(skewed, ["row_id"], 0.1)
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 5400, "test": 600}
    edge = split.groupBy("split").agg(F.min("row_id").alias("lo"), F.max("row_id").alias("hi")).collect()
    bounds = {r["split"]: (r.lo, r.hi) for r in edge}
    assert bounds["train"][1] < bounds["test"][0]
    held = curate.holdout_split(skewed, ["g1", "hot"])
    assert held.count() == 6000 and set(r[0] for r in held.select("split").distinct().collect()) == {"train", "valid"}


def test_groups_and_clusters(spark, skewed):
    per_group = sample.sample_per_group(skewed, "file", 2, 5).groupBy("file").count()
    assert per_group.filter("count > 2").count() == 0 and per_group.count() == skewed.select("file").distinct().count()
    vectors = spark.range(300).select(F.col("id").alias("row_id"), F.array(*[(F.col("id") % 3 * 10 + F.rand(i)).cast("float") for i in range(4)]).alias("embedding"))
    found = sample.cluster(vectors, 3, 1)
    assert found.select("cluster").distinct().count() == 3
    assert sample.one_per_cluster(found, 1).count() == 3


def test_folds_keep_their_sizes(skewed):
    folds = sample.document_folds(skewed, {"a": ["hot"], "b": ["g1", "g2"]}, 50, 1)
    train = {r.fold: r["count"] for r in folds.filter("split = 'train'").groupBy("fold").count().collect()}
    assert train == {"a": 50, "b": 50}
    assert folds.filter("fold = 'a' AND split = 'train' AND file = 'hot'").count() == 0


def test_set_operations(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "row_id int, text string")
    rest = curate.remainder(df, df.filter("row_id = 1"), "text").collect()
    assert sorted(r.row_id for r in rest) == [3, 4]
    flags = curate.tag_flags(spark.createDataFrame([(None,), ("Tacit x",), ("MediumData",)], "comments string"))
    assert [(r.has_tacit, r.has_medium) for r in flags.collect()] == [(False, False), (True, False), (False, True)]
    patched = curate.apply_corrections(
        df, spark.createDataFrame([(3, 2, "x", "y"), (3, 1, "b", "x")], "row_id int, seq int, find string, put string"), "text"
    )
    assert {r.row_id: r.text for r in patched.collect()} == {1: "a", 2: "a", 3: "y", 4: None}


def test_overlay_keeps_null_updates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "row_id int, text string")
    updates = spark.createDataFrame([(1, None)], "row_id int, text string")
    out = curate.overlay(df, updates, "text", F.upper("text"))
    assert {r.row_id: r.text for r in out.collect()} == {1: None, 2: "B"}


def _with_nulls(spark):
    rows = [(None if i == 50 else i, None if i % 7 == 0 else f"d{i % 3}", f"t{i}") for i in range(100)]
    return spark.createDataFrame(rows, "row_id long, dataset string, text string")


@pytest.mark.parametrize("buckets", [None, 5])
def test_null_groups_and_keys_are_ranked_like_others(spark, buckets):
    from pyspark.sql import Window

    df = _with_nulls(spark)
    got = ranking.rank_rows(df, ["row_id"], ["dataset"], buckets=buckets)
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("dataset").orderBy("row_id")).cast("long"))
    assert got.count() == 100 and got.exceptAll(want.select(got.columns)).isEmpty()


def test_samples_keep_null_groups(spark):
    df = _with_nulls(spark)
    assert sample.shuffle_within(df, "dataset", 1, "text").count() == 100
    assert sample.sample_per_group(df, "dataset", 2, 1, "text").groupBy("dataset").count().filter("count <> 2").isEmpty()
    assert sample.sample_per_group(df, "dataset", 2, 1, "text").count() == 8
    assert sample.cap_rows(df, {"absent": 3}, ["row_id"]).count() == 100
    assert sample.cap_rows(df, {"d1": 3}, ["row_id"]).count() == 100 - df.filter("dataset = 'd1'").count() + 3
    extra = spark.createDataFrame([(1000, "new", "x")], df.schema)
    assert sample.build_mixture(df, order=["row_id"], swap=("d0", extra)).count() == 101 - df.filter("dataset = 'd0'").count()


def test_splits_keep_every_row(spark):
    df = _with_nulls(spark)
    split = sample.tail_split(df, ["row_id"], 0.1)
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 90, "test": 10}
    assert sample.every_nth(df, 4, ["row_id"]).count() == 25


def test_overlay_and_alignment_lose_and_double_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "row_id long, text string")
    updates = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "w", 0)], "row_id long, text string, at int")
    out = curate.overlay(df, updates, "text", F.col("text"), order=F.col("at"))
    assert sorted((r.row_id or 0, r.text) for r in out.collect()) == [(0, "c"), (1, "y"), (2, "b")]
    other = spark.createDataFrame([(k,) for k in range(5)], "other long")
    both = curate.align_by_position(df.filter("row_id > 0"), other, ["row_id"], ["other"])
    assert sorted((r.position, r.row_id, r.other) for r in both.collect()) == [(1, 1, 0), (2, 2, 1), (3, None, 2), (4, None, 3), (5, None, 4)]


def test_clusters_are_a_fixpoint_on_any_partitioning(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(size=(30, 4)) + 20 * c for c in range(3)] + [np.ones((15, 4))])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(points)] + [(500, None)]
    df = spark.createDataFrame(rows, "row_id long, embedding array<double>")
    found = [{r.row_id: r.cluster for r in sample.cluster(df.repartition(n), 6, 3).collect()} for n in (1, 7)]
    assert found[0] == found[1] and found[0].pop(500) is None
    own = np.array([found[0][i] for i in range(len(points))])
    centres = np.stack([points[own == c].mean(axis=0) for c in range(own.max() + 1)])
    gaps = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (gaps[range(len(points)), own] <= gaps.min(axis=1) + 1e-6).all() and len(set(own)) == 6
    assert sample.cluster(df.limit(0), 3, 1).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], df.schema)
    assert {r.cluster for r in sample.cluster(same, 4, 1).collect()} == {0}


@pytest.mark.parametrize("skip", [0, 7, 11, 12])
def test_grid_numbers_are_digits(spark, skip):
    axes = {
        "rate": spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.1)], "r double"),
        "name": spark.createDataFrame([(x,) for x in ("hb", "ha", "hc", None)], "n string"),
        "on": spark.createDataFrame([(True,), (False,)], "o boolean"),
    }
    plain = [(r, n, o) for r in (0.1, 0.2) for n in ("ha", "hb", "hc") for o in (False, True)]
    grid = curate.param_grid(axes, skip, block=5)
    assert sorted(tuple(r) for r in grid.collect()) == [(i, *plain[i]) for i in range(skip, 12)]
    assert "Cartesian" not in (plan := grid._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    assert curate.param_grid(axes | {"none": axes["on"].limit(0)}).collect() == []


def test_early_stop_over_segments(spark):
    from sparkrules.operators import runs

    rng = __import__("random").Random(4)
    logs = {r: [rng.choice([-1.0, 0.0, 1.0, 2.0, 3.0]) + (i / 40 if r == "hot" else 0) for i in range(n)] for r, n in {"hot": 400, "a": 9, "b": 1, None: 30}.items()}
    log = spark.createDataFrame([(r, i, v) for r, vs in logs.items() for i, v in enumerate(vs)], "run string, step long, value double").repartition(3)
    for patience in (2, 9, 1000):
        want = []
        for r, vs in logs.items():
            best, last = 0.0, 0
            for i, v in enumerate(vs, 1):
                improved = v > best
                best, last = max(best, v), i if improved else last
                want.append((r, i - 1, v, i, improved, best, i - last))
                if i - last >= patience:
                    break
        got = runs.early_stop(log, patience, buckets=13)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
