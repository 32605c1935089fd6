"""Registered queries over splits, samples, folds, mixtures and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkrules.operators import curate, sample
from sparkrules.plans.inputs import load, with_inputs

SIZES = [1, 3, 5, 10, 15, 20, 25, 30]
FOLDS = {**{f"fold_src{i}": [f"src{i}#"] for i in range(18)}, "fold_others": ["src18#", "src19#"]}


def _rank_sql(seed: int, partition: str = "", extra: str = "") -> str:
    return f"row_number() OVER ({partition} ORDER BY md5(concat_ws(':', row_id, {extra}{seed})), row_id)"


def _slim(spark, sf):
    return load(spark, sf, "corpus").select("row_id", "file", "source")


def tail_split(spark, sf):
    return sample.tail_split(_slim(spark, sf), ["row_id"], 0.1).select("row_id", "split")


def sample_n(spark, sf):
    corpus = load(spark, sf, "corpus")
    few = sample.sample_n(corpus.select("row_id", "text"), 518, 42).withColumn("n", F.lit(518))
    many = sample.sample_n(load(spark, sf, "rules").selectExpr("row_id", "rule as text"), 12_000, 42).withColumn("n", F.lit(12_000))
    return curate.stack([few, many]).select("n", "row_id", "text")


def sample_fraction(spark, sf):
    pairs = load(spark, sf, "text_pairs").select("row_id", "pred", "ref")
    return sample.sample_fraction(pairs, 0.1, 42)


def sample_per_group(spark, sf):
    return sample.sample_per_group(load(spark, sf, "corpus"), "source", 2, 42).select("row_id", "source", "text")


def shuffle(spark, sf):
    return sample.shuffle(_slim(spark, sf), 42).select("row_id", "position")


def shuffle_within(spark, sf):
    turns = load(spark, sf, "conversations").select("conv_id", "turn", "text")
    return sample.shuffle_within(turns, "conv_id", 42, "turn")


def nested_samples(spark, sf):
    return sample.nested_samples(_slim(spark, sf), SIZES, 42).select("sample_size", "row_id", "file")


def every_nth(spark, sf):
    return sample.every_nth(load(spark, sf, "corpus"), 5, ["row_id"]).select("row_id", "text")


def document_folds(spark, sf):
    folds = sample.document_folds(_slim(spark, sf), FOLDS, 518, 42)
    return folds.select("fold", "split", "row_id", "file")


def _datasets(spark, sf):
    docs = load(spark, sf, "documents").select(F.lit("documents").alias("dataset"), F.col("doc_id").alias("row_id"), "text")
    turns = load(spark, sf, "conversations").select(
        F.lit("conversations").alias("dataset"), (F.col("conv_id") * 100 + F.col("turn")).alias("row_id"), "text"
    )
    pages = load(spark, sf, "pages").select(F.lit("pages").alias("dataset"), F.col("page_id").alias("row_id"), F.col("html").alias("text"))
    return curate.stack([docs, turns, pages])


DATASETS_SQL = """d AS (SELECT 'documents' AS dataset, doc_id AS row_id, text FROM documents
  UNION ALL SELECT 'conversations', conv_id * 100 + turn, text FROM conversations UNION ALL SELECT 'pages', page_id, html FROM pages)"""


def repeat_rows(spark, sf):
    return sample.repeat_rows(load(spark, sf, "labels"), 20)


def cap_rows(spark, sf):
    return sample.cap_rows(_datasets(spark, sf), {"documents": 400, "pages": 100}, ["row_id"])


def build_mixture(spark, sf):
    gold = load(spark, sf, "benchmark").select(F.lit("gold").alias("dataset"), F.col("item_id").alias("row_id"), "text")
    mixed = sample.build_mixture(
        _datasets(spark, sf), order=["row_id"], caps={"documents": 400}, weights={"gold": 20, "pages": 2}, swap=("conversations", gold)
    )
    return mixed.select("dataset", "row_id", "copy", "text")


def add_training_rows(spark, sf):
    vectors = load(spark, sf, "vectors").select("row_id", F.col("cluster").alias("random_split"), F.col("cluster").alias("doc_split"))
    extra = load(spark, sf, "benchmark").select(F.col("item_id").alias("row_id"))
    return sample.add_training_rows(vectors, extra, ["random_split", "doc_split"])


def one_per_cluster(spark, sf):
    vectors = load(spark, sf, "vectors").select("row_id", "cluster")
    return sample.one_per_cluster(vectors, 42)


def cluster(spark, sf):
    vectors = load(spark, sf, "vectors").select("row_id", "embedding")
    return sample.cluster(vectors, 40, 42).select("row_id", "cluster")


def cluster_invariants(spark, sf):
    """Rows, clusters, and rows that are nearer to the mean of another cluster than to that of their own."""
    rows = sample.cluster(load(spark, sf, "vectors").drop("cluster"), 40, 42).select("row_id", "cluster", F.col("embedding").cast("array<double>").alias("v"))
    means = rows.select("cluster", F.posexplode("v").alias("dim", "x")).groupBy("cluster", "dim").agg(F.avg("x").alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "m")))
    centres = means.groupBy("cluster").agg(F.transform(ordered, lambda d: d["m"]).alias("m")).agg(F.collect_list(F.struct("cluster", "m")).alias("all"))

    def gap(centre):
        return F.aggregate(F.zip_with("v", centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x)

    gaps = F.transform("all", lambda c: F.struct(gap(c["m"]).alias("gap"), c["cluster"].alias("cluster")))
    judged = rows.join(F.broadcast(centres), F.lit(True)).select("cluster", gaps.alias("gaps"))  # 40 centres in one row
    own = F.get(F.filter("gaps", lambda g: g["cluster"] == F.col("cluster")), F.lit(0))["gap"]
    judged = judged.select("cluster", (own > F.array_min("gaps")["gap"] + 1e-6).alias("misplaced"))
    return judged.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("cluster").alias("n_clusters"), F.count_if("misplaced").alias("n_misplaced")
    )


def representative(spark, sf):
    vectors = load(spark, sf, "vectors")
    turned = vectors.filter("cluster = 3")
    top = sample.representative(vectors, near=vectors, away=turned, k=40)
    return top.select("row_id", "cluster", F.round("score", 6).alias("score"))


def spot_check(spark, sf):
    return sample.sample_n(load(spark, sf, "text_pairs").select("row_id", "pred", "ref"), 1, 42)


QUERIES = {
    "tail_split": (
        tail_split,
        with_inputs(
            """SELECT row_id, CASE WHEN row_number() OVER (ORDER BY row_id) > count(*) OVER () - ceil(count(*) OVER () * 0.1::DOUBLE)
            THEN 'test' ELSE 'train' END AS split FROM corpus""",
            "corpus",
        ),
    ),
    "sample_n": (
        sample_n,
        with_inputs(
            f"""SELECT 518 AS n, row_id, text FROM (SELECT *, {_rank_sql(42)} AS rn FROM corpus) WHERE rn <= 518
            UNION ALL SELECT 12000, row_id, rule FROM (SELECT *, {_rank_sql(42)} AS rn FROM rules) WHERE rn <= 12000""",
            "corpus",
            "rules",
        ),
    ),
    "sample_fraction": (
        sample_fraction,
        with_inputs(
            f"""SELECT row_id, pred, ref FROM (SELECT *, {_rank_sql(42)} AS rn, count(*) OVER () AS n FROM text_pairs)
            WHERE rn <= floor(n * 0.1::DOUBLE)""",
            "text_pairs",
        ),
    ),
    "sample_per_group": (
        sample_per_group,
        with_inputs(
            f"SELECT row_id, source, text FROM (SELECT *, {_rank_sql(42, 'PARTITION BY source')} AS rn FROM corpus) WHERE rn <= 2",
            "corpus",
        ),
    ),
    "shuffle": (shuffle, with_inputs(f"SELECT row_id, {_rank_sql(42)} AS position FROM corpus", "corpus")),
    "shuffle_within": (
        shuffle_within,
        """SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY md5(concat_ws(':', conv_id, turn, 42)), turn) AS position
        FROM conversations""",
    ),
    "nested_samples": (
        nested_samples,
        with_inputs(
            f"""SELECT s AS sample_size, row_id, file FROM (SELECT *, {_rank_sql(42)} AS rn FROM corpus)
            JOIN (SELECT unnest({SIZES})::BIGINT AS s) ON rn <= s""",
            "corpus",
        ),
    ),
    "every_nth": (
        every_nth,
        with_inputs(
            "SELECT row_id, text FROM (SELECT *, row_number() OVER (ORDER BY row_id) AS rn FROM corpus) WHERE (rn - 1) % 5 = 0",
            "corpus",
        ),
    ),
    "document_folds": (
        document_folds,
        with_inputs(
            f""", f AS (SELECT 'fold_src' || i AS fold, ['src' || i] AS held FROM range(18) t(i) UNION ALL SELECT 'fold_others', ['src18', 'src19']),
            x AS (SELECT fold, row_id, file, list_contains(held, source) AS is_held FROM corpus, f),
            t AS (SELECT *, {_rank_sql(42, 'PARTITION BY fold', 'fold, ')} AS rn FROM x WHERE NOT is_held)
            SELECT fold, 'valid' AS split, row_id, file FROM x WHERE is_held UNION ALL SELECT fold, 'train', row_id, file FROM t WHERE rn <= 518""",
            "corpus",
        ),
    ),
    "repeat_rows": (repeat_rows, "SELECT labels.*, i AS copy FROM labels, range(1, 21) t(i)"),
    "cap_rows": (
        cap_rows,
        f"""WITH {DATASETS_SQL} SELECT dataset, row_id, text FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY row_id) AS rn FROM d)
        WHERE dataset = 'conversations' OR (dataset = 'documents' AND rn <= 400) OR (dataset = 'pages' AND rn <= 100)""",
    ),
    "build_mixture": (
        build_mixture,
        f"""WITH {DATASETS_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY row_id) AS rn FROM d WHERE dataset <> 'conversations'
          UNION ALL SELECT 'gold', item_id, text, 0 FROM benchmark)
        SELECT dataset, row_id, i AS copy, text FROM m, range(1, 21) t(i)
        WHERE (dataset <> 'documents' OR rn <= 400) AND i <= CASE dataset WHEN 'gold' THEN 20 WHEN 'pages' THEN 2 ELSE 1 END""",
    ),
    "add_training_rows": (
        add_training_rows,
        """SELECT vec_id AS row_id, label AS random_split, label AS doc_split FROM embeddings
        UNION ALL SELECT item_id, 1, 1 FROM benchmark""",
    ),
    "one_per_cluster": (
        one_per_cluster,
        with_inputs(
            f"SELECT row_id, cluster FROM (SELECT *, {_rank_sql(42, 'PARTITION BY cluster')} AS rn FROM vectors) WHERE rn = 1", "vectors"
        ),
    ),
    "cluster": (cluster, None),
    "cluster_invariants": (
        cluster_invariants,
        """SELECT count(*) AS n_rows, CAST(40 AS BIGINT) AS n_clusters, CAST(0 AS BIGINT) AS n_misplaced FROM embeddings
        WHERE embedding IS NOT NULL""",
    ),
    "representative": (
        representative,
        """WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
        n AS (SELECT d, avg(x) AS c FROM e GROUP BY d), a AS (SELECT d, avg(x) AS c FROM e WHERE label = 3 GROUP BY d),
        s AS (SELECT vec_id, any_value(label) AS cluster, sum(x * n.c) / (sqrt(sum(x * x)) * sqrt(sum(n.c * n.c)))
          - sum(x * a.c) / (sqrt(sum(x * x)) * sqrt(sum(a.c * a.c))) AS score FROM e JOIN n USING (d) JOIN a USING (d) GROUP BY vec_id)
        SELECT vec_id AS row_id, cluster, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 40""",
    ),
    "spot_check": (
        spot_check,
        with_inputs(f"SELECT row_id, pred, ref FROM (SELECT *, {_rank_sql(42)} AS rn FROM text_pairs) WHERE rn = 1", "text_pairs"),
    ),
}
