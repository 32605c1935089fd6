"""Registered queries over sources and sinks: write whole tables to a scratch folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkrules.plans.inputs import load, with_inputs
from sparkrules.sources import io
from sparkrules.storage import scratch_path


def read_corpus(spark, sf):
    path = scratch_path(spark)
    corpus = load(spark, sf, "corpus").select("row_id", "file", "text", "lang")
    io.write_table(corpus, path, "csv")
    return io.read_corpus(spark, path, "row_id bigint, file string, text string, lang string")


def read_lines(spark, sf):
    """One file per attempt, its lines in row order."""
    path = scratch_path(spark)
    lines = load(spark, sf, "responses").select("attempt", "row_id", F.translate("response", "\n\r", "  ").alias("value"))
    files = lines.repartition("attempt").sortWithinPartitions("attempt", "row_id").drop("row_id")
    files.write.partitionBy("attempt").text(path)
    found = io.read_lines(spark, path)
    return found.select(F.regexp_extract("file", "attempt=([0-9]+)", 1).cast("bigint").alias("attempt"), "line_no", "value")


def read_text(spark, sf):
    """One context text per file."""
    path = scratch_path(spark)
    load(spark, sf, "questions").select("query_id", "text").write.partitionBy("query_id").text(path)
    whole = io.read_text(spark, path)
    return whole.select(F.regexp_extract("file", "query_id=([0-9]+)", 1).cast("bigint").alias("query_id"), "text")


def read_mixture(spark, sf):
    root = scratch_path(spark)
    parts = {
        "documents": load(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text", "lang"),
        "benchmark": load(spark, sf, "benchmark").select(F.col("item_id").alias("row_id"), "text"),
        "pages": load(spark, sf, "pages").select(F.col("page_id").alias("row_id"), F.col("html").alias("text")),
    }
    for name, part in parts.items():
        io.write_table(part, f"{root}/{name}")
    return io.read_mixture(spark, root, list(parts))


def append_metrics(spark, sf):
    path = scratch_path(spark)
    io.append_metrics(load(spark, sf, "metric_log"), path, partition_by=["event_type"])
    scores = load(spark, sf, "labels").selectExpr("doc_id as run", "bigint(quality) as step", "double(toxic) as value", "'label' as event_type")
    io.append_metrics(scores, path, partition_by=["event_type"])
    return spark.read.parquet(path).select("run", "step", "value", "event_type")


QUERIES = {
    "read_corpus": (read_corpus, with_inputs("SELECT row_id, file, text, lang FROM corpus", "corpus")),
    "read_lines": (
        read_lines,
        with_inputs(
            """SELECT attempt, row_number() OVER (PARTITION BY attempt ORDER BY row_id) AS line_no,
            translate(response, chr(10) || chr(13), '  ') AS value FROM responses""",
            "responses",
        ),
    ),
    "read_text": (read_text, "SELECT item_id AS query_id, text || chr(10) AS text FROM benchmark"),
    "read_mixture": (
        read_mixture,
        """SELECT doc_id AS row_id, text, lang, 'documents' AS dataset FROM documents
        UNION ALL SELECT item_id, text, NULL, 'benchmark' FROM benchmark UNION ALL SELECT page_id, html, NULL, 'pages' FROM pages""",
    ),
    "append_metrics": (
        append_metrics,
        """SELECT user_id AS run, event_id AS step, value, event_type FROM events
        UNION ALL SELECT doc_id, quality::BIGINT, toxic::DOUBLE, 'label' FROM labels""",
    ),
}
