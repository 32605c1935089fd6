"""Reading and writing corpora, line files, context texts, mixtures and metric logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as st

from sparkrules.operators.curate import stack

CORPUS_SCHEMA = "row_id bigint, file string, text string, rule string"
# Quoted fields may hold commas, line ends and blanks; empty text is written as "" and null as nothing.
CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "quote": '"',
    "multiLine": "true",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}

# A reader needs a null mark that no field can hold, or a quoted empty text would read as null.
READ_OPTIONS = {**CSV_OPTIONS, "nullValue": "\u0000"}


def read_corpus(spark: SparkSession, path: str, schema: st.StructType | str = CORPUS_SCHEMA) -> DataFrame:
    """A corpus CSV with quoted multi-line fields, by an explicit schema."""
    return spark.read.schema(schema).options(**READ_OPTIONS).csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One record per line with its file and line number (from 1), blank lines included.

    Large files are read in splits. The number is the count of lines in the earlier splits of the file
    plus the place within the split, so no task sees more than one split.
    """
    lines = spark.read.text(path).select(
        F.col("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_place"),
    )
    per_split = lines.groupBy("file", "_split").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_split.select("file", "_split", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("file", "_split").orderBy("_place"))
    return lines.join(offsets, ["file", "_split"]).select("file", (F.col("_before") + within).alias("line_no"), "value")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as one value each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_mixture(spark: SparkSession, root: str, names: Sequence[str]) -> DataFrame:
    """The named dataset folders under a root as one table with a ``dataset`` column."""
    parts = [spark.read.parquet(f"{root}/{n}").withColumn("dataset", F.lit(n)) for n in names]
    return stack(parts, allow_missing=True)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a table as parquet, csv or text (one string column)."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.options(**CSV_OPTIONS)
    writer.format(fmt).save(path)


def append_metrics(df: DataFrame, path: str, run: str = "run", partition_by: Sequence[str] = ()) -> None:
    """Append run metrics to a log.

    Runs may be many, so a run is no folder of its own: rows are sorted by run inside each file, and a
    reader of one run skips row groups by their statistics. ``partition_by`` is for columns with few
    values, such as a split.
    """
    writer = df.sortWithinPartitions(run).write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
