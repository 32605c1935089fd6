"""The row-wise functions on a stream of corpus files.

Text and tree functions are stateless Column expressions, so a streaming DataFrame takes them
unchanged; no watermark or state is involved.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read_corpus_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New parquet corpus files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_columns(df: DataFrame, columns: Mapping[str, Column], path: str, checkpoint: str) -> StreamingQuery:
    """Add columns and append to parquet until the present input is used up; restarts go on from there."""
    return (
        df.withColumns(dict(columns))
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
