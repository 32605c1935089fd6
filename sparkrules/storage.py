"""The shared folder for tables that cut a lineage.

A cluster names it in ``spark.checkpoint.dir``. Only a local session may go without: it gets a folder of
its own that is removed when the interpreter ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[tempfile.TemporaryDirectory] = []


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        if not _local:
            _local.append(tempfile.TemporaryDirectory(prefix="sparkrules-"))
        base = _local[0].name
    return base.rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    """A new name under the shared folder, below one folder per application."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read from there.

    What follows neither computes them again nor loses them with an executor.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of ``df`` in their partitions and order, kept in the shared folder by a reliable checkpoint."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
