"""Run logs and reports: early stopping, best epochs, seed means, pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkrules.operators.ranking import segments


def early_stop(
    log: DataFrame, patience: int, *, run: str = "run", step: str = "step", metric: str = "value", buckets: int | None = None
) -> DataFrame:
    """The rows a run would have logged before stopping, with best so far and epochs since.

    An epoch improves when its metric exceeds the best before it (0 at first). A run stops after the
    first epoch that leaves ``patience`` epochs without improvement.

    The log is dealt once by run and step. A segment of a run sums up as its number of epochs, its highest value and that value's first
    epoch, since the last improvement within a segment is its highest value or none. The segments before give each segment its first
    epoch number, its best so far and the epoch of it, and one window inside the segment does the rest: one long run spreads over many tasks.
    """
    rows = segments(log, [run], [step], buckets)
    inside = Window.partitionBy(run, "_bucket").orderBy(step)
    rows = rows.withColumn("_at", F.row_number().over(inside).cast("bigint"))
    high = F.max_by(F.col("_at"), F.struct(metric, -F.col("_at"))).alias("_high_at")
    summary = rows.groupBy(run, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.max(metric).alias("_high"), high)
    earlier = Window.partitionBy(run).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("_skip", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    place = F.struct(F.col("_high").alias("v"), (-F.col("_skip") - F.col("_high_at")).alias("at"))
    before = F.when(F.col("_high") > 0, place)
    carry = summary.select(F.col(run).alias("_run"), F.col("_bucket").alias("_segment"), "_skip", F.max(before).over(earlier).alias("_best"))
    joined = rows.join(carry, rows[run].eqNullSafe(carry["_run"]) & (rows["_bucket"] == carry["_segment"]))
    value = F.col(metric)
    past = inside.rowsBetween(Window.unboundedPreceding, -1)
    best_before = F.greatest(F.max(value).over(past), F.col("_best.v"), F.lit(0.0))
    joined = joined.withColumns({"epoch": F.col("_skip") + F.col("_at"), "_before": best_before})
    joined = joined.withColumns({"improved": value > F.col("_before"), "best_so_far": F.greatest("_before", value)})
    last = F.greatest(F.max(F.when(F.col("improved"), F.col("epoch"))).over(inside), -F.col("_best.at"), F.lit(0))
    counted = joined.withColumn("since_best", F.col("epoch") - last)
    stop = counted.filter(F.col("since_best") >= patience).groupBy(F.col(run).alias("_of")).agg(F.min("epoch").alias("_stop"))
    kept = counted.join(stop, counted[run].eqNullSafe(stop["_of"]), "left")
    kept = kept.filter(F.col("_stop").isNull() | (F.col("epoch") <= F.col("_stop")))
    return kept.select(*log.columns, "epoch", "improved", "best_so_far", "since_best")


def best_epoch(log: DataFrame, *, run: str = "run", step: str = "step", metric: str = "value") -> DataFrame:
    """Each run's best row with all its metrics; of equal values the first. One map-side combined aggregate."""
    row = F.struct(*[F.col(c) for c in log.columns])
    best = F.max_by(row, F.struct(F.col(metric), -F.col(step)))
    return log.groupBy(F.col(run).alias("_run")).agg(best.alias("_best")).select("_best.*")


def seed_summary(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of every metric over the seeds of a run group."""
    parts = []
    for m in metrics:
        parts += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return df.groupBy(*by).agg(*parts)


def pivot_splits(df: DataFrame, run: str, split: str, splits: Sequence[str], metrics: Sequence[str], order: str) -> DataFrame:
    """One row per run with a column set per split, ordered by one of them."""
    wide = df.groupBy(run).pivot(split, list(splits)).agg(*[F.first(m).alias(m) for m in metrics])
    return wide.orderBy(order, run)


def column_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in columns])
