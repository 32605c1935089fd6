"""Registered queries over run logs and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkrules.functions import names
from sparkrules.operators import runs
from sparkrules.operators.curate import stack
from sparkrules.plans.inputs import load, with_inputs

METRICS = ["test_bleu", "test_f1", "runtime"]


def _rounded(df):
    return df.select(*[F.round(f"`{c}`", 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def early_stop(spark, sf):
    log = load(spark, sf, "metric_log").select("run", "step", "value")
    stopped = [runs.early_stop(log, p).withColumn("patience", F.lit(p)) for p in (3, 20)]
    return stack(stopped)


EARLY_STOP_SQL = with_inputs(
    """, a AS (SELECT run, step, value, row_number() OVER w AS epoch, greatest(coalesce(max(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS best
      FROM metric_log WINDOW w AS (PARTITION BY run ORDER BY step)),
    b AS (SELECT *, value > best AS improved, greatest(best, value) AS best_so_far FROM a),
    c AS (SELECT *, epoch - coalesce(max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run ORDER BY step), 0) AS since_best FROM b),
    d AS (SELECT c.*, patience, min(CASE WHEN since_best >= patience THEN epoch END) OVER (PARTITION BY run, patience) AS stop FROM c, (SELECT unnest([3, 20])::INTEGER AS patience))
    SELECT run, step, value, epoch, improved, best_so_far, since_best, patience FROM d WHERE stop IS NULL OR epoch <= stop""",
    "metric_log",
)


def best_epoch(spark, sf):
    return runs.best_epoch(load(spark, sf, "metric_log"))


def _grouped(spark, sf):
    results = load(spark, sf, "run_results")
    group = names.drop_parts("name", 3)
    return results.select(
        names.drop_parts(group, 2).alias("run"), names.part_from_end(group, 2).alias("split"),
        names.run_family("name").cast("double").alias("exp_num"), *METRICS,
    )


def seed_summary(spark, sf):
    return _rounded(runs.seed_summary(_grouped(spark, sf), ["run", "split"], METRICS))


GROUPED = """g AS (SELECT array_to_string(p[1:-6], '_') AS run, p[-5] AS split,
    CASE WHEN contains(name, 'no-clause') THEN 1.0::DOUBLE WHEN contains(name, 'calc-loss') THEN 2 ELSE 0 END AS exp_num, test_bleu, test_f1, runtime
    FROM (SELECT *, string_split(name, '_') AS p FROM run_results))"""


def pivot_splits(spark, sf):
    summary = runs.seed_summary(_grouped(spark, sf), ["run", "split"], [*METRICS, "exp_num"])
    wide = runs.pivot_splits(summary, "run", "split", ["doc", "random"], [f"{m}_mean" for m in [*METRICS, "exp_num"]], "doc_exp_num_mean")
    return _rounded(wide)


def column_means(spark, sf):
    lineitem = load(spark, sf, "lineitem")
    columns = [c for c, t in lineitem.dtypes if t == "double"]
    return _rounded(runs.column_means(lineitem, columns))


QUERIES = {
    "early_stop": (early_stop, EARLY_STOP_SQL),
    "best_epoch": (
        best_epoch,
        with_inputs(
            "SELECT run, step, value, event_type FROM metric_log QUALIFY row_number() OVER (PARTITION BY run ORDER BY value DESC, step) = 1",
            "metric_log",
        ),
    ),
    "seed_summary": (
        seed_summary,
        with_inputs(
            f", {GROUPED} SELECT run, split, "
            + ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std" for m in METRICS)
            + " FROM g GROUP BY run, split",
            "run_results",
        ),
    ),
    "pivot_splits": (
        pivot_splits,
        with_inputs(
            f", {GROUPED} SELECT run, "
            + ", ".join(
                f"round(avg({m}) FILTER (WHERE split = '{s}'), 6) AS {s}_{m}_mean" for s in ("doc", "random") for m in [*METRICS, "exp_num"]
            )
            + " FROM g GROUP BY run",
            "run_results",
        ),
    ),
    "column_means": (
        column_means,
        """SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice,
        round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem""",
    ),
}
