"""Rule corpora as node, fact and issue tables.

Work inside one rule stays inside its row (see ``functions.tree``); only work on the exploded tables
of many rules groups or shuffles, always by ``row_id``.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrules.functions import forest, notation, readings, tree


def with_tree(df: DataFrame, rule: str = "rule", name: str = "tree") -> DataFrame:
    """Add the linked tree of a rule column."""
    return df.withColumn(name, tree.parse(F.col(rule)))


def node_table(df: DataFrame, rule: str = "rule", key: str = "row_id") -> DataFrame:
    """One row per node: (row, node_id, parent_id, depth, name, is_term, ancestors)."""
    return df.select(key, F.inline(tree.parse(F.col(rule))))


def render_rules(nodes: DataFrame, key: str = "row_id") -> DataFrame:
    """Node table back to rule strings; a row's nodes are collected together, which one rule bounds."""
    ordered = F.array_sort(F.collect_list(F.struct("node_id", "depth", "name")))
    return nodes.groupBy(key).agg(tree.render(ordered).alias("rule"))


def node_facts(df: DataFrame, rule: str = "rule", key: str = "row_id") -> DataFrame:
    """Node table with is_leaf, number of children, rank among siblings (from 0) and path of names."""
    return df.select(key, F.inline(readings.node_facts(F.col(rule))))


def predicate_facts(df: DataFrame, rule: str = "rule", key: str = "row_id") -> DataFrame:
    """One row per relation node: relation, subject, property, object, connector and values."""
    return df.select(key, F.inline(readings.facts(F.col(rule))))


def expand_alternatives(facts: DataFrame) -> DataFrame:
    """One row per alternative of a fact; facts with a single value or none stay one row."""
    return facts.select(
        *[c for c in facts.columns if c not in ("object", "values")],
        F.posexplode_outer("values").alias("alternative", "object"),
    )


def factor_alternatives(facts: DataFrame, key: str = "row_id") -> DataFrame:
    """Neighbouring facts under one connector that differ only in the value become one fact.

    Islands: a fact starts a new one unless the fact before it is its left sibling and has the same
    relation, subject and property. All steps share one partitioning by row.
    """
    same = F.struct("parent_id", "relation", "subject", "property")
    window = Window.partitionBy(key).orderBy("node_id")
    previous = F.lag(F.struct(same.alias("sig"), "sibling")).over(window)
    continues = (
        F.col("parent").isin("and", "or")
        & previous["sig"].eqNullSafe(same)
        & (previous["sibling"] + 1 == F.col("sibling"))
        & F.col("object").isNotNull()
    )
    starts = F.when(F.coalesce(continues, F.lit(False)), 0).otherwise(1)
    islands = facts.withColumn("_starts", starts).withColumn("_island", F.sum("_starts").over(window))
    members = F.array_sort(F.collect_list(F.struct("node_id", "object")))
    return (
        islands.groupBy(key, "_island")
        .agg(
            F.min("node_id").alias("node_id"),
            *[F.first(c).alias(c) for c in ("parent", "relation", "subject", "property")],
            F.array_compact(F.transform(members, lambda m: m["object"])).alias("values"),
        )
        .withColumn("connector", F.when(F.size("values") > 1, F.col("parent")))
        .drop("_island")
    )


def _applied(rule: Column, step: Callable[[Column], Column]) -> Column:
    return tree.let(rule, lambda r: step(r))


def rewrite_rules(
    df: DataFrame, steps: Sequence[str | Callable[[Column], Column]], rule: str = "rule", out: str | None = None
) -> DataFrame:
    """Rewrite a rule column by an ordered list of step names or Column functions of rule strings, one projection per step.

    Steps on trees (those of ``forest``) take all rules of an Arrow batch at once and follow one another on one tree: a rule is parsed
    once ahead of them and rendered once after them, and only a step on texts in between asks for another reading.
    """
    out = out or rule
    df = df.withColumn(out, F.col(rule))

    def kind(step: str | Callable[[Column], Column]) -> str:
        return "forest" if isinstance(step, str) and step in {**forest.STEPS, **forest.RULE_STEPS} else "text"

    for of, run in itertools.groupby(steps, kind):
        if of == "forest":
            df = df.withColumn(out, forest.rewritten(F.col(out), list(run)))
        else:
            for step in run:
                df = df.withColumn(out, _applied(F.col(out), tree.TEXT_STEPS[step] if isinstance(step, str) else step))
    return df


def at_level(df: DataFrame, level: str, rule: str = "rule", out: str | None = None) -> DataFrame:
    """Rules of the shortest notation at a named notation level."""
    return rewrite_rules(df, notation.LEVELS[level], rule, out)


def rule_entities(df: DataFrame, rule: str = "rule", out: str = "entities") -> DataFrame:
    return df.withColumn(out, readings.entities(F.col(rule)))


def rule_expressions(df: DataFrame, rule: str = "rule", out: str = "expressions") -> DataFrame:
    return df.withColumn(out, readings.expressions(F.col(rule)))


def completion_pairs(
    df: DataFrame, k: int, seed: int, *, midword: bool = False, rule: str = "rule", key: str = "row_id"
) -> DataFrame:
    """``k`` seeded (given, wanted) pairs per rule, and the whole rule as pick 0."""
    return df.select(key, F.inline(readings.completions(F.col(rule), F.col(key), k, seed, midword)))


def rule_lint(df: DataFrame, rule: str = "rule", key: str = "row_id") -> DataFrame:
    """One row per structural issue of a rule."""
    issues = tree.let(tree.parse(F.col(rule)), lambda linked: tree.lint(F.col(rule), linked))
    return df.select(key, F.explode(issues).alias("issue"))
