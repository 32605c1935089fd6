"""Readings of all rules of a batch at once: equal to the row-wise ones on odd rules, and in proportion on large ones."""

import time

import pytest
from pyspark.sql import functions as F
from test_forest import frame, rules
from test_forest_steps import ODD

from sparkrules.functions import readings, tree
from sparkrules.operators import nodes


def _row_wise_node(linked):
    def one(n):
        siblings = tree.children(linked, n["parent_id"])
        names = F.transform(F.concat(n["ancestors"], F.array(n["node_id"])), lambda a: F.get(linked, a)["name"])
        return F.struct(
            *[n[c].alias(c) for c in ("node_id", "parent_id", "depth", "name")],
            tree.is_leaf(linked, n).alias("is_leaf"),
            F.size(tree.children(linked, n["node_id"])).alias("n_children"),
            F.size(F.filter(siblings, lambda s: s["node_id"] < n["node_id"])).alias("sibling"),
            F.concat(F.lit("/"), F.array_join(names, "/")).alias("path"),
        )

    return F.transform(linked, one)


def _row_wise_pairs(midword):
    def pairs(linked):
        whole = F.struct(F.lit(0).alias("pick"), F.lit(-1).alias("node_id"), F.lit("").alias("given"), tree.render(linked).alias("wanted"))
        picks = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda p: tree.completion(linked, F.col("row_id"), p, 7, midword))
        return F.concat(F.array(whole), F.when(F.size(linked) > 0, picks).otherwise(F.slice(picks, 1, 0)))

    return lambda rule: tree.let(tree.parse(rule), pairs)


def _of_tree(read):
    return lambda rule: tree.let(tree.parse(rule), read)


CASES = {
    "node_facts": (readings.node_facts, _of_tree(_row_wise_node)),
    "facts": (readings.facts, _of_tree(tree.facts)),
    "entities": (readings.entities, _of_tree(tree.entities)),
    "expressions": (readings.expressions, lambda rule: tree.let(tree.parse(tree.spaced_notation(rule)), tree.expressions)),
    "completions": (lambda rule: readings.completions(rule, F.col("row_id"), 3, 7, False), _row_wise_pairs(False)),
    "completions_midword": (lambda rule: readings.completions(rule, F.col("row_id"), 3, 7, True), _row_wise_pairs(True)),
}


@pytest.mark.parametrize("name", CASES)
def test_equals_the_row_wise_reading(spark, name):
    read, plain = CASES[name]
    df = frame(spark, [*rules(name), *ODD])
    rows = df.select("rule", plain(F.col("rule")).alias("plain"), read(F.col("rule")).alias("out")).collect()
    none = [] if name in ("node_facts", "facts") else None  # an exploded null and an exploded empty list are alike
    assert [(r.rule, r.out) for r in rows] == [(r.rule, none if r.plain is None else r.plain) for r in rows]


def test_large_rules_cost_in_proportion(spark):
    """A rule of 25,000 nodes; a reading that looks at pairs of nodes takes many minutes."""
    df = frame(spark, [f"if(and({','.join(f'is(order.status,or(O,x{i}))' for i in range(5000))})),then(x)"])
    start = time.monotonic()
    assert nodes.node_facts(df).agg(F.sum("sibling"), F.count("path")).first() == (5000 * 4999 // 2 + 5000 * 2 + 1, 25004)
    assert nodes.expand_alternatives(nodes.predicate_facts(df)).count() == 10000
    assert nodes.factor_alternatives(nodes.predicate_facts(df)).first()["connector"] == "and"
    assert nodes.rule_expressions(df).first()["expressions"].count("is(") == 5000
    assert nodes.rule_entities(df).first()["entities"] == "order, status, o, x"
    assert nodes.completion_pairs(df, 2, 7, midword=True).count() == 3
    assert time.monotonic() - start < 60
