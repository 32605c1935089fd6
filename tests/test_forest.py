"""Steps on all rules of a batch at once: equal to the row-wise steps on random rules, and in proportion on large ones."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sparkrules.functions import forest, notation, tree
from sparkrules.operators import nodes, score

NAMES = [
    "if", "and", "or", " or", "not", "obligation", "expr", "expression", "rulestatement", "appliedstatement", "loop", "atom", " atom", "rel", "var",
    "fun", "function", "data", " data", "baseunit", "value", "is", "x.p", "a.B", "5 mm", "5.5 kg/m3", "7 m", "12 kN*m", "9 zz", "'q, (r)'", " ", "'x",
]
STATEMENTS = [
    "expression(function(is),atom(relation(status),variable(order)),data(or(a,b)))", "is(order.status,or(O,X))", "loop(forEach(part),has(part,order.line))",
    "expression(function(f),atom(a.b),data(50 mm))", "not(expr(function(is),atom(variable(o)),data(and(5 mm,7 kg/m3))))",
    "data(baseunit(kind(metre),prefix(milli),exponent(2.0)),value(5.0))",
    "data( derivedunit(baseunit(prefix(kilo),kind(gram)),operator(name(division)),baseunit(kind(metre))), value(7.5))",
]


def rules(seed):
    rng = random.Random(seed)

    def grown(depth, leaves):
        name = rng.choice(leaves)
        if depth == 0 or rng.random() < 0.25:
            return name
        inner = rng.choice(NAMES) if leaves is NAMES else rng.choice(["and", "or", "if", "then", "loop", "expr"])
        return f"{inner}({','.join(grown(depth - 1, leaves) for _ in range(rng.choice([1, 1, 2, 3])))})"

    def damaged(rule):
        at = rng.randrange(len(rule))
        return rule[:at] + rng.choice(["", "(", ")", ",", "'"]) + rule[at + 1 :]

    whole = [grown(rng.randint(1, 4), leaves) for leaves in (NAMES, STATEMENTS) for _ in range(80)]
    return [*whole, *map(damaged, whole), "", None, "((", ")", "atom(variable( ))"]


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "row_id int, rule string")


@pytest.mark.parametrize("step", sorted(forest.STEPS))
def test_equals_the_row_wise_step(spark, step):
    plain = lambda c: tree.render(notation.STEPS[step](tree.parse(c)))
    df = frame(spark, rules(step)).select("rule", plain(F.col("rule")).alias("plain"), forest.rewritten(F.col("rule"), [step]).alias("out"))
    rows = df.collect()
    assert [r.out for r in rows] == [r.plain for r in rows]


def test_steps_follow_one_another(spark):
    """One tree through several steps gives what a reading between them gives."""
    steps = ["loops_long", "expressions_long", "atoms_long", "values_long", "units_long"]
    df = frame(spark, [STATEMENTS[2], f"if({','.join(STATEMENTS[:3])}),then({STATEMENTS[4]})", "", None])
    one = df
    for step in steps:
        one = nodes.rewrite_rules(one, [step])
    whole = nodes.rewrite_rules(df, steps)
    assert [r.rule for r in whole.orderBy("row_id").collect()] == [r.rule for r in one.orderBy("row_id").collect()]


def test_large_rules_cost_in_proportion(spark):
    """A rule of 45,000 nodes; a step that looks at pairs of nodes takes many minutes."""
    one = "expression(function(is),atom(relation(p),variable(x)),data(5 mm))"
    df = frame(spark, [f"if({','.join([one] * 5000)})"])
    start = time.monotonic()
    out = nodes.rewrite_rules(df, ["atoms_short", "units_long"]).first()["rule"]
    assert out.count("atom(x.p)") == out.count("value(5.0)") == 5000
    assert time.monotonic() - start < 60


def test_scoring_of_large_rules_costs_in_proportion(spark):
    """A rule of 12,000 nodes against itself without its last statement."""
    statements = [f"r{i}(a{i},'{i}')" for i in range(4000)]
    df = spark.createDataFrame([(1, f"if({','.join(statements[:-1])})", f"if({','.join(statements)})")], "row_id int, pred string, ref string")
    start = time.monotonic()
    row = score.structure_score(df).first()
    assert row.precision == 1 and 0.99 < row.recall < 1
    assert score.rule_elements(df, "ref").count() == 4001 + 4000
    assert time.monotonic() - start < 60
