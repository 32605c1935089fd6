"""Steps within a notation and readings on all rules of a batch: equal to the row-wise ones on odd rules, and in proportion on large ones."""

import random
import time

import pytest
from pyspark.sql import functions as F
from test_forest import frame, rules

from sparkrules.functions import forest, notation, tree
from sparkrules.operators import nodes

ODD = [
    "if(and(and(x,y),or(or(z)))),then(obligation(a),obligation(a),obligation(b))", "if(and(is(a.type,bigA),then(obligation(f(x)))))", "then(a)", "if(then(a),then(b))",
    "if(define(x.k,openOrder),define(lateOrder,_new),is(openOrder.type,lateOpenOrder),has(lateOrder_1,openOrder))", "define(a.b, name\n),is( name, 'a name')",
    "if(or(obligation(a,b),obligation(b,a),obligation(a,b)),obligation(obligation(c),obligation(c)))", "obligation(a),obligation(a),obligation",
    "expr(expr(a)),expression(expression(b),c),expression(b),expression(b)", "f(50.0 mm,3.0 kg/m3, 5.0 mm,12.50 kN*m,7. m,5.0 zz,m2,9.0 m2\n)", "is( Wall.type,bigWALL),is(a_b.type,xa_b)",
    " someName( 'Kept Case_x',camelCase.partTwo,x1.y,x22) ", "fun(var,rel( a)),expr ", " \t", "a,\t", " (b)", "is(order.status,or(O,X,f(Y))),has(order),not(is(x.y.z)),is( and,or( a ))",
    "and(not(or(expr(data(a)))),not(or(expr(data(b)))),not(or(expr(data(c)))))", "or(expr(a,data(x)),expr(a,data(y)),expr(b,data(z))),data(or(expr(data(p)),expr(data(q))))",
    " and( expr( f, data( x)), expr( f, data( y)))", "if(and(or(expr(data(x)),expr(data(y))),not(data(1)),not(data(2)),expr(data(1,2)),expr(data(f(3)))))",
]


@pytest.mark.parametrize("step", [*sorted(forest.RULE_STEPS), "values_short"])
def test_equals_the_row_wise_step(spark, step):
    row_wise = {**tree.TREE_STEPS, **notation.STEPS}
    plain = tree.spaced_notation if step == "spaced_notation" else lambda c: tree.render(row_wise[step](tree.parse(c)))
    df = frame(spark, [*rules(step), *ODD]).select("rule", plain(F.col("rule")).alias("plain"), forest.rewritten(F.col("rule"), [step]).alias("out"))
    rows = df.collect()
    assert [(r.rule, r.out) for r in rows] == [(r.rule, r.plain) for r in rows]
    assert any(r.out != r.rule for r in rows if r.rule)


def test_steps_follow_one_another(spark):
    """One tree through several steps gives what a reading between them gives."""
    rng = random.Random(5)
    for _ in range(4):
        steps = rng.sample([*forest.RULE_STEPS, "values_short"], 5)
        one = df = frame(spark, [*rules(steps[0])[:40], *ODD])
        for step in steps:
            one = nodes.rewrite_rules(one, [step])
        whole = nodes.rewrite_rules(df, steps)
        assert [r.rule for r in whole.orderBy("row_id").collect()] == [r.rule for r in one.orderBy("row_id").collect()], steps


def test_large_rules_cost_in_proportion(spark):
    """A rule of 30,000 nodes; a step that looks at pairs of nodes takes many minutes."""
    many = ",".join(f"obligation(lessThan(order.total,{i} mm))" for i in range(5000))
    values = ",".join(f"expr(is,data({i}))" for i in range(5000))
    df = frame(spark, [f"if(and(and(a)),and({many},{many})),then(x)", f"if(or({values}))"])
    start = time.monotonic()
    out = nodes.rewrite_rules(df, ["repair_then", "collapse_nested", "drop_duplicate_obligations", "values_short", "spaced_notation"])
    one, two = [r.rule for r in out.orderBy("row_id").collect()]
    assert one.count("obligation(") == 5000 and two.count("data(") == 1 and two.count(",") == 5000
    assert time.monotonic() - start < 60
