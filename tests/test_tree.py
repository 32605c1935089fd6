"""Trees: hand-worked rules, a plain stack walk on random strings, round trips."""

import random

import pytest
from pyspark.sql import functions as F

from sparkrules.functions import tree
from sparkrules.operators import nodes


def frame(spark, rules):
    return spark.createDataFrame(list(enumerate(rules)), "row_id int, rule string")


def walk(rule):
    """A character walk with an explicit stack, as (name, parent)."""
    found, parents, word, quoted, current, latest = [], [], "", False, [], None

    def close():
        nonlocal word, latest
        if word:
            found.append(word)
            parents.append(current[-1] if current else -1)
            latest = [*current, len(found) - 1]
            word = ""

    for c in rule:
        if c == "'":
            quoted = not quoted
            word += c
        elif quoted or c not in "(),":
            word += c
        else:
            close()
            if c == "(" and latest is not None:
                current = list(latest)
            elif c == ")" and current:
                current = current[:-1]
    if not current:
        close()
    return list(zip(found, parents))


def parsed(spark, rules):
    rows = nodes.node_table(frame(spark, rules)).orderBy("row_id", "node_id").collect()
    out = [[] for _ in rules]
    for r in rows:
        out[r.row_id].append((r.name, r.parent_id))
    return out


def test_hand_worked(spark):
    rules = ["if(a)),then(b)", "a(b,c", "is(x,'a, (b)')", "", "f()"]
    expected = [
        [("if", -1), ("a", 0), ("then", -1), ("b", 2)],
        [("a", -1), ("b", 0)],
        [("is", -1), ("x", 0), ("'a, (b)'", 0)],
        [],
        [("f", -1)],
    ]
    assert parsed(spark, rules) == expected


def test_random_strings_equal_a_stack_walk(spark):
    rng = random.Random(1)
    pieces = ["a", "bc", "(", ")", ",", "((", "))", "'x,(y'", "'", " ", "then(", "),"]
    rules = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    assert parsed(spark, rules) == [walk(r) for r in rules]


def test_render_round_trip(spark):
    rules = ["if(and(is(a.b,1),has(c,d))),then(obligation(x(y,'50, (mm)')))", "a", "a,b(c),d", ""]
    back = frame(spark, rules).select("rule", tree.render(tree.parse(F.col("rule"))).alias("back")).collect()
    assert all(r.rule == r.back for r in back)


@pytest.mark.parametrize(
    ("step", "given", "expected"),
    [
        ("collapse_nested", "and(and(a,and(b)),or(c))", "and(a,b,or(c))"),
        ("collapse_nested", "expr(expr(a,b))", "expr(a,b)"),
        ("collapse_nested", "expr(expr(a),b)", "expr(expr(a),b)"),
        ("repair_then", "if(a,then(b,c),d)", "if(a,d),then(b,c)"),
        ("repair_then", "if(a),then(b)", "if(a),then(b)"),
        ("drop_duplicate_obligations", "then(obligation(a(b)),obligation(a(c)),obligation(a(b)))", "then(obligation(a(b)),obligation(a(c)))"),
        ("dedupe_type_word", "is(pipe.type,wastePipe)", "is(pipe.type,waste)"),
        ("dedupe_type_word", "is(pipe.type,pipe)", "is(pipe.type,pipe)"),
        ("canonical_vars", "and(define(a.kind,top),has(top.end,topmost),define(low,_new),is(low,top))",
         "and(define(a.kind,x0),has(x0.end,topmost),define(x1,_new),is(x1,x0))"),
        ("spaced_notation", "if(expr(isFit(wallTie,x_y)))", "if( expression( is fit( wall tie, x y)))"),
        ("tidy_quantities", "lessThan(a,50.0 mm)", "lessThan(a,50 mm)"),
    ],
)
def test_rewrites(spark, step, given, expected):
    assert nodes.rewrite_rules(frame(spark, [given]), [step]).first().rule == expected


def test_own_steps(spark):
    out = nodes.rewrite_rules(frame(spark, ["if(a)"]), ["clean", F.upper]).first().rule
    assert out == "IF(A)"


def test_alternatives_expand_and_factor(spark):
    df = frame(spark, ["and(is(a.b,1),is(a.b,2),is(c,or(x,y)),is(a.b,3))"])
    facts = nodes.predicate_facts(df)
    expanded = nodes.expand_alternatives(facts).orderBy("node_id", "alternative").collect()
    assert [(r.subject, r.property, r.object, r.connector) for r in expanded] == [
        ("a", "b", "1", None), ("a", "b", "2", None), ("c", None, "x", "or"), ("c", None, "y", "or"), ("a", "b", "3", None)
    ]
    factored = nodes.factor_alternatives(facts).orderBy("node_id").collect()
    assert [(r.subject, r["values"], r.connector) for r in factored] == [
        ("a", ["1", "2"], "and"), ("c", ["or(x,y)"], None), ("a", ["3"], None)
    ]


def test_completion_covers_the_rule(spark):
    rules = ["if(and(is(a,b),has(c,d))),then(obligation(x(y,z)))"] * 30
    pairs = nodes.completion_pairs(frame(spark, rules), 3, 1).filter("pick > 0").collect()
    assert len(pairs) == 90
    assert all(rules[0].startswith(p.given + p.wanted.split("(")[0]) for p in pairs)
    cut = nodes.completion_pairs(frame(spark, rules), 3, 1, midword=True).filter("pick > 0").collect()
    assert all(rules[0].startswith(p.given) for p in cut)


def test_lint(spark):
    rules = ["if(is(a,b)),then(obligation(c(d)))", "", "if(a", "if(expr(fun(x),fun(y))),then(b(c,3 apples))"]
    found = {(r.row_id, r.issue) for r in nodes.rule_lint(frame(spark, rules)).collect()}
    assert found == {
        (1, "empty rule"), (1, "missing then"), (2, "unbalanced brackets"), (2, "missing then"),
        (3, "expression without one function"), (3, "unknown unit"),
    }


LONG = "if(or(expression(function(is),atom(relation(status),variable(order)),data(O)),expression(function(is),atom(variable(order)),data(F))))"
NOTATIONS = {
    "atoms": ("is(x,atom(relation(p),variable(x)),atom(variable(y)))", "is(x,atom(x.p),atom(y))"),
    "units": (
        "data(baseunit(prefix(milli),kind(metre)),value(5.5)),data(derivedunit(baseunit(prefix(kilo),kind(gram)),operator(name(division)),"
        "baseunit(exponent(3.0),kind(metre))),value(7.0))",
        "data(5.5 mm),data(7 kg/m3)",
    ),
    "loops": ("then(expression(rulestatement(forEach(a)),appliedstatement(has(b))))", "then(loop(forEach(a),has(b)))"),
    "expressions": (
        "if(not(expression(function(is),expression(function(sum),atom(a)),data(or(b,c))))),then(expression(function(has),atom(d),data(e)))",
        "if(not(is(sum(a),or(b,c)))),then(has(d,e))",
    ),
    "values": (
        "if(and(expr(function(is),atom(a),data(b)),expr(function(is),atom(a),data(c)),expr(function(is),atom(z),data(c))))",
        "if(and(expr(function(is),atom(a),data(and(b,c))),expr(function(is),atom(z),data(c))))",
    ),
}


@pytest.mark.parametrize("step", sorted(NOTATIONS))
def test_notation_steps_go_both_ways(spark, step):
    long, short = NOTATIONS[step]
    out = lambda rule, way: nodes.rewrite_rules(frame(spark, [rule]), [f"{step}_{way}"]).first()["rule"]
    assert out(long, "short") == short
    assert out(short, "long") == long
    assert out(short, "short") == short
    others = frame(spark, ["", "if(", "plain", "is(a)", "then(or(a,b))"])
    once = nodes.rewrite_rules(others, [f"{step}_short"])
    assert [r.rule for r in once.collect()] == [r.rule for r in nodes.rewrite_rules(once, [f"{step}_short"]).collect()]


def test_values_keep_what_differs_elsewhere(spark):
    assert nodes.rewrite_rules(frame(spark, [LONG]), ["values_short"]).first()["rule"] == LONG
