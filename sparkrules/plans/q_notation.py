"""Registered queries over the reversible notation steps and levels.

The rules are written from ``orders`` at any notation by one template, so the twin of a step is the template
after it: nothing of the step itself is repeated in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkrules.functions import fixed, notation
from sparkrules.operators import nodes
from sparkrules.plans.inputs import dealt, load

ORDER = ["loops", "expressions", "atoms", "values", "units"]  # from the shortest notation to the longest

# --- fixed values: the units of the rules, short and long ------------------------------------------
UNITS = {
    "mm": "baseunit(prefix(milli),kind(metre))",
    "kg": "baseunit(prefix(kilo),kind(gram))",
    "m2": "baseunit(exponent(2.0),kind(metre))",
    "kg/m3": "derivedunit(baseunit(prefix(kilo),kind(gram)),operator(name(division)),baseunit(exponent(3.0),kind(metre)))",
}


def rules_sql(short: list[str]) -> str:
    """``row_id, rule`` for every order, short in the named steps."""

    def said(function: str, subject: str, value: str | None = None) -> str:
        variable, _, relation = subject.partition(".")
        if "atoms" not in short:
            subject = f"relation({relation}),variable({variable})" if relation else f"variable({variable})"
        if "expressions" in short:
            return f"{function}({subject},{value})" if value else f"{function}({subject})"
        return f"expression(function({function}),atom({subject}){f',data({value})' if value else ''})"

    def either(connector: str, around: str, beside: str = "") -> str:
        """A status that is one of two values; ``around`` holds the statement at %."""
        status = lambda value: around.replace("%", said("is", "order.status", value))
        if "values" in short:
            one = status(f"{connector}(@status,X)")
            return f"{beside}({one},{said('has', 'order', 'part')})" if beside else one
        both = f"{status('@status')},{status('X')}"
        if beside == connector:
            return f"{beside}({both},{said('has', 'order', 'part')})"
        both = f"{connector}({both})"
        return f"{beside}({both},{said('has', 'order', 'part')})" if beside else both

    loop = [said("forEach", "part"), said("has", "part", "order.line")]
    loop = f"loop({loop[0]},{loop[1]})" if "loops" in short else f"expression(rulestatement({loop[0]}),appliedstatement({loop[1]}))"
    then = f"then(obligation({said('lessThan', 'order.total', '@quantity')}),{loop})"
    shapes = [either("or", "%"), either("or", "not(%)"), either("and", "%", "and"), either("or", "%", "and")]
    number = "CAST(CAST(floor(o_totalprice) AS BIGINT) % 997 AS STRING)"
    quantities = [f"concat({number}, ' {s}')" if "units" in short else f"concat('{long},value(', {number}, '.0)')" for s, long in UNITS.items()]
    rule = "CASE o_orderkey % 4 " + " ".join(f"WHEN {i} THEN 'if({s}),{then}'" for i, s in enumerate(shapes)) + " END"
    quantity = "CASE floor(o_orderkey / 4) % 4 " + " ".join(f"WHEN {i} THEN {q}" for i, q in enumerate(quantities)) + " END"
    return f"SELECT o_orderkey AS row_id, replace(replace({rule}, '@status', o_orderstatus), '@quantity', {quantity}) AS rule FROM {{orders}}"


def _rules(spark, sf, short):
    return dealt(spark.sql(rules_sql(short), orders=load(spark, sf, "orders")))


def _step(name: str, way: str):
    at = ORDER.index(name)
    longer, shorter = ORDER[at + 1 :], ORDER[at:]
    source, target = (shorter, longer) if way == "long" else (longer, shorter)

    def query(spark, sf):
        return nodes.rewrite_rules(_rules(spark, sf, source), [f"{name}_{way}"]).select("row_id", "rule")

    return query, rules_sql(target).format(orders="orders")


def _level(name: str):
    def query(spark, sf):
        return nodes.at_level(_rules(spark, sf, ORDER), name).select("row_id", F.col("rule"))

    return query, rules_sql(fixed.NOTATION_LEVELS[name]).format(orders="orders")


QUERIES = {
    **{f"{name}_{way}": _step(name, way) for name in ORDER for way in ("long", "short")},
    **{f"level_{name}": _level(name) for name in notation.LEVELS},
}
