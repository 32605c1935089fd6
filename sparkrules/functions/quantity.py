"""Quantities such as ``12.5 mm`` or ``3 kg/m3`` as structs, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkrules.functions import fixed

_KINDS = "|".join(abbr for _, abbr in reversed(fixed.UNIT_KINDS))
_PREFIXES = "|".join(abbr for _, abbr in fixed.UNIT_PREFIXES)
# A lazy prefix: a lone 'm' is the metre, not milli. One digit of exponent.
BASE_UNIT = rf"^({_PREFIXES})??({_KINDS})?([0-9])?$"
QUANTITY = r"^([0-9]+\.?[0-9]*)\s([a-zA-Z0-9/*+-]+)$"


def _map(pairs: list[tuple[str, str]], flip: bool = False) -> Column:
    flat = [F.lit(x) for a, b in pairs for x in ((b, a) if flip else (a, b))]
    return F.create_map(*flat)


def lookup(pairs: list[tuple[str, str]], key: Column, flip: bool = False) -> Column:
    """Map lookup; empty and unknown keys give null."""
    return F.try_element_at(_map(pairs, flip), key)


def parse_base_unit(unit: Column) -> Column:
    """struct(prefix, kind, exponent), or null when the text is no base unit."""
    part = lambda i: F.regexp_extract(unit, BASE_UNIT, i)
    exponent = F.when(part(3) != "", F.concat(part(3), F.lit(".0")))
    found = F.struct(
        lookup(fixed.UNIT_PREFIXES, part(1), flip=True).alias("prefix"),
        lookup(fixed.UNIT_KINDS, part(2), flip=True).alias("kind"),
        exponent.alias("exponent"),
    )
    return F.when((unit != "") & unit.rlike(BASE_UNIT), found)


def parse_quantity(c: str | Column) -> Column:
    """struct(value, first, operator, second), or null when the text is no quantity.

    The first operator sign (in table order) that cuts the unit in exactly two decides; if a half
    is no base unit the whole unit is tried as one.
    """
    text = F.col(c) if isinstance(c, str) else c
    number, unit = F.regexp_extract(text, QUANTITY, 1), F.regexp_extract(text, QUANTITY, 2)
    value = F.when(number.contains("."), number).otherwise(F.concat(number, F.lit(".0")))
    sign = F.coalesce(
        *[
            F.when(F.length(unit) - F.length(F.replace(unit, F.lit(s), F.lit(""))) == 1, F.lit(s))
            for _, s in fixed.UNIT_OPERATORS
        ]
    )
    left = parse_base_unit(F.split_part(unit, sign, F.lit(1)))
    right = parse_base_unit(F.split_part(unit, sign, F.lit(2)))
    derived = sign.isNotNull() & left.isNotNull() & right.isNotNull()
    whole = parse_base_unit(unit)
    found = F.struct(
        value.alias("value"),
        F.when(derived, left).otherwise(whole).alias("first"),
        F.when(derived, lookup(fixed.UNIT_OPERATORS, sign, flip=True)).alias("operator"),
        F.when(derived, right).alias("second"),
    )
    return F.when((unit != "") & (derived | whole.isNotNull()), found)


def trim_decimal(number: Column) -> Column:
    return F.when(number.endswith(".0"), F.substr(number, F.lit(1), F.length(number) - 2)).otherwise(number)


def format_base_unit(unit: Column) -> Column:
    blank = F.lit("")
    return F.concat(
        F.coalesce(lookup(fixed.UNIT_PREFIXES, unit["prefix"]), blank),
        F.coalesce(lookup(fixed.UNIT_KINDS, unit["kind"]), blank),
        F.coalesce(trim_decimal(unit["exponent"]), blank),
    )


def format_quantity(quantity: Column) -> Column:
    """The text of a quantity struct: ``12.5 mm``, ``3 kg/m3``."""
    tail = F.when(
        quantity["operator"].isNotNull(),
        F.concat(lookup(fixed.UNIT_OPERATORS, quantity["operator"]), format_base_unit(quantity["second"])),
    ).otherwise(F.lit(""))
    return F.concat(trim_decimal(quantity["value"]), F.lit(" "), format_base_unit(quantity["first"]), tail)
