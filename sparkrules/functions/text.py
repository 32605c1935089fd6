"""Row-wise text functions: Column in, Column out. All native, so also usable on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkrules.functions import fixed
from sparkrules.operators.ranking import hash_fraction, seed_hash


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Trim blanks, tabs and line ends."""
    return F.trim(_col(c), F.lit(fixed.WHITESPACE))


def words(c: str | Column) -> Column:
    """Whitespace tokens; an empty text has none."""
    return F.filter(F.split(strip(c), r"\s+"), lambda w: w != "")


def fold_replace(c: str | Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other, so later pairs see earlier results."""
    out = _col(c)
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def doc_code(c: str | Column) -> Column:
    """Second ``-`` part, up to ``#``: ``a/XX-B1#3`` gives ``B1``."""
    return F.split_part(F.split_part(_col(c), F.lit("-"), F.lit(2)), F.lit("#"), F.lit(1))


def doc_title(c: str | Column, path_prefix: str) -> Column:
    """Lower-cased document code after a path prefix, up to ``#``."""
    return F.split_part(F.lower(F.replace(_col(c), F.lit(path_prefix), F.lit(""))), F.lit("#"), F.lit(1))


def build_input(prefix: str, text: str | Column, code: str | Column | None = None) -> Column:
    """Task prefix, optional document code and the clause text."""
    parts = [F.lit(prefix)]
    if code is not None:
        parts += [_col(code), F.lit(" ")]
    return F.concat(*parts, _col(text))


def fallback(new: str | Column, old: str | Column) -> Column:
    return F.coalesce(_col(new), _col(old))


def normalise_text(c: str | Column) -> Column:
    """Trim and end with a full stop; an empty text stays empty."""
    trimmed = strip(c)
    return F.when((trimmed == "") | trimmed.endswith("."), trimmed).otherwise(F.concat(trimmed, F.lit(".")))


def apply_replacements(c: str | Column, pairs: Sequence[tuple[str, str]] = tuple(fixed.REPLACEMENTS)) -> Column:
    return fold_replace(c, pairs)


def rename_terms(c: str | Column, reverse: bool = False) -> Column:
    """Schema terms from short to long, or back."""
    if reverse:
        return fold_replace(c, [(long, short) for short, long in fixed.SCHEMA_TERMS_BACK])
    return fold_replace(c, fixed.SCHEMA_TERMS)


def space_terms(c: str | Column) -> Column:
    """Rule notation for a tokeniser: camel case to spaced lower case, spaced brackets and commas."""
    split = F.lower(F.regexp_replace(_col(c), r"(?<=[a-z0-9])(?=[A-Z%])", "_"))
    opened = fold_replace(split, [("_", " "), ("(", "( "), (",", ", ")])
    return F.replace(F.regexp_replace(opened, " +", " "), F.lit(" ,"), F.lit(","))


def split_leaf(c: str | Column) -> Column:
    """A leaf name as words: camel case, underscores and dotted names; spaced names keep their case."""
    name = _col(c)
    camel = F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", " "))
    dotted = F.regexp_replace(F.replace(camel, F.lit("_"), F.lit(" ")), r"(?<=[a-z])\.(?=[a-z])", ". ")
    return F.when(name.contains(" "), F.replace(name, F.lit("_"), F.lit(" "))).otherwise(dotted)


def split_inner(c: str | Column) -> Column:
    """An inner node name as words: camel case only, lower-cased."""
    return F.lower(F.regexp_replace(_col(c), r"(?<=[a-z0-9])(?=[A-Z])", " "))


def score_words(c: str | Column) -> Column:
    """Words for scoring: camel case, digit-letter and dotted names split, ``kN`` kept whole."""
    one_blank = lambda s: F.replace(s, F.lit("  "), F.lit(" "))
    marked = fold_replace(c, [("_", " _ "), (",", " , ")])
    camel = one_blank(F.lower(F.regexp_replace(marked, r"(?<=[a-z0-9])(?=[A-Z%])", " ")))
    digits = one_blank(F.regexp_replace(camel, r"(?<=[0-9])(?=[a-z])", " "))
    units = F.replace(digits, F.lit(" k n "), F.lit(" kn "))
    dots = F.regexp_replace(units, r"(?<=[a-z])\.(?=[a-z])", " ")
    return F.split(F.replace(dots, F.lit(" _ "), F.lit(" ")), " ")


def bare_references(rule: str | Column) -> Column:
    """References in brackets without a document: ``(t1..)``, ``(f2..)`` and ``(1.2.3..)``."""
    named = F.regexp_extract_all(_col(rule), F.lit(r"\(([tf]\d.*?)\)"), F.lit(1))
    numbered = F.regexp_extract_all(_col(rule), F.lit(r"\((\d+\.\d+\..*?)\)"), F.lit(1))
    return F.concat(named, numbered)


def qualify_refs(rule: str | Column, title: str | Column) -> Column:
    """Put the title before every bare reference, unless the rule defines keys or the first reference."""
    rule, title = _col(rule), _col(title)
    refs = bare_references(rule)
    defined = F.regexp_extract_all(rule, F.lit(r"fun\(define\),.*?,data\((\w+)\)"), F.lit(1))
    exempt = rule.contains("rel(key)") | F.array_contains(defined, F.coalesce(F.get(refs, F.lit(0)), F.lit("")))

    def one(acc: Column, ref: Column) -> Column:
        return F.replace(acc, F.concat(F.lit("("), ref, F.lit(")")), F.concat(F.lit("("), title, ref, F.lit(")")))

    return F.when(exempt | (F.size(refs) == 0), rule).otherwise(F.aggregate(F.array_distinct(refs), rule, one))


def strip_refs(rule: str | Column, title: str | Column) -> Column:
    return F.replace(_col(rule), _col(title), F.lit(""))


def clean_prediction(c: str | Column, cut: bool = True) -> Column:
    """Trim, optionally drop what precedes the first ``if(``, and unify brackets.

    A prediction without ``if(`` is kept whole.
    """
    out = strip(c)
    if cut:
        at = F.instr(out, "if(")
        out = F.when(at > 0, out.substr(at, F.length(out))).otherwise(out)
    return F.replace(F.translate(out, "[]{}", "()()"), F.lit(")."), F.lit(")"))


def answer_after(c: str | Column, marker: str = fixed.TARGET_MARK) -> Column:
    """The text after the first marker (up to a second one); without a marker, the whole text."""
    text = _col(c)
    return F.when(text.contains(marker), strip(F.split_part(text, F.lit(marker), F.lit(2)))).otherwise(text)


def option_number(c: str | Column, default: int = 0) -> Column:
    found = F.regexp_extract(_col(c), r"Option (\d+)", 1)
    return F.coalesce(F.when(found != "", found.try_cast("bigint")), F.lit(default).cast("bigint"))


def truncate_tokens(c: str | Column, n: int) -> Column:
    return F.slice(words(c), 1, n)


def second_pass_input(
    first_input: str | Column,
    first_output: str | Column,
    old_prefix: str,
    new_prefix: str,
    *,
    keep_input: bool = True,
    keep_output: bool = True,
) -> Column:
    """Input of a repair pass: new prefix, first input up to the separator, first output."""
    body = F.substring_index(_col(first_input), fixed.SEPARATOR, 1)
    body = F.when(body.startswith(old_prefix), F.substr(body, F.lit(len(old_prefix) + 1))).otherwise(body)
    parts = [F.lit(new_prefix)]
    if keep_input:
        parts += [body, F.lit(fixed.SEPARATOR)]
    if keep_output:
        parts.append(_col(first_output))
    return F.concat(*parts)


def mask_tokens(tokens: str | Column, key: str | Column, rate: float, seed: int) -> Column:
    """Replace a seeded share of the tokens by the mask token; key and position decide, not chance."""
    key = _col(key).cast("string")

    def one(token: Column, at: Column) -> Column:
        hit = hash_fraction(seed_hash(seed, key, at)) < rate
        return F.when(hit, F.lit(fixed.MASK_TOKEN)).otherwise(token)

    return F.transform(_col(tokens), one)


def unmask(values: str | Column, pad: int, hidden: int = -100) -> Column:
    """Replace the hidden-label value in an integer array."""
    return F.transform(_col(values), lambda v: F.when(v == hidden, F.lit(pad)).otherwise(v))


def distinct_in_order(values: str | Column) -> Column:
    """First-seen distinct elements of an array."""
    return F.array_distinct(_col(values))
