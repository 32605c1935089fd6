"""Filters, flags, variants, joins and set operations that build a corpus.

Joins are plain equi joins: Catalyst and AQE pick broadcast for sides they measure to be small, and
AQE splits a hot key of the left side of inner, left, semi and anti joins. Tables that the caller
passes as Python lists (tags, folds, caps) are literals, so they cost no join at all.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrules.functions import fixed
from sparkrules.functions import text as T
from sparkrules.operators.ranking import rank_rows
from sparkrules.storage import stored


def any_of(flags: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))


def contains_any(c: str | Column, terms: Sequence[str]) -> Column:
    """True if the text contains one of the terms; null texts contain nothing."""
    column = F.col(c) if isinstance(c, str) else c
    return F.coalesce(any_of([column.contains(t) for t in terms]), F.lit(False))


# --- filters and predicates ---------------------------------------------------------------------


def select_split(df: DataFrame, col: str, code: int) -> DataFrame:
    """Rows of one split code; 0 means all rows."""
    return df if code == 0 else df.filter(F.col(col) == code)


def holdout_split(
    df: DataFrame,
    names: Sequence[str],
    *,
    doc: str = "file",
    length_of: str | None = None,
    caps: Mapping[str, int] | None = None,
) -> DataFrame:
    """Tag rows ``valid`` when the document contains one of ``names``, else ``train``.

    ``caps`` keeps only rows whose ``length_of`` column is shorter than the cap of their split.
    """
    out = df.withColumn("split", F.when(contains_any(doc, names), "valid").otherwise("train"))
    if caps:
        within = [(F.col("split") == split) & (F.length(length_of) < cap) for split, cap in caps.items()]
        uncapped = ~F.col("split").isin(list(caps))
        out = out.filter(any_of([*within, uncapped]))
    return out


def tag_flags(
    df: DataFrame, comments: str = "comments", groups: Mapping[str, Sequence[str]] = fixed.TAG_GROUPS
) -> DataFrame:
    """One boolean ``has_<group>`` per tag group."""
    return df.withColumns({f"has_{g}": contains_any(comments, tags) for g, tags in groups.items()})


def is_added(old: str, new: str, comments: str) -> Column:
    """Was knowledge put before the old text, or marked as added in the comments?"""
    head = F.substring(F.replace(F.col(old), F.lit(";"), F.lit("")), 1, 20)
    moved = F.instr(F.col(new), head) > 3
    marked = F.col(comments).contains(fixed.ADDED_MARKER)
    return F.coalesce(moved, F.lit(False)) | F.coalesce(marked, F.lit(False))


def word_if(flag: Column, word: str) -> Column:
    return F.when(flag, F.lit(word)).otherwise(F.lit(""))


def with_conditions(
    df: DataFrame,
    *,
    comments: str = "comments",
    text: str = "text",
    text_old: str = "text_old",
    rule: str = "rule",
) -> DataFrame:
    """Add the condition flags and words: granularity, implicit, ignore, and marks in the rule.

    Fine means neither medium nor coarse. Implicit means tagged as tacit but not yet added, or
    tagged with the ``domain`` group where a corpus has one.
    """
    out = tag_flags(df, comments)
    implicit = F.col("has_tacit") & ~is_added(text_old, text, comments)
    flags = {
        "is_medium": F.col("has_medium"),
        "is_coarse": F.col("has_coarse"),
        "is_fine": ~(F.col("has_medium") | F.col("has_coarse")),
        "is_implicit": implicit,
        "is_ignore": F.col("has_ignore"),
    }
    marks = {f"is_{label}": F.col(rule).contains(mark) for label, mark in fixed.RULE_MARKS.items()}
    return out.withColumns({**flags, **marks}).drop(*[f"has_{g}" for g in fixed.TAG_GROUPS])


def condition_label() -> Column:
    """Granularity words in the order medium, coarse, fine, joined without a blank."""
    return F.concat(*[word_if(F.col(f"is_{g}"), fixed.CONDITION_WORDS[g]) for g in ("medium", "coarse", "fine")])


def condition_variants(df: DataFrame, prefix: str, title: Column, text: str = "text") -> DataFrame:
    """One named dataset per condition: prefix, text, end token and the condition word."""
    conditions = {
        "document": title,
        "define": word_if(F.col("is_define"), "define"),
        "rulestatement": word_if(F.col("is_rulestatement"), "rulestatement"),
        "key": word_if(F.col("is_key"), "key"),
        "granularity": condition_label(),
        "implicit": word_if(F.col("is_implicit"), fixed.CONDITION_WORDS["tacit"]),
        "ignore": word_if(F.col("is_ignore"), fixed.CONDITION_WORDS["ignore"]),
        "medium": word_if(F.col("is_medium"), fixed.CONDITION_WORDS["medium"]),
        "coarse": word_if(F.col("is_coarse"), fixed.CONDITION_WORDS["coarse"]),
    }
    variants = F.array(*[F.struct(F.lit(n).alias("dataset"), c.alias("label")) for n, c in conditions.items()])
    exploded = df.withColumn("_v", F.explode(variants))
    conditioned = F.concat(F.lit(prefix), F.col(text), F.lit(fixed.END_TOKEN), F.col("_v.label"))
    return exploded.withColumn("dataset", F.col("_v.dataset")).withColumn("input", conditioned).drop("_v")


def ablation_variants(df: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """One dataset per flag, without the rows that carry it."""
    options = F.array(*[F.when(~flag, F.lit(name)) for name, flag in flags.items()])
    return df.withColumn("dataset", F.explode(F.array_compact(options)))


def filter_runs(df: DataFrame, *all_of: Column) -> DataFrame:
    """Drop the runs for which every condition holds; an unknown condition does not hold."""
    both = reduce(lambda a, b: a & b, all_of)
    return df.filter(~F.coalesce(both, F.lit(False)))


# --- fixed values: temperature of attempt 0, 1, 2, ... -------------------------------------------
ATTEMPT_TEMPERATURES = [0.0, 0.0, 0.4, 0.8, 1.2, 1.6, 2.0]


def has_rule(response: Column) -> Column:
    return response.contains("if(")


def has_target(response: Column) -> Column:
    return F.lower(response).contains("target:")


def has_option(response: Column) -> Column:
    return response.rlike(r"Option (\d+)")


def pick_attempt(
    attempts: DataFrame,
    check: Callable[[Column], Column],
    *,
    key: str = "row_id",
    attempt: str = "attempt",
    response: str = "response",
) -> DataFrame:
    """Per row the first valid attempt, or the last one flagged as an error. One aggregate, no sort."""
    valid = F.coalesce(check(F.col(response)), F.lit(False))
    number = F.col(attempt).cast("bigint")
    order = F.struct((~valid).alias("bad"), F.when(valid, number).otherwise(-number).alias("n"))
    best = F.min_by(F.struct(number.alias("a"), F.col(response).alias("r"), (~valid).alias("e")), order)
    temperatures = F.array(*[F.lit(t) for t in ATTEMPT_TEMPERATURES])
    return (
        attempts.groupBy(key)
        .agg(best.alias("_b"))
        .select(
            key,
            F.col("_b.a").alias(attempt),
            F.get(temperatures, F.col("_b.a").cast("int")).alias("temperature"),
            F.col("_b.r").alias(response),
            F.col("_b.e").alias("is_error"),
        )
    )


# --- joins and set operations --------------------------------------------------------------------


def remainder(df: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """Rows whose value does not occur in the sample; twins of sampled values leave as well."""
    return df.join(sample.select(key).distinct(), key, "left_anti")


def exclude_used(df: DataFrame, used: DataFrame, key: str = "text") -> DataFrame:
    """Rows whose value was not used elsewhere."""
    return remainder(df, used, key)


def overlay(
    df: DataFrame, updates: DataFrame, col: str, computed: Column, key: str = "row_id", order: Column | None = None
) -> DataFrame:
    """Set ``col`` from ``updates`` where the row is present there, else from ``computed``.

    Of several updates for a key the one that is last by ``order`` (by its own value without one) holds.
    """
    value = F.struct(F.col(col))
    newest = F.max(value) if order is None else F.max_by(value, order)
    new = updates.groupBy(F.col(key).alias("_key")).agg(newest.alias("_update"))
    value = F.when(F.col("_update").isNotNull(), F.col(f"_update.{col}")).otherwise(computed)
    return df.join(new, df[key] == new["_key"], "left").withColumn(col, value).drop("_update", "_key")


def align_by_position(a: DataFrame, b: DataFrame, order_a: Sequence[str], order_b: Sequence[str]) -> DataFrame:
    """Join the i-th row of ``a`` to the i-th row of ``b``; surplus rows of the longer side stay, with nulls beside them."""
    left = rank_rows(a, order_a, name="position")
    right = rank_rows(b, order_b, name="position")
    return left.join(right, "position", "full")


def apply_corrections(df: DataFrame, patches: DataFrame, col: str, key: str = "row_id") -> DataFrame:
    """Apply per-row literal patches (``seq, find, put``) in sequence."""
    folded = patches.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("seq", "find", "put"))).alias("_patches")
    )
    patched = F.aggregate("_patches", F.col(col), lambda acc, p: F.replace(acc, p["find"], p["put"]))
    return (
        df.join(folded, key, "left")
        .withColumn(col, F.when(F.col("_patches").isNotNull(), patched).otherwise(F.col(col)))
        .drop("_patches")
    )


def candidate_table(refs: DataFrame, runs: Mapping[str, DataFrame], key: str = "row_id") -> DataFrame:
    """Every run's prediction for each reference row, with the run's name and number."""
    tagged = [
        run.select(key, F.lit(i).cast("bigint").alias("cand_id"), F.lit(name).alias("run"), "pred")
        for i, (name, run) in enumerate(runs.items())
    ]
    return refs.join(stack(tagged), key)


def param_grid(axes: Mapping[str, DataFrame], skip: int = 0, block: int = 1 << 16) -> DataFrame:
    """All combinations of the axes' distinct values, numbered in axis order, from ``skip`` on.

    A combination is its number: the numbers from ``skip`` on are made in blocks, read as mixed-radix digits (one per axis, the last
    axis fastest), and every digit is looked up among the numbered values of its axis. Skipped combinations are never made, and
    no axis is gathered into one value or task.
    """
    numbered = {}
    for n, axis in axes.items():
        values = axis.select(F.col(axis.columns[0]).alias(n)).filter(F.col(n).isNotNull()).distinct()
        numbered[n] = stored(rank_rows(values, [n], name="_at").withColumn("_at", F.col("_at") - 1))
    sizes = {n: values.agg(F.count(F.lit(1))).scalar() for n, values in numbered.items()}
    spark = next(iter(numbered.values())).sparkSession
    total = reduce(lambda a, b: a * b, sizes.values())
    first = F.lit(skip).cast("bigint")
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((total - first - 1) / block))
    grid = spark.range(1).select(total.alias("_total")).filter(F.col("_total") > first).select("_total", F.explode(blocks).alias("_b")).repartition("_b")
    begin = first + F.col("_b") * block
    upto = F.least(begin + block, F.col("_total")) - 1
    grid = grid.select(F.explode(F.sequence(begin, upto)).alias("config_id"))
    rest = F.col("config_id")
    digits = {}
    for n in reversed(list(axes)):
        digits[n] = rest % sizes[n]
        rest = F.floor(rest / sizes[n])
    grid = grid.select("config_id", *[digits[n].alias(f"_{n}") for n in axes])
    for n, values in numbered.items():
        grid = grid.join(values, F.col(f"_{n}") == F.col("_at")).drop("_at", f"_{n}")
    return grid.select("config_id", *axes)


def stack(dfs: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    """UNION ALL by column name; with ``allow_missing``, columns that a table lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), dfs)


def stack_columns(df: DataFrame, columns: Sequence[str], into: str) -> DataFrame:
    """Original and paraphrase under one column, the other columns (the label) repeated."""
    choices = F.array(*[F.struct(F.lit(c).alias("origin"), F.col(c).alias(into)) for c in columns])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(choices))


# --- fixed values: which input a training mode reads ----------------------------------------------
MODE_INPUTS = {
    "ir": ["input"],
    "train-pred": ["input_pred"],
    "train-oracle": ["input_oracle"],
    "train-oracle-pred": ["input_pred", "input_oracle"],
}
SPLIT_NAMES = {1: "train", 2: "valid", 3: "test"}


def variant_views(df: DataFrame, mode: str, split_col: str) -> DataFrame:
    """The named splits of one training mode as one table of (split, variant, input, label).

    Training rows read the mode's inputs; validation and test read the predicted input. All modes
    but ``ir`` add test sets with the oracle input and without separator; ``ir`` adds all rows.
    """
    code = F.col(split_col)
    views: list[tuple[Column, str, str]] = []
    for column in MODE_INPUTS[mode]:
        views.append((code == 1, "train", column))
    held_out = "input" if mode == "ir" else "input_pred"
    views += [(code == 2, "valid", held_out), (code == 3, "test", held_out)]
    if mode == "ir":
        views.append((F.lit(True), "all", "input"))
    else:
        views += [(code == 3, "test_oracle", "input_oracle"), (code == 3, "test_no_sep", "input_no_sep")]
    options = F.array(
        *[
            F.when(
                when,
                F.struct(F.lit(split).alias("split"), F.lit(c).alias("variant"), F.col(c).alias("model_input")),
            )
            for when, split, c in views
        ]
    )
    return df.select("row_id", "label", F.inline(F.array_compact(options)))


def distinct_in_order(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with the position where each was first seen."""
    return df.groupBy(value).agg(F.min(position).alias("first_position"))


def first_pass_inputs(df: DataFrame, prefix: str, oracle: Column, prediction: Column) -> DataFrame:
    """The three inputs of a second model: plain, with the prediction, with the oracle form."""
    base = T.build_input(prefix, "text", "code")
    return df.withColumns(
        {
            "input_no_sep": base,
            "input_pred": F.concat(base, F.lit(fixed.SEPARATOR), prediction),
            "input_oracle": F.concat(base, F.lit(fixed.SEPARATOR), oracle),
        }
    )
