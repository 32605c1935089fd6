"""Hand-worked cases of the row-wise functions."""

import pytest
from pyspark.sql import functions as F

from sparkrules.functions import elements, names, quantity
from sparkrules.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("build", "given", "expected"),
    [
        (T.doc_code, "docs/XX-B1AS1#12", "B1AS1"),
        (T.doc_code, "no dash", ""),
        (T.normalise_text, "  a clause \n", "a clause."),
        (T.normalise_text, "done.", "done."),
        (T.normalise_text, "", ""),
        (T.apply_replacements, "use walls", "usage wall"),
        (T.space_terms, "has(wallTie,x_y)", "has( wall tie, x y)"),
        (T.clean_prediction, " Sure: if(a{b]). ", "if(a(b))"),
        (T.clean_prediction, "no rule here", "no rule here"),
        (T.answer_after, "think Target: if(a) ", "if(a)"),
        (T.answer_after, "if(a)", "if(a)"),
        (T.split_leaf, "wallTie.maxSpan_of", "wall tie. max span of"),
        (T.split_leaf, "Wall Tie_x", "Wall Tie x"),
        (elements.drop_clue, "clue: if(a)", "if(a)"),
        (elements.drop_clue, "no colon here", "no colon here"),
        (elements.drop_clue, "x" * 40 + ": y", "x" * 40 + ": y"),
    ],
)
def test_text(spark, build, given, expected):
    assert one(spark, build(F.col("c")), c=given) == expected


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("wallTie", ["wall", "tie"]),
        ("pipe.width", ["pipe", "width"]),
        ("a.b.c", ["a", "b", "c"]),
        ("12mm pipe", ["12", "mm", "pipe"]),
        ("5 kN load", ["5", "kn", "load"]),
        ("x_y", ["x", "y"]),
    ],
)
def test_score_words(spark, given, expected):
    assert one(spark, T.score_words(F.col("c")), c=given) == expected


def test_option_number(spark):
    assert one(spark, T.option_number("c"), c="I take Option 12.") == 12
    assert one(spark, T.option_number("c"), c="none") == 0


def test_rename_terms_there_and_back(spark):
    rule = "expr(fun(is),atom(rel(type),var(pipe)))"
    long = one(spark, T.rename_terms("c"), c=rule)
    assert long == "expression(function(is),atom(relation(type),variable(pipe)))"
    assert one(spark, T.rename_terms("c", reverse=True), c=long) == rule


def test_qualify_refs(spark):
    rule = "and(see(t1.2),see(3.1.4),see(t1.2))"
    out = one(spark, T.qualify_refs("c", F.lit("doc_b1_")), c=rule)
    assert out == "and(see(doc_b1_t1.2),see(doc_b1_3.1.4),see(doc_b1_t1.2))"
    assert one(spark, T.strip_refs("c", F.lit("doc_b1_")), c=out) == rule
    keyed = "rel(key),see(t1.2)"
    assert one(spark, T.qualify_refs("c", F.lit("doc_b1_")), c=keyed) == keyed


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("50 mm", ("50.0", "milli", "metre", None, None, None)),
        ("12.5 m", ("12.5", None, "metre", None, None, None)),
        ("3 kg/m3", ("3.0", "kilo", "gram", None, "division", "metre")),
        ("2 apples", None),
        ("mm", None),
    ],
)
def test_quantity(spark, given, expected):
    q = one(spark, quantity.parse_quantity("c"), c=given)
    if expected is None:
        assert q is None
    else:
        second = q["second"]["kind"] if q["second"] else None
        assert (q["value"], q["first"]["prefix"], q["first"]["kind"], q["first"]["exponent"], q["operator"], second) == expected
        assert one(spark, quantity.format_quantity(quantity.parse_quantity(F.col("c"))), c=given) == given


def test_run_names(spark):
    df = spark.createDataFrame([("t5-base-b8_0.0003_beam3_hyper_x_doc_split_43",)], "name string")
    row = names.parse_run_name(df).first()
    assert (row.model_name, row.batch_size, row.learning_rate, row.beam_size) == ("t5-base", 8, 0.0003, 3)
    assert df.select(names.drop_parts("name", 2)).first()[0] == "t5-base-b8_0.0003_beam3_hyper_x_doc"


def test_half_even(spark):
    df = spark.createDataFrame([(0.25,), (0.35,), (1.5,)], "v double")
    assert [r[0] for r in df.select(names.half_even(F.col("v"), 0)).collect()] == [0.0, 0.0, 2.0]


def test_masking_is_stable_and_near_the_rate(spark):
    df = spark.range(2000).select("id", F.lit("a b c d e f g h i j").alias("t"))
    masked = df.select(F.size(F.filter(T.mask_tokens(T.words("t"), "id", 0.15, 3), lambda w: w == "<mask>")).alias("n"))
    share = masked.agg(F.sum("n")).first()[0] / 20_000
    assert 0.13 < share < 0.17
    assert share == masked.repartition(7).agg(F.sum("n")).first()[0] / 20_000
