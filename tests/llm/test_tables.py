import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from sparkrules.llm.tables import same, small


def sent(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("extended")
    return "broadcast" in out.getvalue().lower()


def test_broadcasts_are_bounded_by_rows_and_by_bytes(spark):
    short = spark.range(100).select(F.col("id").alias("k"), F.lit("x").alias("t"))
    assert sent(small(short)) and sent(small(short, rows=100))
    assert not sent(small(short, rows=99))
    long = short.select("k", F.repeat("t", 1000).alias("t"))
    assert sent(small(long, size=150_000)) and not sent(small(long, size=50_000))
    nested = short.select("k", F.array_repeat(F.struct("t", "k"), 100).alias("list"))
    assert not sent(small(nested, size=10_000))
    assert sent(small(short.filter("k < 0"))) and sent(small(short.select("k", F.lit(None).alias("none"))))


def test_same_takes_nulls_as_equal(spark):
    one = spark.createDataFrame([(1, "a"), (None, "a"), (None, None)], "i int, d string")
    two = spark.createDataFrame([(None, "a"), (None, None), (2, "a")], "i int, d string")
    assert one.join(two, same(one, two, "i", "d")).count() == 2
