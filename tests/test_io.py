"""Sources, sinks, the stream helper, and results that do not depend on partitions."""

import pytest
from pyspark.sql import functions as F

from sparkrules.functions import text as T
from sparkrules.operators import nodes
from sparkrules.sources import io
from sparkrules.storage import scratch_path
from sparkrules.streaming import read_corpus_stream, write_columns

ODD = ['plain', 'a, "quoted" one', 'two\nlines', '  padded  ', '', None, "it's"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, f"f{i}", t, "if(a)") for i, t in enumerate(ODD)], io.CORPUS_SCHEMA)
    io.write_table(df, str(tmp_path / "c"), "csv")
    back = {r.row_id: r.text for r in io.read_corpus(spark, str(tmp_path / "c")).collect()}
    assert back == dict(enumerate(ODD))


def test_line_numbers_over_many_splits(spark, tmp_path):
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("".join(f"{name} line {i}\n" if i % 10 else "\n" for i in range(1, 3001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = io.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 6000
    for name in ("a.txt", "b.txt"):
        mine = sorted((r.line_no, r.value) for r in rows if r.file.endswith(name))
        assert mine == [(i, f"{name} line {i}" if i % 10 else "") for i in range(1, 3001)]


def test_whole_text_and_mixture(spark, tmp_path):
    (tmp_path / "context.txt").write_text("one\ntwo\n")
    assert io.read_text(spark, str(tmp_path / "context.txt")).first().text == "one\ntwo\n"
    for name, n in (("gold", 3), ("silver", 5)):
        io.write_table(spark.range(n), str(tmp_path / "mix" / name))
    counts = io.read_mixture(spark, str(tmp_path / "mix"), ["gold", "silver"]).groupBy("dataset").count().collect()
    assert {r.dataset: r["count"] for r in counts} == {"gold": 3, "silver": 5}


def test_metric_log_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    for epoch in (1, 2):
        io.append_metrics(spark.createDataFrame([("r1", epoch, 0.5), ("r2", epoch, 0.7)], "run string, epoch int, f1 double"), path)
    assert spark.read.parquet(path).filter("run = 'r1'").count() == 2


def test_writes_do_not_overwrite_by_default(spark, tmp_path):
    io.write_table(spark.range(1), str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)exists"):
        io.write_table(spark.range(1), str(tmp_path / "t"))


class _Conf(dict):
    pass


class _Session:
    """Just what ``scratch_path`` reads."""

    def __init__(self, conf, master):
        self.conf = _Conf(conf)
        self.sparkContext = type("C", (), {"master": master, "applicationId": "app", "getCheckpointDir": lambda self: None})()


def test_scratch_follows_the_shared_folder():
    assert scratch_path(_Session({"spark.checkpoint.dir": "hdfs://x/ck/"}, "yarn")).startswith("hdfs://x/ck/app/")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(_Session({}, "yarn"))
    assert scratch_path(_Session({}, "local[2]"))


def test_stream_takes_the_row_functions(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(1, " a clause "), (2, "b.")], "row_id int, text string")
    df.write.parquet(source)
    stream = read_corpus_stream(spark, source, "row_id int, text string")
    write_columns(stream, {"clean": T.normalise_text("text")}, out, str(tmp_path / "ck")).awaitTermination(120)
    assert {r.row_id: r.clean for r in spark.read.parquet(out).collect()} == {1: "a clause.", 2: "b."}


def test_same_rows_for_any_partitioning(spark, sf_dir):
    from sparkrules.plans.inputs import load

    rules = load(spark, sf_dir, "rules")
    facts = lambda df: nodes.factor_alternatives(nodes.predicate_facts(df)).select("row_id", "node_id", F.array_join("values", "|").alias("v"))
    one, many = facts(rules.repartition(1)), facts(rules.repartition(8))
    assert one.count() == many.count() and one.exceptAll(many).count() == 0
