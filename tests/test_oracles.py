"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from check_oracles import compare, connect

import __spark_entry__ as registry
from sparkrules.plans.registry import QUERIES

ORACLES = {name: sql for name, (_, sql) in QUERIES.items() if sql is not None}
NO_SQL = {"cluster"}  # an iterative fit, whose fixpoint cluster_invariants checks


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_only_named_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == NO_SQL
    assert set(QUERIES) <= set(registry.queries())
    assert ORACLES.items() <= registry.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, sf_dir, name):
    result, rows = compare(con, registry.queries()[name](spark, sf_dir), ORACLES[name])
    # the smallest corpus is sampled whole, so nothing remains of it
    expected = "EMPTY" if name == "remainder" else "ok"
    assert result == expected, f"{name}: {result} ({rows} rows)"


def test_entry(spark):
    df = registry.entry(spark)
    assert df.columns == ["query_id", "n_exemplars", "prompt"]
    assert df.count() == 40
