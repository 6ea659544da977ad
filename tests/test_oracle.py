"""Every registered query runs; those with a SQL twin give the same rows."""
import pytest

import __spark_entry__ as entry
from tools.check import compare, duck

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, sf, con, key):
    assert compare(QUERIES[key](spark, sf), con, ORACLES[key]) == ""


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, key):
    df = QUERIES[key](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
