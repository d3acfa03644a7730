"""Every registered query against its SQL twin."""

import pytest
from parity import connect, difference

import __spark_entry__ as entry
from halocline import queries as registered

QUERIES, SQL = registered.queries(), registered.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert name in SQL
    assert difference(QUERIES[name](spark, sf_dir), con, SQL[name]) is None


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["component", "bin", "n"] and df.count() > 0
