"""Every query with a SQL twin gives the same rows as DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, small, con, name):
    assert compare(entry.queries()[name](spark, small), con, ORACLES[name]) == []


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())
