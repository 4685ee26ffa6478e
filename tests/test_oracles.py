"""Every registered query against its SQL statement on the smallest tables."""

import pytest
from check import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem, rows, _, _ = compare(spark, con, QUERIES[name], SQL.get(name), SF)
    assert problem is None
    assert rows >= 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1
