"""Every registered query runs, and agrees with its SQL where it has one."""

import pytest

import __spark_entry__ as entry
from tests import oracle

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, con, sf_dir, name):
    assert oracle.compare(spark, con, QUERIES[name], SQL[name], sf_dir) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["label_name", "n", "pct"]
