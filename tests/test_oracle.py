"""Every registered query against its SQL on the given tables."""

import pytest
from compare import connect, difference

from __spark_entry__ import entry, oracle_sql
from clicktide.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR), con, SQL[name]) is None


def test_entry(spark):
    row = entry(spark).first()
    assert row.session_count > 0
