"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as driver
from tests.oracle import compare, duck

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = driver.queries(), driver.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, connection, name):
    assert compare(QUERIES[name](spark, SF_DIR), connection, SQL[name]) == ""


@pytest.mark.parametrize("name", ["pca_report", "pca_reduce", "pca_whiten"])
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert driver.entry(spark).columns == [
        "language", "n_correct", "n_wrong", "n_not_important", "n_words",
    ]


def test_every_statement_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
