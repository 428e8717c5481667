"""Every registered query gives the rows of its SQL on the same tables."""

import pytest

import __spark_entry__ as contract
import compare
from stockmill.plans.oracle import ORACLE
from stockmill.plans.registry import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 20


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, sf_dir, con, name):
    actual = compare.spark_rows(QUERIES[name](spark, sf_dir))
    expected = compare.sql_rows(con, ORACLE[name])
    assert actual[1], "no rows"
    assert compare.difference(actual, expected) == ""
