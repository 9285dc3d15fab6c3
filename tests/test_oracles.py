"""Every query against its SQL oracle at the smallest scale."""

import pytest
from conftest import SF
from oracle import compare, connect

import __spark_entry__ as entry
import catalogue

QUERIES, ORACLES = catalogue.QUERIES, catalogue.ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], ORACLES[name]) is None


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0 and "content" in rows.columns
