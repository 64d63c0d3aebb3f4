"""Every registered query at the smallest scale: equal to its SQL, or at least not empty."""

import pytest
from compare import compare, connect

import __spark_entry__ as contract
from periodica.plans import QUERIES, SQL




@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, sf, name):
    assert compare(spark, con, QUERIES[name], SQL[name], sf) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "dayset" and df.count() == 7
