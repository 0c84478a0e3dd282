"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest

import __spark_entry__ as contract
from traceloom.plans.queries import registered
from check_queries import connect, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
STATEMENTS = contract.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF)


def test_every_query_has_sql():
    assert set(registered()) <= set(STATEMENTS) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query(spark, db, name):
    df = contract.queries()[name](spark, SF)
    names, expected = sql_rows(db, STATEMENTS[name])
    assert names == sorted(df.columns)
    assert spark_rows(df) == expected


def test_entry(spark):
    assert contract.entry(spark).count() == 1000
