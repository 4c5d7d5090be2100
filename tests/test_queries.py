"""Every registered query against its SQL, on the smallest test data."""

import pytest

import __spark_entry__ as contract
from check import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_agrees_with_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, name) == ""


def test_every_sql_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_runs(spark):
    ranks = contract.entry(spark)
    assert ranks.columns == ["node", "rank"]
    assert ranks.count() > 0
