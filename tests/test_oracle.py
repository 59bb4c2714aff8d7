"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from orfloom import plans
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
plans.load()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, name, plans.QUERIES[name], plans.ORACLES.get(name), SF_DIR)
    assert ok, note


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == ["value", "n"]
