"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from tests.compare import compare, connect
from workload.registry import entries

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(PATH)


@pytest.mark.parametrize("name", sorted(entries()))
def test_query(spark, duck, name):
    result = compare(spark, duck, PATH, name)
    assert result["ok"], result


def test_entry_points(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
