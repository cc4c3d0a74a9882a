"""Every registered query against its oracle SQL on the smallest data."""

import pytest

from tabsight.check import compare, connect
from tabsight.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, con, name):
    assert compare(spark, con, sf, QUERIES[name], ORACLES.get(name)) == ""


def test_contract():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 130
