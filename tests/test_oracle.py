"""Every registered query with SQL must equal DuckDB's answer to that SQL."""

import pytest

import __spark_entry__ as entry
from harborline.plans import QUERIES as PLANS
from tests.conftest import SF
from tests.oracle_check import compare, connect

QUERIES = dict(PLANS)
ORACLES = {k: v for k, v in entry.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SF), duck, ORACLES[name]) == []


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 5


def test_every_query_is_known_to_the_oracle_or_listed_here():
    assert set(QUERIES) - set(ORACLES) == set()
