"""Every terrain query with SQL against DuckDB."""

import pytest

import __spark_entry__ as entry
from orograph.plans.catalog import ORACLES, QUERIES
from tests.compare import duck, same
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    same(QUERIES[name](spark, SMALL), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs_twice_alike(spark, name):
    first = sorted(map(repr, QUERIES[name](spark, SMALL).collect()))
    assert first and first == sorted(map(repr, QUERIES[name](spark, SMALL).collect()))


def test_entry(spark):
    assert {r.layer: r.segments for r in entry.entry(spark).collect()}.keys() == {"Contours-Major", "Contours-Minor"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
