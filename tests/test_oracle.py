"""Every registered query against its SQL twin on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry_points
from tests.compare import difference, run_sql

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = entry_points.queries()
ORACLES = entry_points.oracle_sql()


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    assert difference(got, run_sql(ORACLES[name], SF_DIR)) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).limit(1).count() == 1
