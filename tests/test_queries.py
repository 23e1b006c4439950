"""Every registered query against its SQL twin on the small tables."""

import pathlib
import sys

import pytest
from oracle import connect, difference

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
import __spark_entry__ as registered  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = registered.queries(), registered.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert registered.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, SF_DIR, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
