"""Registered queries against their DuckDB statements on sf0.001.  Queries
without a statement are optional ones that no SQL expresses; their own tests
hold them against brute-force versions."""

import pytest

import __spark_entry__ as E
from palletwise.plans.registry import REGISTRY
from tests.conftest import SF_SMALL

from tools.oracle_check import compare, duck

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_library_query_has_an_oracle():
    assert set(REGISTRY) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, SF_SMALL, name, E.queries()[name], E.oracle_sql()[name])
    assert r["ok"], r


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "line_no" in df.columns
