"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as registry
from workloads.check import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_names_agree():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, SF_DIR, QUERIES[name], ORACLE.get(name))
    assert ok is not False, note


def test_entry(spark):
    assert registry.entry(spark).count() > 0
