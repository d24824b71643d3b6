"""Every registered query against DuckDB on the smallest data set."""

import os

import compare
import pytest

from workload.all import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_matches_sql(spark, duck, name):
    q = QUERIES[name]
    assert compare.difference(q.run(spark, SF_DIR), duck, q.sql) is None


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_runs(spark, name):
    assert QUERIES[name].run(spark, SF_DIR).count() > 0
