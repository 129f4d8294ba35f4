"""Every registered query against its SQL on the smallest tables."""

import pytest
from check import compare, connection

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, con, name):
    ok, note, _ = compare(spark, con, name, queries()[name], oracle_sql().get(name), SF_DIR)
    assert ok, note


def test_entry_runs(spark):
    assert entry(spark).count() > 0
