"""Every registered query against its DuckDB SQL at the smallest scale."""

import pytest
from check import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF, name, entry.queries()[name], ORACLES.get(name))
    spark.catalog.clearCache()
    assert ok, note


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())
