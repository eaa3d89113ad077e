"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tools.compare import compare, duck

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name, entry.oracle_sql()[name]).startswith("ok")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    frame = entry.entry(spark)
    assert frame.columns[:2] == ["feature_index", "feature_name"] and frame.count() > 0
