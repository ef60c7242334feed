"""Every registered query against its SQL on whole tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.run import compare, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, sf, name):
    ok, note, got = compare(spark, con, name, sf)
    assert ok is not False, note
    assert got[1] or ok


def test_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["film", "task", "input", "target"]
    assert df.count() > 0
