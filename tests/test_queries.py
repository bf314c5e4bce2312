"""Every registered query against its SQL, on the smallest tables; those without SQL run and have a schema."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"
LIBRARY = entry.catalog.QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(LIBRARY))
def test_query(spark, con, name):
    assert compare(spark, con, LIBRARY[name], entry.catalog.SQL.get(name), SF).startswith(("equal", "rows only"))


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
