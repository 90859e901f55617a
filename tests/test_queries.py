"""Every query of the catalogue against its SQL in DuckDB."""

import pytest

from pointloom.catalog import QUERIES, SQL

from conftest import rows_of


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    ours = QUERIES[name](spark, sf).toPandas()
    theirs = duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 256
