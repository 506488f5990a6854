"""Every core query against its SQL on the smallest data."""

import pytest
from comparing import rows_of, rows_of_sql

from attestra import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, data, duck, name):
    cols, got = rows_of(catalog.QUERIES[name](spark, data))
    names, want = rows_of_sql(duck, catalog.SQL[name])
    assert cols == names
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs_without_sql(spark, data, name):
    catalog.QUERIES[name](spark, data).collect()


def test_names_of_sql_are_queries():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
