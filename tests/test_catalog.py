"""Every registered query against its SQL, or that it yields rows where there is none."""

import pytest
from conftest import SMALL
from oracle import compare

from tallyglass.catalog import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SMALL), duck, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_yields_rows(spark, name):
    assert QUERIES[name](spark, SMALL).limit(1).count() == 1


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())
