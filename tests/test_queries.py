"""Every registered query of the reference's operators that has SQL equals DuckDB's result on the small tables."""

import compare
import pytest

from scoreframe.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.duck(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(name, spark, sf_dir, con):
    assert compare.difference(catalog.QUERIES[name](spark, sf_dir), con, catalog.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(name, spark, sf_dir):
    assert catalog.QUERIES[name](spark, sf_dir).columns


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0
