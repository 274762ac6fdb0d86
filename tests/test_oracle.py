"""Every registered query against its SQL over the whole tables of the smallest size."""

import compare
import pytest
from conftest import SF_SMALL

import __spark_entry__ as entry
from newsloom import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert compare.difference(spark, duck, name, SF_SMALL) == ""


def test_every_query_has_a_check():
    assert set(catalog.ORACLES) == set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 120 and "rank" in df.columns
