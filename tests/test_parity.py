"""Every registered query against its check SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
from parity import compare
from vetloom.catalog.registry import QUERIES

entry.queries()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", QUERIES[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
