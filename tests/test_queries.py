"""Every registered query against its SQL, and the shape of the entry module."""

import os

import pytest
from differential import compare, connect

import __spark_entry__ as driver
from docloom import plans

FOLDER = os.environ.get("DOCLOOM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query_matches_sql(spark, con, name):
    same, told = compare(spark, con, name, FOLDER)
    assert same, told


def test_entry(spark):
    assert driver.entry(spark).columns == ["seq", "term", "doc_id", "page_no", "heading", "context"]
    assert driver.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(plans.ORACLES) == set(plans.QUERIES)
    assert set(driver.oracle_sql()) <= set(driver.queries())
