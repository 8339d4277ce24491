"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(entry.oracle_sql())

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) is None


def test_every_query_of_the_library_has_sql_but_the_named_ones():
    assert {n for n in set(entry.queries()) - set(entry.oracle_sql()) if not n.startswith("op") and n != "pipeline"} == {"r5_approximate_vector_search", "r5_stored_vector_search", "s3_list_objects"}


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
