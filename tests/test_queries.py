"""Each query against its SQL, on the smallest tables."""

import pathlib
import sys

import pytest

sys.path[:0] = [str(pathlib.Path(__file__).parent)]

from capledger.queries import QUERIES, SQL
from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_its_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name not in SQL:
        assert df.count() > 0
    else:
        assert compare(df, con, SQL[name]) is None


@pytest.mark.parametrize("name", ["layout_lines", "layout_unmatched", "reload_dimension"])
def test_lines_that_only_larger_tables_have(spark, name):
    folder = "/root/testdata/sf0.01"
    assert compare(QUERIES[name](spark, folder), connect(folder), SQL[name]) is None


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
