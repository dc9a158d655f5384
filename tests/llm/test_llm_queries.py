"""The registered queries over the smallest tables, and what their columns are."""

import pathlib
import sys

import pytest

sys.path[:0] = [str(pathlib.Path(__file__).parents[1])]

from compare import compare, connect

from capledger.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test tables")

COLUMNS = {
    "op1": ("documents", "doc_id class_id n_texts n_rows kept"),
    "op2": ("documents", "doc_id held_out lang_pred score"),
    "op3": ("pages", "page_id payload_bytes payload_digest record_type refers_to"),
    "op4": ("documents", "doc_id held_out score predicted"),
    "op5": ("documents", "doc_id text n_entities"),
    "op6": ("embeddings", "vec_id n_links component_id kept"),
    "op12": ("documents", "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next"),
    "op10": ("pages", "page_id url text n_chars"),
}


def test_one_query_for_each_operator():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("op", COLUMNS)
def test_one_row_for_each_row(spark, op):
    name, = (q for q in QUERIES if q.startswith(f"{op}_"))
    table, columns = COLUMNS[op]
    got = QUERIES[name](spark, FOLDER)
    assert got.columns[: len(columns.split())] == columns.split()
    key = columns.split()[0]
    want = spark.read.parquet(f"{FOLDER}/{table}.parquet")
    assert sorted(r[0] for r in got.select(key).collect()) == sorted(r[0] for r in want.select(key).collect())


@pytest.mark.parametrize("name", SQL)
@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_query_agrees_with_its_sql(spark, name, folder):
    assert compare(QUERIES[name](spark, folder), connect(folder), SQL[name]) is None
