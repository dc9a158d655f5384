"""What the plans must show at any scale."""

import pathlib
import re

import pytest

from capledger.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test tables")


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "compliance_projection", "gold_projection", "weighted_sum", "effective_rate", "membership_flag", "reconcile_counts",
    "version_history", "section_fill", "number_chunks", "insert_new", "rows_by_column", "cosine_topk", "profile"])
def test_no_cross_join_and_no_single_task_window(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "SinglePartition" not in text


@pytest.mark.parametrize("name", ["latest_per_key", "silver_clean", "insert_new", "first_k_text", "cosine_topk"])
def test_picks_are_limited_before_the_shuffle(spark, name):
    text = plan(spark, name)
    partial, exchange = text.index("Partial"), text.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in text and partial > exchange  # the partial limit is below the exchange


def test_filters_and_columns_reach_the_scan(spark):
    lookup = plan(spark, "entity_lookup")
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(l_suppkey", lookup)
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in plan(spark, "project_rename")


def test_documents_are_chunked_without_a_shuffle(spark):
    assert "Exchange" not in plan(spark, "chunk_documents")


def test_a_median_reads_its_input_once(spark):
    assert plan(spark, "median_by_group").count("lineitem.parquet") == 0  # it works on stored counts


def test_a_line_is_read_in_stages(spark):
    # Each of cells and words is split once; nothing is written out again for each field.
    assert plan(spark, "layout_lines").count("split(") <= 3
