"""What the optimizer makes of the queries: joins, limits, scans, no Python in batch plans."""

import pytest

from candex.catalog import QUERIES
from candex.sources.tables import inventory_files

FOLDER = "/root/testdata/sf0.001"

# Queries that are a first-n choice per group.
LIMITED = [
    "a1_group_parts", "a2_top_groups", "a10_latest_version", "a11_dedup_first", "f1_first_by_name",
    "u1_ordered_union_distinct", "u2_limit_per_group", "w10_nested_quota", "w12_cap_then_rank",
    "w14_first_acceptable_else_best", "w15_priority_fallback", "w18_choose_default", "w21_first_match_in_group",
]


def plan(spark, df):
    return spark.sql("EXPLAIN FORMATTED SELECT * FROM {df}", df=df).first()[0]


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("t")])
def test_no_nested_loops_and_no_python(spark, name):
    text = plan(spark, QUERIES[name](spark, FOLDER))
    for node in ("BroadcastNestedLoopJoin", "CartesianProduct", "Python", "Pandas", "Arrow"):
        assert node not in text, node


@pytest.mark.parametrize("name", LIMITED)
def test_first_rows_are_cut_before_the_shuffle(spark, name):
    text = plan(spark, QUERIES[name](spark, FOLDER))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, QUERIES["s1_load_table"](spark, FOLDER))
    assert "GreaterThanOrEqual(l_quantity,10.0)" in text
    assert "l_extendedprice" not in text.split("ReadSchema")[1].split("\n")[0]


def test_inventory_leaves_the_content_alone(spark):
    text = plan(spark, inventory_files(spark, FOLDER))
    assert "content" not in text.split("ReadSchema")[1].split("\n")[0]


def test_successive_scans_share_one_shuffle(spark):
    text = plan(spark, QUERIES["w5_edge_trim"](spark, FOLDER))
    assert text.split("\n\n")[0].count("Exchange") == 1


@pytest.mark.parametrize("name", ["j4_slice_extents", "j7_interval_join_fallback"])
def test_scans_that_are_read_twice_run_once(spark, name):
    """What follows reads written rows: no window is left in the plan."""
    assert "Window" not in plan(spark, QUERIES[name](spark, FOLDER))
