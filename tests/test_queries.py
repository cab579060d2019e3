"""Every registered query against its SQL on the smallest tables."""

import pytest

from candex.catalog import ORACLES, QUERIES
from tools.check import compare, database

FOLDER = "/root/testdata/sf0.001"

# Empty at this size; compared at sf0.01 by tools/check.py.
EMPTY = {"j10_semi_supported"}

# Queries whose operators scan ordered groups.
SCANS = [
    "a8_stream_verdict", "a12_reassemble_close", "a12_reassemble_replace", "a12_reassemble_stop", "j1_range_lookup",
    "j5_locate_offset", "j6_asof_backward", "j7_entry_ranges", "j7_interval_join_fallback", "w2_expand_index", "w6_cumulative_offsets",
    "r2_rle_encode", "r5_best_positions", "w1_strictly_increasing", "w3_marks_to_spans", "w4_take_while", "w5_edge_trim", "w7_islands", "w8_budget_clipped",
    "w9_budget_greedy", "w11_permille_sample", "w13_rank_candidates", "w17_last_assignment", "w19_start_gate",
    "w20_until_marker",
]


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    result = compare(spark, con, FOLDER, name)
    good = ("ok", "rows only", "EMPTY") if name in EMPTY else ("ok", "rows only")
    assert result.startswith(good), result


@pytest.mark.parametrize("name", SCANS)
def test_query_with_hot_groups(hot, con, name):
    assert compare(hot, con, FOLDER, name).startswith("ok")


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["source", "doc_id", "n_chars", "rank_no", "reads", "bytes"]
    assert df.count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())
