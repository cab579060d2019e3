"""What large tables do not pay for: maps of stacks a task can fold, ranks of nodes that lead nowhere, columns nobody reads."""

import random


from candex.catalog import QUERIES, flagship
from candex.operators import folds, graph
from candex.plans import limits

FOLDER = "/root/testdata/sf0.001"


def test_stacks_a_task_can_hold_need_no_maps(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, i, rng.randrange(256), rng.choice([0, 255, rng.randrange(256)])) for k, n in (("a", 40), (None, 7), ("c", 2)) for i in range(n)]
    table = limits.pin(spark.createDataFrame(rows, "k string, i int, y int, a int"))
    found = {long: sorted(map(tuple, folds.layer_fold(table, ["k"], ["i"], ["y"], "a", fold_rows=long).collect()), key=str) for long in (100, 2)}
    assert found[2] == found[100] and len(found[2]) == 3

    def maps(*args):
        raise AssertionError("maps for short stacks")

    monkeypatch.setattr(folds, "_table_fold", maps)
    assert sorted(map(tuple, folds.layer_fold(table, ["k"], ["i"], ["y"], "a", fold_rows=2).collect()), key=str) == found[100]


def test_nodes_without_links_are_not_ranked(spark, monkeypatch):
    ranked, scan = [], graph.ordered

    def counted(df, keys, order, group_rows=None):
        if "_upper" in order:
            ranked.append(df.count())
        return scan(df, keys, order, group_rows)

    monkeypatch.setattr(graph, "ordered", counted)
    edges = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b"), *[("a", i, f"x{i}") for i in range(30)]], "node string, o int, t string")
    emits = spark.createDataFrame([("x7", 0, "v"), ("b", 0, "w")], "node string, o int, v string")
    roots = spark.createDataFrame([("r",)], "node string")
    found = graph.reachable_emits(roots, edges, emits, "node", "o", "t", "v")
    assert sorted(map(tuple, found.collect())) == [("r", "v", 1), ("r", "w", 2)] and ranked == [1, 1]


def test_the_search_sorts_what_it_reads(spark, monkeypatch):
    seen, rank = [], flagship.rank_candidates
    monkeypatch.setattr(flagship, "rank_candidates", lambda df, *rest: seen.append(set(df.columns)) or rank(df, *rest))
    assert QUERIES["q2_group_search"](spark, FOLDER).count() > 0
    assert not seen[0] & {"l_returnflag", "l_linestatus", "o_orderpriority"}
