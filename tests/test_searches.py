"""Staged searches, chains, painted intervals, tall stacks and translated extents on small tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from candex.operators.chains import chain_rows, chained_extents, rank_list
from candex.operators.expand import _dyadic, paint_last, paint_runs
from candex.operators.folds import layer_fold
from candex.operators.graph import follow_links
from candex.operators.lookups import translate_extents
from candex.plans import limits
from candex.plans.stages import Stage, run_stages


def stage(spark, name, rows, asked, **more):
    def give(keys):
        asked.append((name, sorted(r[0] for r in keys.collect() if r[0] is not None)))
        return spark.createDataFrame(rows, "id long, pos int, v string")

    return Stage(name, give, **more)


def test_a_stage_behind_the_last_open_key_is_never_planned(spark):
    asked = []
    stages = [
        stage(spark, "a", [(1, 2, "a2"), (1, 1, "a1"), (9, 1, "no")], asked),
        stage(spark, "b", [(1, 1, "b1"), (2, 1, "b2"), (3, 5, "b3")], asked),
        stage(spark, "c", [(1, 1, "c")], asked),
    ]
    wanted = spark.createDataFrame([(1,), (2,), (3,), (3,)], "id long")
    found, left, reports = run_stages(wanted, ["id"], stages, ["pos"])
    assert sorted(map(tuple, found.collect())) == [(1, 1, "a1", 1), (2, 1, "b2", 2), (3, 5, "b3", 2)]
    assert asked == [("a", [1, 2, 3]), ("b", [2, 3])] and left.isEmpty()
    assert [(r.name, r.wanted, r.resolved, r.ran) for r in reports] == [("a", 3, 1, True), ("b", 2, 2, True), ("c", 0, 0, False)]


def test_jobs_stop_with_the_last_key(spark):
    def jobs(n):
        group = f"stages-{n}"
        spark.sparkContext.setJobGroup(group, group)
        full = Stage("full", lambda keys: spark.range(10).select("id", F.lit(1).alias("pos")))
        run_stages(spark.range(10), ["id"], [full] * n, ["pos"])
        done = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return done

    assert jobs(1) == jobs(6)


def test_costly_stages_leave_out_what_was_searched(spark):
    asked = []
    stages = [stage(spark, "dear", [(1, 1, "d"), (2, 1, "d")], asked, costly=True), stage(spark, "last", [(1, 1, "l"), (None, 1, "n")], asked)]
    wanted = spark.createDataFrame([(1,), (2,), (None,), (4,)], "id long")
    searched = spark.createDataFrame([(1,)], "id long")
    found, left, _ = run_stages(wanted, ["id"], stages, ["pos"], searched)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(2, 1, "d", 1), (1, 1, "l", 2), (None, 1, "n", 2)], key=str)
    assert [r.id for r in left.collect()] == [4]


def test_no_wanted_keys_no_stage(spark):
    found, left, reports = run_stages(spark.range(0), ["id"], [Stage("a", lambda keys: spark.range(5))] * 2, ["id"])
    assert found.count() == 0 and found.columns == ["id", "stage"] and not any(r.ran for r in reports) and left.isEmpty()


def test_open_keys_reach_the_scan(spark, tmp_path, capsys):
    spark.range(1000).withColumn("pos", F.lit(1)).write.parquet(f"{tmp_path}/t")
    plans = []

    def late(keys):
        rows = spark.read.parquet(f"{tmp_path}/t")
        plans.append(rows)
        return rows

    first = Stage("first", lambda keys: spark.range(0, 990).withColumn("pos", F.lit(0)))
    found, _, _ = run_stages(spark.range(1000), ["id"], [first, Stage("late", late)], ["pos"])
    assert found.where("stage = 2").count() == 10 and len(plans) == 1
    from candex.plans.stages import within

    within(plans[0], limits.pin(spark.range(990, 1000)), ["id"]).explain()
    assert "GreaterThanOrEqual(id,990)" in capsys.readouterr().out


def linked(spark, links, weight=lambda n: 10 * n):
    return spark.createDataFrame([(a, b, weight(a)) for a, b in links], "n long, after long, w long")


def test_ranks_cycles_and_missing_ends(spark):
    nodes = linked(spark, [(1, 2), (2, 3), (3, None), (4, 2), (5, 6), (6, 5), (7, 5), (8, 99), (9, 9)])
    found = {r.n: (r.end, r.hops, r.total, r.status) for r in rank_list(nodes, "n", "after", "w").collect()}
    cycle = (None, None, None, "cycle")
    assert found == {
        1: (3, 2, 60, "end"), 2: (3, 1, 50, "end"), 3: (3, 0, 30, "end"), 4: (3, 2, 90, "end"), 5: cycle, 6: cycle, 7: cycle,
        8: (8, 0, 80, "missing"), 9: cycle,
    }
    assert rank_list(nodes.limit(0), "n", "after", "w").collect() == []


def test_a_long_chain_takes_log_rounds(spark, monkeypatch):
    written = []
    pin = limits.pin
    monkeypatch.setattr(limits, "pin", lambda df: written.append(1) or pin(df))
    n = 100_000
    nodes = spark.range(n).select(F.col("id").alias("n"), F.when(F.col("id") < n - 1, F.col("id") + 1).alias("after"), F.lit(2).cast("long").alias("w"))
    found = rank_list(nodes, "n", "after", "w")
    assert found.where(f"hops <> {n - 1} - n OR total <> 2 * ({n} - n) OR status <> 'end'").count() == 0
    assert len(written) <= 18


@pytest.fixture()
def written(monkeypatch):
    """Rows of each written table."""
    rows, pin = [], limits.pin

    def counted(df):
        out = pin(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(limits, "pin", counted)
    return rows


def test_contracted_lists_have_the_same_ranks(spark):
    rng = random.Random(5)
    links = [(n, rng.choice([None, 7, 999, rng.randrange(300), *[n + 1] * 40])) for n in range(300)]
    links += [(n, n + 1 if n < 449 else 400) for n in range(400, 450)] + [(n, n + 1 if n < 479 else 420) for n in range(460, 480)]
    nodes = limits.pin(linked(spark, links, lambda n: n % 5))
    found = {short: sorted(map(tuple, rank_list(nodes, "n", "after", "w", short).collect()), key=str) for short in (1000, 20)}
    assert found[20] == found[1000] and len(found[20]) == 370 and {r[4] for r in found[20]} == {"end", "missing", "cycle"}


def test_ranks_write_each_node_a_few_times(spark, written):
    n = 20_000
    nodes = spark.range(n).select(F.col("id").alias("n"), F.when(F.col("id") < n - 1, F.col("id") + 1).alias("after"), F.lit(2).cast("long").alias("w"))
    found = rank_list(nodes, "n", "after", "w", 500)
    assert found.where(f"hops <> {n - 1} - n OR total <> 2 * ({n} - n) OR status <> 'end'").count() == 0
    assert found.count() == n and sum(written) < 8 * n


@pytest.mark.parametrize("seed", [1, 2])
def test_chain_rows_with_shared_tails(spark, seed):
    rng = random.Random(seed)
    after = {n: rng.choice([None, *range(n + 1, min(n + 4, 40))]) if n < 39 else None for n in range(40)}
    after |= {50: 51, 51: 50, 60: 999}
    heads = [*range(0, 40, 3), 50, 60, 1000]
    table = spark.createDataFrame([(f"f{h}", h) for h in heads], "file string, head long")
    nodes = linked(spark, list(after.items()), lambda n: n + 1)
    found = chain_rows(table, nodes, ["file"], "head", "n", "after", "w", max_links=12)
    expected = []
    for h in heads:
        path, n = [], h
        while n in after and len(path) < 100:
            path.append(n)
            n = after[n]
        status = "cycle" if len(path) == 100 else "end" if path and n is None else "missing"
        if len(path) > 13 and status == "end":
            status = "too long"
        if not path or status in ("cycle", "too long"):
            expected.append((f"f{h}", None, None, None, status))
            continue
        for place, n in enumerate(path):
            expected.append((f"f{h}", n, place, sum(x + 1 for x in path[:place]), status))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


def test_rows_of_heads_that_share_a_chain_are_not_written(spark, written):
    n = 1500
    nodes = limits.pin(linked(spark, [(i, i + 1 if i < n - 1 else None) for i in range(n)], lambda i: 1))
    heads = spark.range(0, n, 10).select(F.concat(F.lit("f"), "id").alias("file"), F.col("id").alias("head"))
    found = chain_rows(heads, nodes, ["file"], "head", "n", "after", "w")
    assert found.where("place <> start OR file <> concat('f', n - place)").isEmpty()
    assert found.count() == sum(n - h for h in range(0, n, 10)) and sum(written) < 20 * n


def test_extents_of_linked_blocks(spark):
    rows = [
        ("a", 1, 5, None, "x"), ("a", 2, 7, None, "y"), ("a", 3, 1, "b", "link"), ("a", 4, 100, None, "after the link"),
        ("b", 1, 3, None, "z"), ("b", 2, 0, None, "end"), ("b", 3, 9, "a", "after the end"), ("c", 1, 4, "c", "self"), ("d", 1, None, None, "empty"),
    ]
    table = spark.createDataFrame(rows, "block string, ord int, len long, goal string, tag string")
    files = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "nowhere"), (5, "d")], "file int, head string")
    found = chained_extents(files, table, ["file"], "head", "block", ["ord"], "len", "goal")
    out = sorted(((r.file, r.place, r.start, r.stop, r.status, r.tag) for r in found.collect()), key=str)
    assert out == sorted(
        [
            (1, 0, 0, 5, "end", "x"), (1, 0, 5, 12, "end", "y"), (1, 1, 12, 15, "end", "z"), (2, 0, 0, 3, "end", "z"),
            (3, None, None, None, "cycle", None), (4, None, None, None, "missing", None),
        ], key=str,
    )


def test_links_without_a_depth_and_what_a_depth_gives_up(spark):
    nodes = spark.createDataFrame([(i, "end" if i == 7 else None) for i in range(9)], "n long, term string")
    links = spark.createDataFrame([(i, 1, i + 1) for i in range(7)] + [(8, 1, 8)], "n long, o int, t long")
    found = {r.n: (r.found, r.hops) for r in follow_links(nodes, links, "n", "term", "o", "t").collect()}
    assert found == {i: ("end", 7 - i) for i in range(8)}
    found = {r.n: r.found for r in follow_links(nodes, links, "n", "term", "o", "t", 4, given_up=True).collect()}
    assert found == {0: None, 1: None, 2: None, **{i: "end" for i in range(3, 8)}}


@pytest.mark.parametrize("seed", range(4))
def test_painting_against_cells(spark, seed):
    rng = random.Random(seed)
    rows = []
    for no in range(60):
        start = rng.randrange(-40, 60)
        rows.append((rng.choice(["a", "b", None]), start, start + rng.choice([0, -3, 1, 2, 7, 30]), no, rng.choice(["x", "y", None])))
    rows += [("c", None, 5, 1, "x"), ("c", 5, None, 2, "x")]
    table = spark.createDataFrame(rows, "k string, a long, b long, no int, v string")
    cells = {}
    for k, a, b, _, v in rows:
        if a is not None and b is not None:
            cells.update({(k, c): v for c in range(a, b)})
    runs = {}
    for r in paint_runs(table, ["k"], "a", "b", "no", "v").collect():
        assert r.start < r.stop and (r.k, r.start) not in runs
        runs.update({(r.k, c): r.value for c in range(r.start, r.stop)})
        assert cells.get((r.k, r.stop), "none") != r.value and cells.get((r.k, r.start - 1), "none") != r.value
    assert runs == cells
    assert {(r.k, r.cell): r.value for r in paint_last(table, ["k"], "a", "b", "no", "v").collect()} == cells


def test_nodes_of_an_interval_grow_with_its_logarithm(spark):
    rng = random.Random(9)
    rows = [(a, a + rng.randrange(1, 2**k)) for k in range(1, 60) for a in [rng.randrange(-(2**40), 2**40)]]
    table = spark.createDataFrame(rows, "a long, b long")
    for r in table.withColumn("nodes", _dyadic("a", "b")).collect():
        assert len(r.nodes) <= 2 * (r.b - r.a).bit_length()
        covered = sorted((n.place << n.level, (n.place + 1) << n.level) for n in r.nodes)
        assert covered[0][0] == r.a and covered[-1][1] == r.b
        assert all(x[1] == y[0] for x, y in zip(covered, covered[1:], strict=False))


def test_long_intervals_need_few_rows(spark):
    table = spark.createDataFrame([("k", 0, 10**15, 1, "sea"), ("k", 10**9, 2 * 10**9, 2, "land")], "k string, a long, b long, no int, v string")
    found = paint_runs(table, ["k"], "a", "b", "no", "v").orderBy("start").collect()
    assert [tuple(r) for r in found] == [("k", 0, 10**9, "sea"), ("k", 10**9, 2 * 10**9, "land"), ("k", 2 * 10**9, 10**15, "sea")]


def drawn(layers):
    y, a = 0, 0
    for v, ta in layers:
        if ta == 255 or a == 0:
            y, a = v, ta
        else:
            below = a * (255 - ta) // 255
            y, a = (v * ta + y * below + (ta + below) // 2) // (ta + below), ta + below
    return y, a


def test_tall_stacks_equal_the_loop(spark):
    rng = random.Random(3)
    groups = {"tall": [(rng.randrange(256), rng.randrange(255)) for _ in range(5000)], "thin": [(rng.randrange(256), rng.choice([0, 0, 1, 2])) for _ in range(3000)],
              "clear": [(9, 0)] * 100, "short": [(7, 100), (200, 30)], None: [(rng.randrange(256), 3) for _ in range(50)]}
    rows = [(k, i, v, a) for k, layers in groups.items() for i, (v, a) in enumerate(layers)]
    table = spark.createDataFrame(rows, "k string, i int, y long, a long")
    for fold_rows in (20_000, 700, 16):
        found = {r.k: (r.y, r.a, r.layers) for r in layer_fold(table, ["k"], ["i"], ["y"], "a", fold_rows=fold_rows).collect()}
        assert found == {k: (*drawn(layers), len(layers)) for k, layers in groups.items()}


def test_a_million_layers_take_as_many_writes_as_ten_thousand(spark, monkeypatch):
    pin, written = limits.pin, []
    monkeypatch.setattr(limits, "pin", lambda df: written.append(1) or pin(df))

    def fold(n):
        written.clear()
        stack = spark.range(n).select(F.lit(1).alias("k"), "id", (F.col("id") * 31 % 256).alias("y"), (F.col("id") * 17 % 254).alias("a"))
        return layer_fold(stack, ["k"], ["id"], ["y"], "a", fold_rows=5000).first(), len(written)

    million, writes = fold(1_000_000)
    assert fold(10_000)[1] == writes
    assert (million.y, million.a) == drawn((i * 31 % 256, i * 17 % 254) for i in range(1_000_000))


def test_tall_stacks_reject_what_is_no_byte(spark):
    table = spark.range(50).select(F.lit(1).alias("k"), "id", F.lit(300).alias("y"), F.lit(10).alias("a"))
    with pytest.raises(Exception, match="0..255"):
        layer_fold(table, ["k"], ["id"], ["y"], "a", fold_rows=8).collect()


@pytest.mark.parametrize("seed", range(3))
def test_translated_extents_add_up(spark, seed):
    rng = random.Random(seed)
    ranges = [(rng.choice([1, 2]), rng.randrange(100), rng.choice([0, 3, 10, 40]), rng.choice([None, 1000, 5000])) for _ in range(12)]
    pieces = [(rng.choice([1, 2, 3]), i, rng.randrange(-10, 120), rng.choice([0, 1, 8, 60])) for i in range(25)] + [(1, 99, None, 5)]
    maps = spark.createDataFrame(ranges, "d int, first long, n long, goal long")
    table = spark.createDataFrame(pieces, "d int, id int, address long, len long")
    found = translate_extents(table, maps, ["id"], "address", "len", "first", "n", "goal", ["d"]).collect()
    cells, expected = {}, {}
    for r in found:
        for i in range(r.length):
            assert (r.id, r.start + i) not in cells
            cells[r.id, r.start + i] = (r.status, None if r.target is None else r.target + i)
    for d, i, address, length in pieces:
        for c in range(length) if address is not None else []:
            p = address + c
            best = max(((f, n, (g is not None, g or 0), g) for dd, f, n, g in ranges if dd == d and f <= p), default=None)
            if best is None or p - best[0] >= best[1]:
                expected[i, c] = ("outside", None)
            else:
                expected[i, c] = ("not recorded", None) if best[3] is None else ("ok", best[3] + p - best[0])
    assert cells == expected


def test_an_interval_is_one_row_however_long(spark, written):
    spark.conf.set("spark.candex.checkBytes", "0")
    try:
        rng = random.Random(3)
        rows = [(rng.choice([None, "a", "b"]), a := rng.randrange(2000), a + rng.randrange(1, 1500), no, rng.choice([None, 1, 2])) for no in range(400)]
        table = limits.pin(spark.createDataFrame(rows, "k string, a long, b long, no int, v int"))
        written.clear()
        found = {(r.k, r.cell): r.value for r in paint_last(table, ["k"], "a", "b", "no", "v").collect()}
    finally:
        spark.conf.unset("spark.candex.checkBytes")
    assert found == {(k, cell): v for k, a, b, _, v in rows for cell in range(a, b)} and sum(written) <= 2 * len(rows)
