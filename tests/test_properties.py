"""Random data against plain loops, with and without hot groups."""

import random

import pytest
from pyspark.sql import functions as F

from candex.operators import lookups as J
from candex.operators import windows as W
from candex.operators.areas import active_area
from candex.operators.expand import paint_last, rle_encode, rle_expand
from candex.operators.folds import budget_greedy, layer_fold
from candex.operators.graph import follow_links
from candex.plans import ordered as O
from candex.plans.joins import explode_range


def groups(seed, sizes, low=0, high=50):
    rng = random.Random(seed)
    rows = []
    for k, n in sizes.items():
        for i in range(n):
            rows.append((k, i // 3, i, rng.choice([None, rng.randint(low, high)]), rng.random() < 0.3))
    rng.shuffle(rows)
    return rows


SCHEMA = "k STRING, a INT, b INT, v INT, f BOOLEAN"
SIZES = {"hot": 400, "warm": 60, "one": 1, None: 90}


@pytest.mark.parametrize("group_rows, order", [(10, ["a", "b"]), (75, ["-a", "b"]), (75, ["a", "-b"]), (1000, ["a", "b"])])
def test_scan_is_the_same_in_chunks(spark, group_rows, order):
    df = spark.createDataFrame(groups(1, SIZES), SCHEMA)
    steps = {
        "pos": O.position(), "n": O.group_count(), "run": O.running_sum("v"), "run_x": O.running_sum("v", False),
        "top": O.running_max("v"), "top_x": O.running_max("v", False), "last": O.running_last("v"),
        "last_x": O.running_last(F.when(F.col("f"), F.struct("v")), False), "nxt": O.next_value("v"),
        "prv": O.previous_value("v"), "cnt": O.running_count(F.col("f")), "lo": O.group_min("v"), "hi": O.group_max("v"),
        "all": O.group_sum("v"),
    }
    plain = O.Ordered(("k",), tuple(order), df).scan(**steps)
    split = O.ordered(df, ["k"], order, group_rows).scan(**steps)
    assert (split.hot is None) == (group_rows == 1000)
    columns = ["k", "a", "b", *steps]
    want = {tuple(map(str, r)) for r in plain.rows().select(columns).collect()}
    got = [tuple(map(str, r)) for r in split.rows().select(columns).collect()]
    assert len(got) == len(want) and set(got) == want
    # A filter between two scans keeps the chunks valid.
    a = plain.where(F.col("f")).scan(p=O.position(), q=O.next_value("b")).rows()
    b = split.where(F.col("f")).scan(p=O.position(), q=O.next_value("b")).rows()
    assert sorted(map(str, a.select("k", "b", "p", "q").collect())) == sorted(map(str, b.select("k", "b", "p", "q").collect()))


def test_scan_without_keys(spark):
    df = spark.createDataFrame(groups(2, {"x": 200}), SCHEMA)
    got = O.ordered(df, [], ["b"], 30).scan(pos=O.position(), prv=O.previous_value("b")).rows()
    assert sorted((r["pos"], r["b"], r["prv"]) for r in got.collect()) == [
        (i + 1, i, i - 1 if i else None) for i in range(200)
    ]


def test_first_rows_beyond_the_limit_threshold(hot):
    df = hot.createDataFrame(groups(3, {"x": 50, "y": 3}), SCHEMA)
    hot.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "5")
    try:
        got = O.first_rows(df, [F.upper("k")], ["b"], 7, "no")
        assert sorted((r["k"], r["b"], r["no"]) for r in got.collect()) == [
            *[("x", i, i + 1) for i in range(7)], *[("y", i, i + 1) for i in range(3)]
        ]
    finally:
        hot.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


@pytest.mark.parametrize("fold_rows, max_n", [(1000, 10**6), (5, 10**6), (5, 9)])
def test_budget_greedy_is_the_loop(spark, fold_rows, max_n):
    rows = [r for r in groups(4, {"p": 120, "q": 4, "r": 33}, 0, 60)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = []
    for key in "pqr":
        left, taken = 300, 0
        for _, _, b, v, _ in sorted((r for r in rows if r[0] == key), key=lambda r: r[2]):
            if v is not None and v <= left and taken < max_n:
                left, taken = left - v, taken + 1
                want.append((key, b))
    got = budget_greedy(df, ["k"], ["b"], "v", 300, max_n, fold_rows, group_rows=20)
    assert sorted((r["k"], r["b"]) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("group_rows", [None, 7])
def test_slices_sum_to_the_clipped_range(spark, group_rows):
    rng = random.Random(5)
    ext = [(f, i, rng.randint(0, 40), rng.choice([None, rng.randint(0, 999)])) for f in range(4) for i in range(rng.randint(0, 30))]
    req = [(f, n, rng.randint(0, 700), rng.randint(0, 300), 500) for f in range(4) for n in range(40)]
    extents = spark.createDataFrame(ext, "f INT, i INT, len BIGINT, sector BIGINT")
    requests = spark.createDataFrame(req, "f INT, r INT, off BIGINT, len BIGINT, size BIGINT")
    out = J.slice_extents(requests, extents, "f", "r", "off", "len", ["i"], "len", "sector", "size", group_rows)
    sums = {(r["f"], r["r"]): r["n"] for r in out.groupBy("f", "r").agg(F.sum(F.col("stop") - F.col("start")).alias("n")).collect()}
    for f, n, off, length, size in req:
        assert sums.get((f, n), 0) == max(0, min(off + length, size) - off)
    for r in out.where("address is not null").collect():
        start = 0
        for _, i, n, sector in sorted(e for e in ext if e[0] == r["f"]):
            if start <= r["start"] < start + n:
                assert r["address"] == sector + r["start"] - start and r["stop"] <= start + n
            start += n


@pytest.mark.parametrize("group_rows", [None, 9])
def test_entry_ranges_are_the_loop(spark, group_rows):
    rng = random.Random(6)
    entries = [(k, i, rng.randint(0, 2000)) for k in "ab" for i in range(60)]
    items = [(k, n, t, t + rng.randint(0, 300)) for k in "abc" for n in range(30) for t in [rng.randint(0, 2500)]]
    want = []
    for k, n, t0, t1 in items:
        mine = [(i, t) for e, i, t in entries if e == k]
        inside = [i for i, t in mine if max(t0 - 255, 0) <= t < t1]
        before = [i for i, t in mine if t <= t0]
        chosen = inside or before[-1:] or [i for i, _ in mine]
        want += [(k, n, i) for i in chosen]
    e = spark.createDataFrame(entries, "k STRING, i INT, t INT")
    it = spark.createDataFrame(items, "k STRING, item INT, t0 INT, t1 INT")
    got = J.interval_join_fallback(it, e, ["k"], "item", "t0", "t1", "t", ["i"], ["i"], group_rows=group_rows)
    assert sorted((r["k"], r["item"], r["i"]) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("group_rows", [None, 11])
def test_runs_round_trip(spark, group_rows):
    rng = random.Random(7)
    rows = [(k, i, rng.choice(["x", "y", None])) for k in "ab" for i in range(150)]
    df = spark.createDataFrame(rows, "k STRING, i INT, v STRING")
    runs = rle_encode(df, ["k"], ["i"], "v", group_rows)
    back = rle_expand(runs, ["k"], ["run_no"], "run", "value", group_rows=group_rows)
    assert sorted(map(str, back.collect())) == sorted(
        map(str, df.selectExpr("k", "cast(i as bigint) as cell", "v as value").collect())
    )


def test_explode_range_blocks(spark):
    df = spark.createDataFrame([(1, 0, 25), (2, 9, 11), (3, 5, 5), (4, 10, 20)], "id INT, lo INT, hi INT")
    got = explode_range(df, F.col("lo"), F.col("hi"), "c", block=10)
    assert sorted((r["id"], r["c"]) for r in got.collect()) == [
        *[(1, c) for c in range(25)], (2, 9), (2, 10), *[(4, c) for c in range(10, 20)]
    ]


def test_paint_last_is_the_loop(spark):
    rng = random.Random(8)
    rows = [("k", s, s + rng.randint(0, 9), no, rng.randint(0, 99)) for no in range(40) for s in [rng.randint(0, 50)]]
    want = {}
    for _, s, e, _, v in rows:
        want.update({c: v for c in range(s, e)})
    df = spark.createDataFrame(rows, "k STRING, s INT, e INT, no INT, v INT")
    assert {r["cell"]: r["value"] for r in paint_last(df, ["k"], "s", "e", "no", "v").collect()} == want


def test_layer_fold_is_the_loop(spark):
    rng = random.Random(9)
    rows = [(k, i, rng.randint(0, 255), rng.choice([0, 255, rng.randint(0, 255)])) for k in range(30) for i in range(12)]

    def over(u, t):
        (uy, ua), (ty, ta) = u, t
        if ta == 255 or ua == 0:
            return t
        below = ua * (255 - ta) // 255
        a = ta + below
        return ((ty * ta + uy * below + a // 2) // a, a)

    want = {}
    for k, _, y, a in rows:
        want[k] = over(want.get(k, (0, 0)), (y, a))
    df = spark.createDataFrame(rows, "k INT, i INT, y INT, a INT")
    assert {r["k"]: (r["y"], r["a"]) for r in layer_fold(df, ["k"], ["i"], ["y"], "a").collect()} == want


def test_edge_trim_is_the_loop(spark):
    rng = random.Random(10)
    data = {k: [rng.random() < p for _ in range(n)] for k, (n, p) in enumerate([(3, 0.9), (40, 0.97), (300, 0.99), (8, 1.0), (90, 0.98), (64, 0.95)])}
    want = set()
    for k, flat in data.items():
        n, cap = len(flat), len(flat) // 4
        a = next((i for i in range(cap) if not flat[i]), cap)
        b = next((i for i in range(cap) if not flat[n - 1 - i]), cap)
        if n < 4 or (a >= cap and b >= cap):
            a = b = 0
        elif a >= cap or b >= cap or abs(a - b) > max(n // 60, 4):
            a = b = min(a, b)
        end = n if b == 0 else min((n - b + 1) & ~1, n)
        want |= {(k, i) for i in range(a & ~1, end)}
    rows = [(k, i, f) for k, flat in data.items() for i, f in enumerate(flat)]
    for group_rows in (None, 20):
        df = spark.createDataFrame(rows, "k INT, i INT, f BOOLEAN")
        assert {(r["k"], r["i"]) for r in W.edge_trim(df, ["k"], ["i"], "f", group_rows=group_rows).collect()} == want


def test_active_area_is_the_loop(spark):
    rng = random.Random(6)

    def dark(values):
        n, s, q = len(values), sum(values), sum(x * x for x in values)
        return n > 0 and s <= 26 * n and n * q - s * s <= 36 * n * n

    def pair(flags):
        n, cap = len(flags), len(flags) // 4
        a = next((i for i in range(cap) if not flags[i]), cap)
        b = next((i for i in range(cap) if not flags[n - 1 - i]), cap)
        if a >= cap and b >= cap:
            return 0, 0
        return (min(a, b),) * 2 if a >= cap or b >= cap or abs(a - b) > max(n // 60, 4) else (a, b)

    def line(values):
        return dark(values[:: 4 if len(values) >= 256 else 2])

    def area(grid):
        h, w = len(grid), len(grid[0])
        full = (0, 0, h, w, False)
        if h < 4 or w < 4:
            return full
        top, bottom = pair([line(x) for x in grid])
        left, right = pair([line(list(x)) for x in zip(*grid[top:h - bottom])])
        if top + bottom + left + right == 0:
            return full
        y0, x0 = top & ~1, left & ~1
        y1, x1 = (n if not cut else min(n - cut + 1 & ~1, n) for n, cut in ((h, bottom), (w, right)))
        step = 1 if (y1 - y0) * (x1 - x0) <= 16384 else 2
        if dark([v for x in grid[y0:y1:step] for v in x[x0:x1:step]]):
            return full
        return y0, x0, y1 - y0, x1 - x0, True

    def picture(h, w, top, bottom, left, right, light):
        return [[light(y, x) if top <= y < h - bottom and left <= x < w - right else rng.randrange(14, 19) for x in range(w)] for y in range(h)]

    bright = lambda y, x: rng.randrange(40, 200)
    grids = {
        "both": picture(48, 60, 5, 6, 3, 4, bright), "odd": picture(33, 41, 3, 0, 0, 5, bright), "thick": picture(40, 40, 10, 10, 2, 2, bright),
        "one thick": picture(40, 60, 10, 3, 14, 2, bright), "uneven": picture(60, 44, 2, 9, 0, 0, bright), "none": picture(20, 20, 0, 0, 0, 0, bright),
        "dark": picture(40, 40, 6, 6, 4, 4, lambda y, x: 17), "spot": picture(40, 40, 6, 6, 4, 4, lambda y, x: 17 + 30 * (y % 8 == x % 8 == 0)),
        "thin": picture(3, 30, 0, 0, 5, 5, bright), "narrow": picture(30, 3, 5, 5, 0, 0, bright), "long": picture(130, 280, 9, 11, 21, 24, bright), None: picture(24, 24, 2, 2, 2, 2, bright),
    }
    # Places are counted from the smallest ones, wherever they are.
    rows = [(k, y - 7, x + 5, v) for k, grid in grids.items() for y, line_ in enumerate(grid) for x, v in enumerate(line_)]
    rng.shuffle(rows)
    got = active_area(spark.createDataFrame(rows, "k STRING, y INT, x INT, v INT"), ["k"], "y", "x", "v").collect()
    assert {r["k"]: tuple(r)[1:] for r in got} == {k: area(grid) for k, grid in grids.items()}
    empty = spark.createDataFrame([], "k STRING, y INT, x INT, v INT")
    assert active_area(empty, ["k"], "y", "x", "v").isEmpty()


def test_follow_links_is_the_depth_first_search(spark):
    """With a depth limit that does not bind: visited nodes are not retried, the first terminal wins."""
    rng = random.Random(11)
    n = 9
    ends = {2, 7}
    links = {i: rng.sample(range(n), rng.randint(0, 3)) for i in range(n)}

    def search(at, seen):
        if at in ends:
            return at
        seen.add(at)
        for t in links[at]:
            if t not in seen:
                hit = search(t, seen)
                if hit is not None:
                    return hit
        return None

    nodes = spark.createDataFrame([(i, i if i in ends else None) for i in range(n)], "id INT, term INT")
    edges = spark.createDataFrame([(i, o, t) for i, ts in links.items() for o, t in enumerate(ts)], "id INT, o INT, t INT")
    got = {r["id"]: r["found"] for r in follow_links(nodes, edges, "id", "term", "o", "t", n).collect()}
    assert got == {i: search(i, set()) for i in range(n) if search(i, set()) is not None}
