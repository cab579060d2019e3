"""Small cases with known results."""

import random

import pytest
from pyspark.sql import functions as F

from candex.functions import names as N
from candex.functions import numbers as X
from candex.operators import aggregates as A
from candex.operators import filters as S
from candex.operators import graph as G
from candex.operators import lookups as J
from candex.operators import windows as W
from candex.operators.expand import best_positions, rle_expand
from candex.operators.folds import budget_greedy, layer_fold


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def one(spark, column, text="x"):
    return spark.createDataFrame([(text,)], "name STRING").select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "name, want",
    [
        ("MOVIE_640x360.jpg", (640, 360, 230400)),
        ("cover_416X240.JPG", (416, 240, 99840)),
        ("cover.jpg", (None, None, 0)),
        ("x.jpg", (None, None, 0)),
        ("0x1F.jpg", (None, None, 0)),
        ("0x5x7.jpg", (5, 7, 35)),
        ("99999999999999999999x2_3x4.jpg", (None, None, 0)),
        ("18446744073709551615x2.jpg", (18446744073709551615, 2, 0)),
        ("a" + "9" * 60 + "x1.jpg", (None, None, 0)),
    ],
)
def test_dims_from_name(spark, name, want):
    assert tuple(one(spark, N.dims_from_name("name"), name)) == want


@pytest.mark.parametrize(
    "name, stem, ext", [("a.JPG", "a", "JPG"), ("jpg", "jpg", ""), ("a.b.c", "a.b", "c"), (".x", "", "x"), ("x.", "x", "")]
)
def test_split_ext(spark, name, stem, ext):
    assert tuple(one(spark, N.split_ext("name"), name)) == (stem, ext)


def test_has_ext_and_stem(spark):
    for name, want in [("a.JPG", True), ("a.xml", False), ("jpg", False)]:
        assert one(spark, N.has_ext("name", N.IMAGE_EXTENSIONS), name) is want
    for name, want in [("Folder.jpg", True), ("folder2.jpg", False)]:
        assert one(spark, N.stem_in("name", ["folder", "cover"]), name) is want


@pytest.mark.parametrize(
    "name, want",
    [
        ("VTS_12_9.VOB", ("title", 12, 9)),
        ("video_ts.vob", ("manager", 0, 0)),
        ("VTS_00_1.VOB", None),
        ("VTS_1_1.VOB", None),
        ("VTS_01_10.VOB", None),
        ("00012.M2TS", ("clip", 12, 0)),
    ],
)
def test_classify_name(spark, name, want):
    got = one(spark, N.classify_name("name"), name)
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(
    "name, want", [("J00___5L.MP2", 0), ("j00___5m.mp2", 1), ("J00___5S.MP2", 2), ("J00___5X.MP2", 3), ("J00___5L.JPG", None)]
)
def test_size_rank(spark, name, want):
    assert one(spark, N.size_rank("name"), name) == want


def test_clean_name(spark):
    for name, want in [("A.TXT;1", "A.TXT"), ("DIR.", "DIR"), ("..", None), (";1", None), ("B..;12", "B")]:
        assert one(spark, N.clean_name("name"), name) == want


def test_sniff_with_versions(spark):
    kinds = [("list", "MPLS", ["0100", "0200"]), ("any", "MP")]
    for text, want in [("MPLS0200..", "list"), ("MPLS0900..", "any"), ("BM", "unknown")]:
        assert one(spark, N.sniff_signature("name", kinds), text) == want


def test_sniff_bytes(spark):
    kinds = [(b"\xff\xd8\xff\xe0", "jpeg"), (b"\x89PNG\r\n\x1a\n..", "png"), (b"GIF89a", "gif"), (b"BM6", "bmp"), (b"\xff\xd8", "unknown")]
    df = spark.createDataFrame([(bytearray(b), w) for b, w in kinds], "content BINARY, want STRING")
    assert df.where(N.sniff_signature("content") != F.col("want")).count() == 0


def test_byte_sum_counts_bytes_and_skips(spark):
    for text in ["abc", "é€", ""]:
        assert one(spark, N.byte_sum("name"), text) == sum(text.encode()) % 256
    assert one(spark, N.byte_sum("name", skip=1), "abc") == (97 + 99) % 256


def test_quality_band(spark):
    rows = [(90.0, 40.0), (17.0, 2.0), (25.0, 30.0), (234.0, 3.0), (120.0, 4.0), (None, None)]
    df = spark.createDataFrame(rows, "mean DOUBLE, sd DOUBLE")
    got = [r[0] for r in df.select(S.quality_band("mean", "sd")).collect()]
    assert got == [True, False, False, False, False, False]


def test_quarantine_first_rule_wins_and_null_passes(spark):
    df = spark.createDataFrame([(1,), (5,), (9,), (None,)], "v INT")
    good, bad = S.quarantine(df, [("a", "low", F.col("v") < 3), ("b", "not nine", F.col("v") != 9)])
    assert values(good, "v") == [(None,), (9,)]
    assert values(bad, "v") == [(1, "a", "low"), (5, "b", "not nine")]


def test_moments(spark):
    rows = [("a", v) for v in range(10, 90, 10)] + [("b", 60), ("b", 70), ("c", None), ("d", 3_000_000_000), ("e", -5)]
    got = {r["k"]: r for r in A.moments(spark.createDataFrame(rows, "k STRING, v BIGINT"), ["k"], "v").collect()}
    assert (got["a"]["mean"], round(got["a"]["stddev"], 6)) == (45.0, 22.912878)
    assert (got["b"]["mean"], got["b"]["stddev"]) == (65.0, 5.0)
    assert (got["c"]["n"], got["c"]["mean"], got["c"]["stddev"]) == (0, 0.0, 0.0)
    assert int(got["d"]["squares"]) == 9 * 10**18 and got["d"]["stddev"] == 0.0
    assert (int(got["e"]["total"]), int(got["e"]["squares"])) == (-5, 25)


def test_moments_are_exact_for_large_values(spark):
    rows = [("k", 3_000_000_000 - i * 7) for i in range(50)] + [("k", -2_999_999_999)]
    r = A.moments(spark.createDataFrame(rows, "k STRING, v BIGINT"), ["k"], "v").first()
    assert int(r["total"]) == sum(v for _, v in rows)
    assert int(r["squares"]) == sum(v * v for _, v in rows)


@pytest.mark.parametrize("limits, step", [((16384, 262144), 1), ((10, 1000), 2), ((10, 20), 4)])
def test_grid_moments_steps(spark, limits, step):
    cells = [("k", y + 3, x - 2, (y * 31 + x * 17) % 97) for y in range(9) for x in range(7)]
    df = spark.createDataFrame(cells, "k STRING, y INT, x INT, v INT")
    r = A.grid_moments(df, ["k"], "y", "x", "v", limits).first()
    want = [v for _, y, x, v in cells if (y - 3) % step == 0 and (x + 2) % step == 0]
    assert (r["step"], r["n"], int(r["total"])) == (step, len(want), sum(want))


def test_flat_lines(spark):
    lines = {1: [16] * 10, 2: [16] * 9 + [200], 3: [16, 200] * 5, 4: [27] * 10, 5: [16] * 300}
    rows = [("k", y, x, v) for y, vs in lines.items() for x, v in enumerate(vs)]
    df = A.flat_lines(spark.createDataFrame(rows, "k STRING, y INT, x INT, v INT"), ["k"], "y", "x", "v")
    # Every 2nd sample: line 2 ends on an unsampled place, line 3 shows only its dark half.
    assert [(r["y"], r["flat"], r["step"]) for r in df.orderBy("y").collect()] == [
        (1, True, 2), (2, True, 2), (3, True, 2), (4, False, 2), (5, True, 4)
    ]


def test_box_reduce(spark):
    cells = [("k", y, x, 20 if x % 2 == 0 else 40) for y in range(5) for x in range(7)]
    df = spark.createDataFrame(cells, "k STRING, y INT, x INT, v INT")
    got = values(A.box_reduce(df, ["k"], "y", "x", "v", 2), "box_row", "box_col")
    assert got == [("k", r, c, 30) for r in range(2) for c in range(3)]
    assert A.box_reduce(df, ["k"], "y", "x", "v", 9).count() == 0


def test_display_size_and_reduction(spark):
    def factor(w, h, side, n=1, d=1):
        return one(spark, X.reduction_factor(F.lit(w), F.lit(h), F.lit(side), F.lit(n), F.lit(d)))

    assert [factor(1920, 1080, s) for s in (256, 1024, 0)] == [3, 1, 540]
    assert (factor(720, 480, 213, 32, 27), factor(720, 480, 256, 32, 27)) == (2, 1)
    assert factor(1920, 4, 16, 4, 1) == 2
    assert tuple(one(spark, X.display_size(F.lit(100), F.lit(0), F.lit(9), F.lit(1)))) == (400, 1)
    assert tuple(one(spark, X.display_size(F.lit(100), F.lit(7), F.lit(0), F.lit(1)))) == (100, 7)


def test_ratio_reduce(spark):
    pairs = [(32, 27), (720, 480), (0, 5), (5, 0), (7540113804746346429, 4660046610375530309), (1, 2**62), (2**62, 6)]
    import math

    for a, b in pairs:
        g = math.gcd(a, b)
        want = (1, 1) if a == 0 or b == 0 else (a // g, b // g)
        assert tuple(one(spark, X.ratio_reduce(F.lit(a).cast("long"), F.lit(b).cast("long")))) == want


def test_checked_arithmetic(spark):
    big = (1 << 63) - 1
    cases = [(big, 1), (big, 0), (-big - 1, -1), (3, -4), (1 << 32, 1 << 31), (-(1 << 32), 1 << 31), (0, -big - 1), (big, -1)]
    for a, b in cases:
        x, y = F.lit(a).cast("long"), F.lit(b).cast("long")
        for got, want in [(one(spark, X.checked_sum(x, y)), a + b), (one(spark, X.checked_product(x, y)), a * b)]:
            fits = -(1 << 63) <= want < 1 << 63
            assert tuple(got) == ((want, "ok") if fits else (None, "overflow")), (a, b)


@pytest.mark.parametrize(
    "lead, trail, want", [(60, 60, (61, 420)), (60, 30, (31, 450)), (150, 150, (1, 480)), (100, 0, (1, 480)), (61, 61, (61, 420))]
)
def test_edge_trim(spark, lead, trail, want):
    rows = [("k", i, i <= lead or i > 480 - trail) for i in range(1, 481)]
    df = W.edge_trim(spark.createDataFrame(rows, "k STRING, i INT, flat BOOLEAN"), ["k"], ["i"], "flat")
    got = df.agg(F.min("i"), F.max("i"), F.count("i")).first()
    assert tuple(got) == (*want, want[1] - want[0] + 1)


def test_edge_trim_keeps_a_dark_middle(spark):
    rows = [("k", i, i <= 10 or i > 70, 8, 8 * 16, 8 * 256) for i in range(1, 81)]
    df = spark.createDataFrame(rows, "k STRING, i INT, flat BOOLEAN, n BIGINT, s BIGINT, q BIGINT")
    assert W.edge_trim(df, ["k"], ["i"], "flat").count() == 60
    assert W.edge_trim(df, ["k"], ["i"], "flat", moments=["n", "s", "q"]).count() == 80


def test_nested_quota(spark):
    rows = [("g", a, i) for a in (1, 2) for i in range(5)]
    df = spark.createDataFrame(rows, "g STRING, attempt INT, i INT")
    got = W.nested_quota(df, ["g"], ["attempt"], ["attempt", "i"], 3, 4)
    assert values(got, "attempt", "i") == [("g", 1, 0), ("g", 1, 1), ("g", 1, 2), ("g", 2, 0)]


def test_sampling_then_first_acceptable(spark):
    entries = spark.createDataFrame([("clip", i, 20.0 if i < 6 else 90.0, 5.0 + i) for i in range(20)],
                                    "clip STRING, i INT, mean DOUBLE, sd DOUBLE")
    tried = W.permille_sample(entries, ["clip"], ["i"])
    assert [r["i"] for r in tried.orderBy("try_no").collect()] == [4, 7, 2, 10, 13]
    best = W.first_acceptable_else_best(tried, ["clip"], ["try_no"], S.quality_band("mean", "sd"), "sd")
    assert best.select("permille", "i").first() == (400, 7)


def test_permille_sample_counts_a_row_once(spark):
    df = spark.createDataFrame([("k", 1), ("k", 2)], "k STRING, i INT")
    assert [(r["i"], r["permille"]) for r in W.permille_sample(df, ["k"], ["i"]).collect()] == [(1, 250)]


def test_selection_prefers_detail_then_the_earliest(spark):
    df = spark.createDataFrame([("k", 1, 3.0), ("k", 2, 9.0), ("k", 3, 9.0), ("k", 4, None)], "k STRING, i INT, sd DOUBLE")
    assert W.first_acceptable_else_best(df, ["k"], ["i"], F.lit(False), "sd").first()["i"] == 2


def test_top_groups(spark):
    df = spark.createDataFrame([("a", 4), ("b", 12), ("c", 2), ("d", 12)], "clip STRING, size INT")
    got = [r["clip"] for r in A.top_groups(df, ["clip"], "size", 3, minimum=3).orderBy("clip").collect()]
    assert got == ["a", "b", "d"]


def test_group_parts(spark):
    rows = [(1, 0, 7, 1), (1, 2, 5, 2), (1, 1, 6, 3), (1, 2, 9, 4), (1, 3, 0, 5), (1, 12, 4, 6), (2, 1, None, 7)]
    got = A.group_parts(spark.createDataFrame(rows, "s INT, part INT, size INT, pos INT"), ["s"], "part", "size", ["pos"])
    got = {r["s"]: r for r in got.collect()}
    assert (got[1]["menu_size"], [tuple(p) for p in got[1]["parts"]], got[1]["total"]) == (7, [(1, 6), (2, 5), (12, 4)], 15)
    assert (got[2]["menu_size"], got[2]["parts"], got[2]["total"]) == (None, [], 0)


def _reassembled(spark, rows, mode, **more):
    df = spark.createDataFrame(rows, "k STRING, i INT, f BOOLEAN, l BOOLEAN, t STRING")
    out = A.reassemble(df, ["k"], ["i"], "f", "l", "t", mode, **more)
    return [(r["fragment"], r["text"], r["complete"]) for r in out.orderBy("fragment").collect()]


PARTS = [
    ("k", 1, False, False, "lost"), ("k", 2, True, False, "a"), ("k", 3, False, True, "b"), ("k", 4, False, False, "late"),
    ("k", 5, True, False, "c"), ("k", 6, False, False, "d"), ("k", 7, True, True, "e"), ("k", 8, True, False, "f"),
]


def test_reassemble_modes(spark):
    assert _reassembled(spark, PARTS, "close") == [(1, "ab", True), (2, "cd", False), (3, "e", True), (4, "f", False)]
    assert _reassembled(spark, PARTS, "replace") == [(4, "f", False)]
    assert _reassembled(spark, PARTS, "stop") == [(1, "ab", True)]


def test_reassemble_flags_oversized(spark):
    rows = [("k", 1, True, False, "abc"), ("k", 2, False, True, "def"), ("k", 3, True, True, "x")]
    assert _reassembled(spark, rows, "close", max_length=5) == [(1, None, False), (2, "x", True)]
    assert _reassembled(spark, rows, "close", max_length=6) == [(1, "abcdef", True), (2, "x", True)]
    assert _reassembled(spark, rows, "close", max_length=6, separator="-") == [(1, None, False), (2, "x", True)]


def test_reassemble_stated_length_and_broken_rows(spark):
    rows = [
        ("k", 1, True, "abc", 5, False), ("k", 2, False, "defg", None, False), ("k", 3, False, "late", None, False),
        ("k", 4, True, "hi", 9, False), ("k", 5, False, "jk", None, True), ("k", 6, False, "lm", None, False),
        ("k", 7, True, "no", 0, True), ("k", 8, True, "q" * 50, 2, False), ("k", 9, True, "r" * 50, 0, False),
    ]
    df = spark.createDataFrame(rows, "k STRING, i INT, f BOOLEAN, t STRING, n INT, bad BOOLEAN").withColumn("l", F.lit(False))
    for group_rows in (None, 3):
        out = A.reassemble(df, ["k"], ["i"], "f", "l", "t", max_length=20, stated="n", broken="bad", group_rows=group_rows)
        got = [(r["fragment"], r["text"], r["complete"]) for r in out.orderBy("fragment").collect()]
        assert got == [(1, "abcde", True), (2, "hi", False), (3, "qq", True), (4, None, False)]


def test_chunk_coverage(spark):
    df = spark.createDataFrame([("k", 0, 100), ("k", 90, 20), ("k", 250, 100), ("k", 10, 0), ("k", 99, 2)], "k STRING, o INT, n INT")
    # Chunks of 100: 0, 0-1, 0-1; one direct read of 100 at 250 and one of 100 at 0.
    assert A.chunk_coverage(df, ["k"], "o", "n", 100).first() == ("k", 2, 2, 200, 400)
    sizes = spark.createDataFrame([("k", 130)], "k STRING, size INT")
    assert A.chunk_coverage(df, ["k"], "o", "n", 100, sizes).first() == ("k", 2, 2, 200, 330)


def _slices(spark, requests):
    s = 2048
    extents = [(1, 1, 2 * s, 60), (1, 2, s, None), (1, 3, 2 * s, 70), (1, 4, s, None), (1, 5, 1000, 75)]
    ext = spark.createDataFrame(extents, "f INT, i INT, len BIGINT, sector BIGINT").withColumn("sector", F.col("sector") * s)
    size = 6 * s + 1000 + 500
    req = spark.createDataFrame([(1, n, o, length, size) for n, (o, length) in enumerate(requests)],
                                "f INT, r INT, off BIGINT, len BIGINT, size BIGINT")
    return J.slice_extents(req, ext, "f", "r", "off", "len", ["i"], "len", "sector", "size"), extents, size


def test_slice_extents_follows_holes_and_tail(spark):
    s = 2048
    size = 6 * s + 1500
    requests = [(0, 100), (1, 4095), (4000, 200), (6000, 5000), (11000, 300), (12288, 1000), (13000, 500), (0, size),
                (0, size + 100), (size - 10, 100), (size, 10), (size + 5, 10), (100, 0), (4096, 2048)]
    out, extents, size = _slices(spark, requests)
    # Address of each byte of the file; None reads as zero.
    want = []
    for _, _, n, sector in extents:
        want += [None if sector is None else sector * s + k for k in range(n)]
    want += [None] * 500
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r["r"], r["start"])):
        assert r["stop"] > r["start"] and r["hole"] == (r["address"] is None)
        at = got.setdefault(r["r"], [])
        assert r["start"] == requests[r["r"]][0] + len(at)
        at += [None if r["hole"] else r["address"] + k for k in range(r["stop"] - r["start"])]
    for n, (o, length) in enumerate(requests):
        assert got.get(n, []) == want[o : min(o + length, size)], requests[n]


def test_range_lookup(spark):
    ranges = spark.createDataFrame([(10, 5, 100), (15, 5, None), (30, 2, 300)], "first INT, blocks INT, target INT")
    points = spark.createDataFrame([(p,) for p in (9, 10, 14, 15, 20, 31, 32)], "p INT")
    got = values(J.range_lookup(points, ranges, "p", "first", "blocks", "target"), "p")
    assert got == [
        (9, "outside", None), (10, "ok", 100), (14, "ok", 104), (15, "not recorded", None), (20, "outside", None),
        (31, "ok", 301), (32, "outside", None),
    ]


def test_asof_takes_the_last_in_stream_order(spark):
    right = spark.createDataFrame([("c", 1, 50), ("c", 2, 10), ("c", 3, 30), ("c", 4, 90)], "c STRING, i INT, t INT")
    left = spark.createDataFrame([("c", n) for n in (5, 10, 55, 100)], "c STRING, at INT")
    got = values(J.asof_backward(left, right, ["c"], "at", "t", ["i"], ["i"]), "at")
    # At 55 the entries at 50, 10 and 30 qualify; the one at 30 comes last in the stream.
    assert got == [("c", 5, None), ("c", 10, 2), ("c", 55, 3), ("c", 100, 4)]


def test_entries_within_fall_back(spark):
    entries = spark.createDataFrame([("c", i, t) for i, t in enumerate([1000, 2000, 3000, 4000])], "c STRING, i INT, t INT")
    items = spark.createDataFrame([("c", "a", 2200, 3001), ("c", "b", 3300, 3400), ("c", "d", 100, 200), ("x", "e", 1, 2)],
                                  "c STRING, item STRING, t0 INT, t1 INT")
    got = values(J.interval_join_fallback(items, entries, ["c"], "item", "t0", "t1", "t", ["i"], ["i"]), "item", "i")
    assert got == [("c", "a", 1, "within"), ("c", "a", 2, "within"), ("c", "b", 2, "start"),
                   *[("c", "d", i, "all") for i in range(4)]]


def test_resolve_start(spark):
    items = spark.createDataFrame([(12, 0, 0, 100), (12, 1, 100, 200), (12, 2, 200, 300)], "p INT, item INT, i INT, o INT")
    marks = spark.createDataFrame([(12, 0, 1, 150), (12, 1, 1, 250), (12, 2, 7, 10)], "p INT, m INT, item INT, t INT")
    starts = [(12, "first", None), (12, "item", 1), (12, "item", 5), (12, "mark", 0), (12, "mark", 1), (12, "mark", 2),
              (12, "mark", 9), (13, "first", None)]
    starts = spark.createDataFrame(starts, "p INT, kind STRING, n INT")
    got = J.resolve_start(starts, items, marks, "p", "kind", "n", "item", "i", "o", "m", "t")
    got = {(r["kind"], r["n"]): (r["item"], r["i"], r["o"]) for r in got.collect()}
    assert got == {
        ("first", None): (0, 0, 100), ("item", 1): (1, 100, 200), ("item", 5): (0, 0, 100), ("mark", 0): (1, 150, 200),
        ("mark", 1): (1, 100, 200), ("mark", 2): (0, 0, 100), ("mark", 9): (0, 0, 100),
    }


def test_compare_tables(spark):
    a = spark.createDataFrame([("g", i, 100) for i in range(4)] + [("h", 0, 5), ("m", 0, 1)], "g STRING, i INT, v INT")
    b = spark.createDataFrame([("g", i, 100 + i % 2) for i in range(4)] + [("h", 0, 5)], "g STRING, i INT, v INT")
    stats = J.compare_tables(a, b, ["g", "i"], "v", ["g"])
    got = {r["g"]: r for r in stats.collect()}
    assert (got["g"]["max_diff"], got["g"]["mse"], got["g"]["passed"]) == (1, 0.5, True)
    assert (got["h"]["psnr"], got["h"]["passed"]) == (None, True)
    assert (got["m"]["missing"], got["m"]["passed"]) == (1, False)
    assert J.worst_group(stats).first()["passed"] is False


def test_expand_index(spark):
    fine = spark.createDataFrame([(k, j) for k in "abc" for j in range(5)], "k STRING, j INT")
    coarse = spark.createDataFrame(
        [("a", 0, 0), ("a", 1, 2), ("a", 2, 2), ("b", 0, 3), ("b", 1, 1), ("c", 0, 1), ("c", 1, 9)], "k STRING, i INT, first INT"
    )
    rows, bad = W.expand_index(coarse, fine, ["k"], "i", "first", "j", ["i"])
    assert values(rows, "k", "j") == [("a", 0, 0), ("a", 1, 0), ("a", 2, 2), ("a", 3, 2), ("a", 4, 2)]
    assert values(bad, "k") == [("b",), ("c",)]


def test_stream_verdict(spark):
    rows = [("a", i, True) for i in range(8)] + [("a", 9, False)] + [("b", i, i != 3) for i in range(9)]
    rows += [("c", 0, True), ("d", 0, False)]
    got = A.stream_verdict(spark.createDataFrame(rows, "k STRING, i INT, p BOOLEAN"), ["k"], ["i"], "p")
    assert {r["k"]: (r["verdict"], r["early"], r["saw_video"]) for r in got.collect()} == {
        "a": ("protected", True, True), "b": ("nothing", False, True), "c": ("protected", False, False),
        "d": ("nothing", False, True),
    }


def test_until_marker(spark):
    rows = [("k", 1, "end"), ("k", 2, "open"), ("k", 3, "x"), ("k", 4, "end"), ("k", 5, "x"), ("m", 1, "open"), ("m", 2, "open")]
    df = spark.createDataFrame(rows, "k STRING, i INT, s STRING")
    got = W.until_marker(df, ["k"], ["i"], F.col("s") == "open", F.col("s") == "end")
    assert [(r["k"], r["i"]) for r in got.orderBy("k", "i").collect()] == [("k", 2), ("k", 3), ("k", 4), ("m", 1)]


def test_rle_expand_budget_and_width(spark):
    df = spark.createDataFrame([("k", 1, 3, 1), ("k", 2, 2, 0), ("k", 3, 10, 2), ("k", 4, 5, 3)], "k STRING, i INT, run INT, v INT")
    got = rle_expand(df, ["k"], ["i"], "run", "v", width=8, transparent=0)
    assert values(got, "cell") == [("k", c, 1) for c in range(3)] + [("k", c, 2) for c in range(5, 8)]
    # Costs 4, 1, 4, 1: the third run no longer fits into 8.
    assert rle_expand(df, ["k"], ["i"], "run", "v", width=8, transparent=0, budget=8).count() == 3


def test_best_positions(spark):
    cells = [("a", 1, 10, 40), ("a", 2, 50, 60), ("b", 1, 10, 10), ("c", 1, 10, 20), ("c", 2, 10, 30), ("d", 1, 99, 99)]
    df = spark.createDataFrame(cells, "k STRING, i INT, first INT, last INT")
    got = best_positions(df, ["k"], ["i"], "first", "last", 60)
    assert values(got, "k") == [("a", [10, 50, 40]), ("b", [10]), ("c", [10, 20])]


def test_layer_fold(spark):
    rows = [("a", 1, 100, 255), ("a", 2, 200, 128), ("b", 1, 50, 0), ("b", 2, 80, 40), ("b", 3, 90, 0)]
    df = spark.createDataFrame(rows, "k STRING, i INT, y INT, a INT")
    got = {r["k"]: (r["y"], r["a"]) for r in layer_fold(df, ["k"], ["i"], ["y"], "a").collect()}
    assert got == {"a": ((200 * 128 + 100 * 127 + 127) // 255, 255), "b": (80, 40)}


def test_budget_greedy_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("k", i, c) for i, c in enumerate([4, 9, 0, 3, 5, 2, 1])], "k STRING, i INT, c INT")
    assert [r["i"] for r in budget_greedy(df, ["k"], ["i"], "c", 10).orderBy("i").collect()] == [0, 2, 3, 5, 6]
    assert [r["i"] for r in budget_greedy(df, ["k"], ["i"], "c", 10, 3).orderBy("i").collect()] == [0, 2, 3]


def _follow(spark, n, links, ends, depth):
    nodes = spark.createDataFrame([(i, f"t{i}" if i in ends else None) for i in range(n)], "id INT, term STRING")
    edges = spark.createDataFrame(links, "id INT, o INT, t INT")
    return {r["id"]: (r["found"], r["hops"]) for r in G.follow_links(nodes, edges, "id", "term", "o", "t", depth).collect()}


def test_follow_links_first_listed_wins_and_cycles_end(spark):
    # 0 -> 1 -> 0 (cycle), then 1 -> 3; 0 -> 2 is listed later and shorter.
    got = _follow(spark, 5, [(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 3), (4, 1, 4)], {2, 3}, 4)
    assert got == {0: ("t3", 2), 1: ("t2", 2), 2: ("t2", 0), 3: ("t3", 0)}


def test_follow_links_depth(spark):
    chain = [(i, 1, i + 1) for i in range(6)]
    got = _follow(spark, 7, chain, {6}, 4)
    assert sorted(got) == [2, 3, 4, 5, 6] and got[2] == ("t6", 4)


def test_reachable_emits_in_walk_order(spark):
    edges = spark.createDataFrame([(0, 0, 2), (0, 1, 1), (0, 3, 3), (2, 5, 0)], "id INT, o INT, t INT")
    emits = spark.createDataFrame([(0, 2, 30), (1, 0, 20), (2, 0, 10), (3, 0, 40), (3, 1, 10)], "id INT, o INT, v INT")
    roots = spark.createDataFrame([(0,)], "id INT")
    got = G.reachable_emits(roots, edges, emits, "id", "o", "t", "v")
    assert [r["value"] for r in got.orderBy("emit_no").collect()] == [10, 20, 30, 40]
    assert G.reachable_emits(roots, edges, emits, "id", "o", "t", "v", cap=2).count() == 2


@pytest.mark.parametrize("group_rows", [None, 3])
def test_reachable_emits_is_the_walk(spark, group_rows):
    rng = random.Random(4)
    edges, emits = [], []
    for n in range(60):
        # A chain of 60 with links back and ahead.
        targets = [n + 1, *rng.sample(range(60), 2)] if n < 59 else [0]
        order = rng.sample(range(9), len(targets) + 2)
        edges += [(n, o, t) for o, t in zip(order, targets)]
        emits += [(n, o, rng.randrange(40)) for o in order[len(targets):]]

    def walk(root):
        level, seen, kids = [root], {root}, {}
        while level:
            step = []
            for n in level:
                for _, o, t in sorted(e for e in edges if e[0] == n):
                    if t not in seen:
                        seen.add(t)
                        step.append(t)
                        kids.setdefault(n, []).append((o, 1, t))
            level = step
        out, stack = [], [(root, 1)]
        while stack:
            n, link = stack.pop()
            if link:
                items = kids.get(n, []) + [(o, 0, v) for m, o, v in emits if m == n]
                stack += [(x, k) for _, k, x in sorted(items, reverse=True)]
            elif n not in out:
                out.append(n)
        return out

    roots = spark.createDataFrame([(0,), (7,), (7,), (99,)], "id INT")
    got = G.reachable_emits(
        roots, spark.createDataFrame(edges, "id INT, o INT, t INT"), spark.createDataFrame(emits, "id INT, o INT, v INT"),
        "id", "o", "t", "v", group_rows=group_rows,
    )
    assert not any("array" in t for _, t in got.dtypes)
    for root in (0, 7):
        rows = got.where(F.col("root") == root).orderBy("emit_no").collect()
        assert [r["emit_no"] for r in rows] == list(range(1, len(rows) + 1))
        assert [r["value"] for r in rows] == walk(root)
    assert got.where("root = 99").isEmpty()


def test_names_end_where_they_end(spark):
    df = spark.createDataFrame([("VIDEO_TS.VOB",), ("VIDEO_TS.VOB\n",), ("00001.m2ts\n",), ("JX_L.MP2\n",)], "n STRING")
    got = df.select(N.classify_name("n")["class"].alias("c"), N.size_rank("n").alias("r")).collect()
    assert [(r["c"], r["r"]) for r in got] == [("manager", None), (None, None), (None, None), (None, None)]


def test_lookup_path_takes_the_first_folder(spark):
    rows = [("d", 1, None, "", True, 0), ("d", 2, 1, "bdmv", True, 1), ("d", 3, 1, "BDMV", True, 2), ("d", 4, 3, "meta", True, 1),
            ("d", 5, 2, "META", True, 1), ("d", 6, 5, "dl.jpg", False, 1)]
    df = spark.createDataFrame(rows, "img STRING, id INT, up INT, name STRING, dir BOOLEAN, pos INT")
    got = G.lookup_path(df, ["img"], "id", "up", "name", "dir", ["pos"], "BDMV/META/DL.jpg")
    assert values(got, "id") == [("d", 6)]


def test_coalesce_backup_takes_whole_records(spark):
    a = spark.createDataFrame([(1, None, 5), (2, 7, None), (3, None, 1)], "k INT, v INT, w INT")
    b = spark.createDataFrame([(1, 8, None), (4, 9, 9)], "k INT, v INT, w INT")
    got = J.coalesce_backup(a, b, ["k"], lambda c: c("v").isNotNull())
    assert values(got, "k") == [(1, "backup", 8, None), (2, "primary", 7, None), (4, "backup", 9, 9)]
