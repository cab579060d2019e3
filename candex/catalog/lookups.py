"""Joins and lookups."""

from pyspark.sql import functions as F

from candex.catalog.registry import EVENTS_SQL, ITEMS_SQL, LINES, LINES_SQL, events, items, query, table
from candex.functions.numbers import cents, int_div
from candex.operators import lookups as J
from candex.operators.windows import rank_candidates

RANGES_SQL = """ranges AS (SELECT s_suppkey * 90 AS first, 50 + s_suppkey % 40 AS blocks,
    CASE WHEN s_nationkey <> 3 THEN s_suppkey * 1000 END AS target FROM supplier WHERE s_suppkey > 0)"""


@query(
    "j1_range_lookup",
    f"""WITH {RANGES_SQL} SELECT event_id,
          CASE WHEN first IS NULL OR event_id - first >= blocks THEN 'outside'
               WHEN target IS NULL THEN 'not recorded' ELSE 'ok' END AS status,
          CASE WHEN event_id - first < blocks THEN target + (event_id - first) END AS address
        FROM events ASOF LEFT JOIN ranges ON event_id >= first""",
)
def range_lookup(spark, d):
    ranges = table(spark, d, "supplier").where("s_suppkey > 0").select(
        (F.col("s_suppkey") * 90).alias("first"),
        (F.col("s_suppkey") % 40 + 50).alias("blocks"),
        F.when(F.col("s_nationkey") != 3, F.col("s_suppkey") * 1000).alias("target"),
    )
    return J.range_lookup(table(spark, d, "events").select("event_id"), ranges, "event_id", "first", "blocks", "target")


@query(
    "j2_remap_lookup",
    """SELECT o_orderkey, o_custkey, CASE WHEN c_custkey IS NULL THEN 'outside' WHEN c_nationkey = 7 THEN 'unallocated'
              ELSE 'ok' END AS status, CASE WHEN c_nationkey <> 7 THEN 100 + c_nationkey END AS address
       FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey""",
)
def remap(spark, d):
    keys = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    known = table(spark, d, "customer").where("c_acctbal >= 0").withColumnRenamed("c_custkey", "o_custkey")
    return J.remap_lookup(keys, known, "o_custkey", "c_nationkey", 7, 100).select(
        "o_orderkey", "o_custkey", "status", "address"
    )


@query(
    "j3_two_level_lookup",
    """SELECT s_suppkey, CASE WHEN n_nationkey IS NULL THEN 'no map' WHEN r_regionkey IS NULL THEN 'no partition'
              ELSE 'ok' END AS status, r_regionkey * 1000 AS base
       FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_name <> 'NATION_3') ON s_nationkey = n_nationkey
       LEFT JOIN (SELECT * FROM region WHERE r_name <> 'ASIA') ON n_regionkey = r_regionkey""",
)
def two_levels(spark, d):
    refs = table(spark, d, "nation").where("n_name <> 'NATION_3'").withColumnRenamed("n_nationkey", "s_nationkey")
    bases = table(spark, d, "region").where("r_name <> 'ASIA'").select(
        F.col("r_regionkey").alias("n_regionkey"), (F.col("r_regionkey") * 1000).alias("base")
    )
    suppliers = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    out = J.two_level_lookup(suppliers, refs, bases, "s_nationkey", "n_regionkey", "base")
    return out.select("s_suppkey", "status", "base")


EXTENTS_SQL = f"""ext AS (SELECT l_orderkey AS k, row_number() OVER w AS ord, sum(qty) OVER w - qty AS s,
      sum(qty) OVER w AS e, CASE WHEN l_returnflag <> 'R' THEN l_partkey * 100 END AS sector
    FROM li WHERE qty > 0 WINDOW w AS (PARTITION BY l_orderkey ORDER BY {LINES_SQL} ROWS UNBOUNDED PRECEDING)),
  req AS (SELECT o_orderkey AS k, o_custkey % 40 AS a,
      least(o_custkey % 40 + 30 + o_orderkey % 90, o_orderkey % 3 * 40 + 60) AS b FROM orders)"""


@query(
    "j4_slice_extents",
    f"""WITH {ITEMS_SQL}, {EXTENTS_SQL}, r AS (SELECT * FROM req WHERE a < b),
        tops AS (SELECT k, max(e) AS top FROM ext GROUP BY k)
        SELECT r.k AS order_id, CAST(ord AS BIGINT) AS ord, CAST(greatest(a, s) AS BIGINT) AS start,
               CAST(least(b, e) AS BIGINT) AS stop, sector IS NULL AS hole,
               CAST(sector + greatest(a, s) - s AS BIGINT) AS address
        FROM r JOIN ext ON r.k = ext.k AND s < b AND e > a
        UNION ALL SELECT r.k, NULL, CAST(greatest(a, coalesce(top, 0)) AS BIGINT), CAST(b AS BIGINT), true, NULL
        FROM r LEFT JOIN tops ON r.k = tops.k WHERE coalesce(top, 0) < b""",
)
def slices(spark, d):
    extents = items(spark, d).select(
        F.col("l_orderkey").alias("order_id"), *LINES, "qty",
        F.when(F.col("l_returnflag") != "R", F.col("l_partkey") * 100).alias("sector"),
    )
    requests = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.lit(1).alias("request"), (F.col("o_custkey") % 40).alias("off"),
        (F.col("o_orderkey") % 90 + 30).alias("length"), (F.col("o_orderkey") % 3 * 40 + 60).alias("size"),
    )
    out = J.slice_extents(
        requests, extents, "order_id", "request", "off", "length", LINES, "qty", "sector", "size"
    )
    return out.drop("request").withColumn("ord", F.col("ord").cast("long"))


@query(
    "j5_locate_offset",
    f"""WITH {ITEMS_SQL}, parts AS (SELECT l_orderkey, row_number() OVER w AS part, sum(qty) OVER w - qty AS s,
          sum(qty) OVER w AS e FROM li
          WINDOW w AS (PARTITION BY l_orderkey ORDER BY {LINES_SQL} ROWS UNBOUNDED PRECEDING)),
        p AS (SELECT l_orderkey, CAST(sum(qty) * (250 + l_orderkey % 4 * 300) // 1000 AS BIGINT) AS pos
              FROM li GROUP BY l_orderkey)
        SELECT p.l_orderkey, pos, part, CAST(coalesce(pos - s, 0) AS BIGINT) AS "offset", part IS NULL AS at_end
        FROM p LEFT JOIN parts ON p.l_orderkey = parts.l_orderkey AND s <= pos AND pos < e""",
)
def located(spark, d):
    parts = rank_candidates(items(spark, d), ["l_orderkey"], [], LINES).withColumnRenamed("rank_no", "part")
    share = int_div(F.sum("qty") * (F.col("l_orderkey") % 4 * 300 + 250), 1000)
    wanted = items(spark, d).groupBy("l_orderkey").agg(share.alias("pos"))
    return J.locate_offset(wanted, parts, "l_orderkey", "pos", LINES, "qty", "part")


@query(
    "j6_asof_backward",
    """SELECT p.event_id, p.user_id, v.event_id AS view_id
       FROM (SELECT * FROM events WHERE event_type = 'purchase') p
       ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def last_view(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return J.asof_backward(bought, views, ["user_id"], "ts", "ts", ["view_id"], ["view_id"]).drop("ts")


WINDOWS_SQL = f"""{EVENTS_SQL},
  it AS (SELECT user_id, event_id AS item, day_secs AS t0, day_secs + 7200 AS t1 FROM ev
         WHERE event_type = 'purchase'),
  en AS (SELECT user_id, event_id AS entry, day_secs AS t FROM ev WHERE event_type = 'error'),
  w AS (SELECT it.user_id, item, entry FROM it JOIN en USING (user_id)
        WHERE t >= greatest(t0 - 255, 0) AND t < t1),
  r AS (SELECT * FROM it WHERE item NOT IN (SELECT item FROM w)),
  s AS (SELECT user_id, item, max(entry) AS entry FROM r JOIN en USING (user_id) WHERE t <= t0 GROUP BY 1, 2),
  pairs AS (SELECT user_id, item, entry, 'within' AS rule FROM w
    UNION ALL SELECT user_id, item, entry, 'start' FROM s
    UNION ALL SELECT r.user_id, item, entry, 'all' FROM r JOIN en USING (user_id)
      WHERE item NOT IN (SELECT item FROM s))"""


def _windows(spark, d):
    e = events(spark, d)
    wanted = e.where("event_type = 'purchase'").select(
        "user_id", F.col("event_id").alias("item"), F.col("day_secs").alias("t0"), (F.col("day_secs") + 7200).alias("t1")
    )
    entries = e.where("event_type = 'error'").select(
        "user_id", F.col("event_id").alias("entry"), F.col("day_secs").alias("t")
    )
    return wanted, entries, ["user_id"], "item", "t0", "t1", "t", ["entry"], ["entry"]


@query("j7_interval_join_fallback", f"WITH {WINDOWS_SQL} SELECT * FROM pairs")
def windows_of_events(spark, d):
    return J.interval_join_fallback(*_windows(spark, d))


@query(
    "j7_entry_ranges",
    f"WITH {WINDOWS_SQL} SELECT user_id, item, rule, count(*) AS entries FROM pairs GROUP BY 1, 2, 3",
)
def ranges_of_events(spark, d):
    ranges, _ = J.entry_ranges(*_windows(spark, d))
    return ranges.select("user_id", "item", "rule", (F.col("last") - F.col("first") + 1).alias("entries"))


@query(
    "j8_resolve_start",
    """WITH it AS (SELECT conv_id, turn, turn * 100 AS t0, turn * 100 + 60 AS t1 FROM conversations),
         mk AS (SELECT conv_id, turn // 2 AS n, max(turn) AS turn, max(turn) * 100 + max(length(text)) % 90 AS t
                FROM conversations WHERE role = 'assistant' GROUP BY 1, 2),
         st AS (SELECT DISTINCT conv_id, kind, CASE kind WHEN 'first' THEN NULL WHEN 'item' THEN conv_id % 9
                ELSE conv_id % 5 END AS n FROM conversations, (VALUES ('first'), ('item'), ('mark')) k(kind)),
         a AS (SELECT st.*, mk.t AS mt, coalesce(CASE kind WHEN 'item' THEN st.n WHEN 'mark' THEN mk.turn END, 0) AS want
               FROM st LEFT JOIN mk ON st.conv_id = mk.conv_id AND st.n = mk.n AND kind = 'mark'),
         b AS (SELECT a.*, i.turn AS it, i.t0 AS i0, i.t1 AS i1, z.t0 AS z0, z.t1 AS z1 FROM a
               JOIN it z ON a.conv_id = z.conv_id AND z.turn = 0
               LEFT JOIN it i ON a.conv_id = i.conv_id AND i.turn = want)
       SELECT conv_id, kind, n, CASE WHEN it IS NULL THEN 0 ELSE want END AS turn,
         CASE WHEN kind = 'mark' AND it IS NOT NULL AND mt >= i0 AND mt < i1 THEN mt ELSE coalesce(i0, z0) END AS t0,
         coalesce(i1, z1) AS t1 FROM b""",
)
def started(spark, d):
    c = table(spark, d, "conversations")
    turns = c.select("conv_id", "turn", (F.col("turn") * 100).alias("t0"), (F.col("turn") * 100 + 60).alias("t1"))
    marks = c.where("role = 'assistant'").groupBy("conv_id", int_div("turn", 2).alias("mark")).agg(
        F.max("turn").alias("turn"), (F.max("turn") * 100 + F.max(F.length("text")) % 90).alias("time")
    )
    kinds = F.explode(F.array(*[F.lit(k) for k in ("first", "item", "mark")]))
    n = F.when(F.col("kind") == "item", F.col("conv_id") % 9).when(F.col("kind") == "mark", F.col("conv_id") % 5)
    starts = c.select("conv_id").distinct().select("conv_id", kinds.alias("kind")).withColumn("n", n)
    return J.resolve_start(starts, turns, marks, "conv_id", "kind", "n", "turn", "t0", "t1", "mark", "time")


@query(
    "j9_coalesce_backup",
    """WITH b AS (SELECT doc_id, CAST(n_chars > 1000 AS INTEGER) AS quality, CAST(n_chars % 7 = 0 AS INTEGER) AS toxic
                  FROM documents WHERE lang <> 'de'),
       m AS (SELECT coalesce(l.doc_id, b.doc_id) AS doc_id, l.doc_id IS NOT NULL AND l.toxic = 0 AS ok_a,
                    b.doc_id IS NOT NULL AND b.toxic = 0 AS ok_b, l.quality AS qa, l.toxic AS ta, b.quality AS qb,
                    b.toxic AS tb FROM labels l FULL JOIN b ON l.doc_id = b.doc_id)
       SELECT doc_id, CASE WHEN ok_a THEN 'primary' ELSE 'backup' END AS origin, CASE WHEN ok_a THEN qa ELSE qb END
         AS quality, CASE WHEN ok_a THEN ta ELSE tb END AS toxic FROM m WHERE ok_a OR ok_b""",
)
def backed_up(spark, d):
    derived = table(spark, d, "documents").where("lang <> 'de'").select(
        "doc_id", (F.col("n_chars") > 1000).cast("int").alias("quality"),
        (F.col("n_chars") % 7 == 0).cast("int").alias("toxic"),
    )
    labels = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    return J.coalesce_backup(labels, derived, ["doc_id"], lambda c: c("toxic") == 0)


@query(
    "j10_semi_supported",
    """SELECT p_partkey, p_brand FROM part
       WHERE p_brand IN (SELECT p_brand FROM part WHERE p_type = 'PROMO' AND p_retailprice > 995)""",
)
def supported(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    kinds = parts.where("p_type = 'PROMO' AND p_retailprice > 995")
    return J.semi_supported(parts, kinds, "p_brand").select("p_partkey", "p_brand")


@query(
    "j11_anti_seen",
    """SELECT c_custkey, c_name FROM customer
       WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL)""",
)
def untried(spark, d):
    seen = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return J.anti_seen(table(spark, d, "customer"), seen, "c_custkey").select("c_custkey", "c_name")


@query(
    "j12_dict_join_default",
    """WITH w AS (SELECT event_type, count(*) AS weight FROM events WHERE event_type <> 'error' GROUP BY 1)
       SELECT event_id, coalesce(weight, 0) AS weight FROM events LEFT JOIN w USING (event_type)""",
)
def weighted(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    weights = e.where("event_type <> 'error'").groupBy("event_type").agg(F.count(F.lit(1)).alias("weight"))
    return J.dict_join_default(e, weights, "event_type", "weight", 0).select("event_id", "weight")


@query(
    "j13_first_resolvable_ref",
    """WITH r AS (SELECT doc_id, unnest([doc_id + 3, doc_id + 1, doc_id + 2]) AS id, unnest([0, 1, 2]) AS pos
                  FROM documents)
       SELECT doc_id, min_by(id, pos) AS ref FROM r
       WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY doc_id""",
)
def resolvable(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", F.array(F.col("doc_id") + 3, F.col("doc_id") + 1, F.col("doc_id") + 2).alias("refs")
    )
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return J.first_resolvable_ref(docs, ["doc_id"], "refs", good, "id").select("doc_id", "ref")


@query(
    "j14_code_bound",
    """WITH b(profile, code, bound) AS (VALUES
         ('hd', 1, 131072), ('hd', 2, 262144), ('hd', 3, 393216), ('hd', 4, 589824), ('hd', 5, 917504),
         ('hd', 6, 1310720), ('uhd', 1, 786432), ('uhd', 2, 1572864), ('uhd', 3, 2359296), ('uhd', 4, 3145728),
         ('uhd', 5, 3932160), ('uhd', 6, 4718592)),
       p AS (SELECT p_partkey, p_size % 8 AS code, CASE WHEN p_type = 'LARGE' THEN 'uhd' ELSE 'hd' END AS profile
             FROM part)
       SELECT p_partkey, p.code, p.profile, CAST(least(coalesce(bound + 6144,
           CASE p.profile WHEN 'uhd' THEN 3145728 ELSE 1048576 END),
         CASE p.profile WHEN 'uhd' THEN 6291456 ELSE 2097152 END) AS BIGINT) AS bound
       FROM p LEFT JOIN b ON p.code = b.code AND p.profile = b.profile""",
)
def bounded_codes(spark, d):
    parts = table(spark, d, "part").select(
        "p_partkey", (F.col("p_size") % 8).alias("code"),
        F.when(F.col("p_type") == "LARGE", "uhd").otherwise("hd").alias("profile"),
    )

    def per_profile(values):
        return F.when(F.col("profile") == "uhd", values["uhd"]).otherwise(values["hd"]).cast("long")

    return J.code_bound(
        parts, J.picture_bounds(spark), "code", "profile", "bound", per_profile(J.DEFAULT_SPANS), per_profile(J.MAX_SPANS), J.SPAN_EXTRA
    ).select("p_partkey", "code", "profile", "bound")


COMPARED_SQL = """s AS (SELECT o_orderpriority, count(*) AS n, max(abs(c - r)) AS max_diff,
      CAST(CAST(sum((c - r) * (c - r)) AS HUGEINT) AS DOUBLE) / count(*) AS mse
    FROM (SELECT o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS c,
                 CAST(round(o_totalprice) AS BIGINT) * 100 AS r FROM orders) GROUP BY 1)"""


def _compared(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    stored = orders.select("o_orderkey", "o_orderpriority", cents("o_totalprice").alias("v"))
    whole = orders.select(
        "o_orderkey", "o_orderpriority", (F.round("o_totalprice").cast("long") * 100).alias("v")
    )
    keys = ["o_orderkey", "o_orderpriority"]
    return J.compare_tables(
        stored, whole, keys, "v", ["o_orderpriority"], peak=50000000.0, max_diff=50, min_psnr=124.7
    )


@query(
    "j15_compare_tables",
    f"""WITH {COMPARED_SQL} SELECT o_orderpriority, n, max_diff, round(mse, 4) AS mse,
          round(10 * log10(50000000.0 * 50000000.0 / mse), 6) AS psnr,
          max_diff <= 50 AND 10 * log10(50000000.0 * 50000000.0 / mse) >= 124.7 AS passed FROM s""",
)
def compared(spark, d):
    return _compared(spark, d).select(
        "o_orderpriority", "n", "max_diff", F.round("mse", 4).alias("mse"), F.round("psnr", 6).alias("psnr"), "passed"
    )


@query(
    "j15_worst_group",
    f"""WITH {COMPARED_SQL} SELECT max(max_diff) AS max_diff,
          round(min(10 * log10(50000000.0 * 50000000.0 / mse)), 6) AS psnr,
          bool_and(max_diff <= 50 AND 10 * log10(50000000.0 * 50000000.0 / mse) >= 124.7) AS passed FROM s""",
)
def worst(spark, d):
    return J.worst_group(_compared(spark, d)).withColumn("psnr", F.round("psnr", 6))
