"""Numbers, layers, runs, nested rows and graphs."""

from pyspark.sql import functions as F

from candex.catalog.registry import EVENTS_SQL, ITEMS_SQL, LINES, LINES_SQL, TIMES, events, items, query, table
from candex.functions import numbers as X
from candex.operators.aggregates import group_parts
from candex.operators.expand import best_positions, nested_flatten, paint_last, rle_encode, rle_expand
from candex.operators.folds import blend, layer_fold
from candex.operators.graph import follow_links, lookup_path, reachable_emits, resolve_paths
from candex.operators.windows import rank_candidates


@query(
    "x1_alignment",
    """SELECT p_partkey, p_partkey // 32 * 32 AS down, (p_partkey + 5) // 6 * 6 AS up, (p_partkey + 6) // 7 AS ceiling,
         (p_partkey + p_size // 2) // p_size AS half_up FROM part""",
)
def alignment(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", X.align_down("p_partkey", 32).alias("down"), X.align_up("p_partkey", 6).alias("up"),
        X.ceil_div("p_partkey", 7).alias("ceiling"), X.div_half_up("p_partkey", "p_size").alias("half_up"),
    )


@query(
    "x2_bits",
    """SELECT event_id, (event_id >> 3) & 31 AS field, ((event_id & 7) << 5) | ((event_id >> 3) & 31) AS swapped,
         event_id * 90000 // 45000 AS ticks FROM events""",
)
def bit_fields(spark, d):
    field = X.bits("event_id", 3, 5)
    return table(spark, d, "events").select(
        "event_id", field.alias("field"), X.join_bits(X.bits("event_id", 0, 3), field, 5).alias("swapped"),
        X.tick_scale("event_id", 45000, 90000).alias("ticks"),
    )


@query(
    "x3_checked",
    """WITH v AS (SELECT o_orderkey, CAST(o_orderkey AS HUGEINT) * o_custkey * 1000000000000 AS p,
            CAST(o_orderkey AS HUGEINT) * o_custkey * 1000 + 9223372036000000000 AS s FROM orders)
       SELECT o_orderkey, CASE WHEN p <= 9223372036854775807 THEN CAST(p AS BIGINT) END AS product,
         CASE WHEN p <= 9223372036854775807 THEN 'ok' ELSE 'overflow' END AS product_status,
         CASE WHEN s <= 9223372036854775807 THEN CAST(s AS BIGINT) END AS total,
         CASE WHEN s <= 9223372036854775807 THEN 'ok' ELSE 'overflow' END AS total_status FROM v""",
)
def checked(spark, d):
    product = X.checked_product("o_orderkey", "o_custkey", 1_000_000_000_000)
    total = X.checked_sum(F.col("o_orderkey") * F.col("o_custkey") * 1000, 9_223_372_036_000_000_000)
    out = table(spark, d, "orders").select("o_orderkey", product.alias("p"), total.alias("s"))
    return out.select(
        "o_orderkey", F.col("p.value").alias("product"), F.col("p.status").alias("product_status"),
        F.col("s.value").alias("total"), F.col("s.status").alias("total_status"),
    )


@query(
    "x4_sizes",
    """WITH v AS (SELECT p_partkey, CAST(p_size AS BIGINT) * 40 AS w, p_partkey + 1 AS h, CAST(p_size % 7 AS BIGINT) AS n,
              p_partkey % 5 AS m FROM part),
       s AS (SELECT *, CASE WHEN n = 0 OR m = 0 THEN 1 WHEN n > 4 * m THEN 4 WHEN m > 4 * n THEN 1 ELSE n END AS a,
              CASE WHEN n = 0 OR m = 0 THEN 1 WHEN n > 4 * m THEN 1 WHEN m > 4 * n THEN 4 ELSE m END AS b FROM v),
       t AS (SELECT *, greatest((w * a + b // 2) // b, 1) AS dw, greatest(h, 1) AS dh FROM s)
       SELECT p_partkey, CASE WHEN greatest(w, h) <= 256 THEN w WHEN w >= h THEN 256 ELSE greatest(w * 256 // h, 1) END
           AS fit_w, CASE WHEN greatest(w, h) <= 256 THEN h WHEN w >= h THEN greatest(h * 256 // w, 1) ELSE 256 END
           AS fit_h, CAST(dw AS BIGINT) AS shown_w, CAST(dh AS BIGINT) AS shown_h,
         CAST(greatest(least(greatest(dw, dh) // 128, w // 2, h // 2), 1) AS BIGINT) AS factor FROM t""",
)
def sizes(spark, d):
    p = table(spark, d, "part").select(
        "p_partkey", (F.col("p_size").cast("long") * 40).alias("w"), (F.col("p_partkey") + 1).alias("h"),
        (F.col("p_size") % 7).alias("n"), (F.col("p_partkey") % 5).alias("m"),
    )
    fit, shown = X.fit_box("w", "h", 256), X.display_size("w", "h", "n", "m")
    return p.select(
        "p_partkey", fit["w"].alias("fit_w"), fit["h"].alias("fit_h"), shown["w"].alias("shown_w"),
        shown["h"].alias("shown_h"), X.reduction_factor("w", "h", 64, "n", "m").alias("factor"),
    )


@query(
    "x5_ratio_reduce",
    """WITH v AS (SELECT p_partkey, p_partkey AS a, CAST(p_size AS BIGINT) * 12 AS b FROM part)
       SELECT p_partkey, CASE WHEN a = 0 OR b = 0 THEN 1 ELSE a // gcd(a, b) END AS num,
         CASE WHEN a = 0 OR b = 0 THEN 1 ELSE b // gcd(a, b) END AS den FROM v""",
)
def ratios(spark, d):
    r = X.ratio_reduce("p_partkey", F.col("p_size") * 12)
    return table(spark, d, "part").select("p_partkey", r["num"].alias("num"), r["den"].alias("den"))


@query(
    "x6_layer_fold",
    f"""WITH RECURSIVE {ITEMS_SQL}, l AS (SELECT l_orderkey, qty * 5 AS y, l_partkey % 256 AS cb,
            CASE WHEN l_suppkey % 9 = 0 THEN 255 ELSE l_suppkey * 7 % 256 END AS a,
            row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINES_SQL}) AS rn FROM li),
          f AS (SELECT l_orderkey, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS y, CAST(0 AS BIGINT) AS cb,
                  CAST(0 AS BIGINT) AS a FROM (SELECT DISTINCT l_orderkey FROM li)
            UNION ALL
            SELECT l.l_orderkey, l.rn,
              CASE WHEN l.a = 255 OR f.a = 0 THEN l.y ELSE (l.y * l.a + f.y * (f.a * (255 - l.a) // 255)
                + (l.a + f.a * (255 - l.a) // 255) // 2) // (l.a + f.a * (255 - l.a) // 255) END,
              CASE WHEN l.a = 255 OR f.a = 0 THEN l.cb ELSE (l.cb * l.a + f.cb * (f.a * (255 - l.a) // 255)
                + (l.a + f.a * (255 - l.a) // 255) // 2) // (l.a + f.a * (255 - l.a) // 255) END,
              CASE WHEN l.a = 255 OR f.a = 0 THEN l.a ELSE l.a + f.a * (255 - l.a) // 255 END
            FROM f JOIN l ON l.l_orderkey = f.l_orderkey AND l.rn = f.rn + 1)
        SELECT l_orderkey, max(rn) AS layers, max_by(y, rn) AS y, max_by(cb, rn) AS cb, max_by(a, rn) AS a
        FROM f GROUP BY l_orderkey""",
)
def layers(spark, d):
    alpha = F.when(F.col("l_suppkey") % 9 == 0, 255).otherwise(F.col("l_suppkey") * 7 % 256)
    stack = items(spark, d).withColumns({"y": F.col("qty") * 5, "cb": F.col("l_partkey") % 256, "a": alpha})
    return layer_fold(stack, ["l_orderkey"], LINES, ["y", "cb"], "a")


@query(
    "x6_blend",
    """SELECT p_partkey, (p_size * 5 * (p_partkey % 256) + (p_partkey * 3 % 256) * (255 - p_partkey % 256) + 127) // 255
         AS v FROM part""",
)
def blended(spark, d):
    a = F.col("p_partkey") % 256
    return table(spark, d, "part").select("p_partkey", blend(F.col("p_partkey") * 3 % 256, F.col("p_size") * 5, a).alias("v"))


@query(
    "r1_rle_expand",
    f"""WITH {ITEMS_SQL}, w AS (SELECT l_orderkey, l_returnflag AS value, sum(qty) OVER o - qty AS s, sum(qty) OVER o AS e,
            {", ".join(LINES[:3])}, l_shipdate, l_extendedprice FROM li
            WINDOW o AS (PARTITION BY l_orderkey ORDER BY {LINES_SQL} ROWS UNBOUNDED PRECEDING)),
          x AS (SELECT *, CASE WHEN value = 'N' THEN s ELSE greatest(least(e, 150), s) END AS t FROM w),
          c AS (SELECT *, sum(1 + t - s) OVER (PARTITION BY l_orderkey ORDER BY {LINES_SQL} ROWS UNBOUNDED PRECEDING)
                AS cost FROM x)
        SELECT l_orderkey, unnest(range(CAST(s AS BIGINT), CAST(t AS BIGINT))) AS cell, value FROM c WHERE cost <= 120""",
)
def cells_of_runs(spark, d):
    runs = items(spark, d).withColumnRenamed("l_returnflag", "value")
    return rle_expand(runs, ["l_orderkey"], LINES, "qty", "value", 150, "N", 120)


@query(
    "r1_rle_round_trip",
    """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS cell, event_type AS value
       FROM events""",
)
def round_trip(spark, d):
    runs = rle_encode(table(spark, d, "events"), ["user_id"], TIMES, "event_type")
    return rle_expand(runs, ["user_id"], ["run_no"], "run", "value")


@query(
    "r2_rle_encode",
    """WITH a AS (SELECT user_id, event_type AS v, row_number() OVER w AS pos, lag(event_type) OVER w AS b FROM events
                  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       g AS (SELECT *, count(*) FILTER (WHERE b IS NULL OR b <> v) OVER (PARTITION BY user_id ORDER BY pos
             ROWS UNBOUNDED PRECEDING) AS run_no FROM a)
       SELECT user_id, run_no, min(pos) - 1 AS start, count(*) AS run, any_value(v) AS value FROM g GROUP BY 1, 2""",
)
def runs(spark, d):
    return rle_encode(table(spark, d, "events"), ["user_id"], TIMES, "event_type")


@query(
    "r3_paint_last",
    f"""WITH {ITEMS_SQL}, i AS (SELECT l_orderkey, l_suppkey, l_partkey % 40 AS s, l_partkey % 40 + qty AS e,
            row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINES_SQL}) AS no FROM li),
          c AS (SELECT l_orderkey, unnest(range(s, e)) AS cell, no, l_suppkey FROM i)
        SELECT l_orderkey, cell, max_by(l_suppkey, no) AS value FROM c GROUP BY 1, 2""",
)
def painted(spark, d):
    drawn = rank_candidates(items(spark, d), ["l_orderkey"], [], LINES)
    drawn = drawn.withColumns({"s": F.col("l_partkey") % 40, "e": F.col("l_partkey") % 40 + F.col("qty")})
    out = paint_last(drawn, ["l_orderkey"], "s", "e", "rank_no", "l_suppkey")
    return out


@query(
    "r4_nested_flatten",
    r"""WITH a AS (SELECT doc_id, string_split(text, E'\n') AS ls FROM documents),
        b AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM a),
        c AS (SELECT doc_id, i, string_split(line, ' ') AS ws FROM b)
        SELECT doc_id, CAST(i AS INTEGER) AS lines_pos, CAST(unnest(range(len(ws))) AS INTEGER) AS words_pos,
          unnest(ws) AS words FROM c""",
)
def flattened(spark, d):
    lines = F.transform(F.split("text", "\n", -1), lambda s: F.struct(F.split(s, " ", -1).alias("words")))
    nested = table(spark, d, "documents").select("doc_id", lines.alias("lines"))
    return nested_flatten(nested, ["lines", "words"], ["doc_id"])


@query(
    "r4_nested_parts",
    """WITH o AS (SELECT l_orderkey, l_linenumber - 1 AS part, CAST(l_quantity AS BIGINT) AS qty, row_number() OVER (
            PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn
            FROM lineitem)
       SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY part) - 1 AS INTEGER) AS parts_pos, part,
         qty AS size FROM o WHERE rn = 1 AND part <> 0 AND qty > 0""",
)
def flattened_parts(spark, d):
    lines = items(spark, d).withColumn("part", F.col("l_linenumber") - 1)
    sets = group_parts(lines, ["l_orderkey"], "part", "qty", LINES)
    return nested_flatten(sets, ["parts"], ["l_orderkey"])


@query(
    "r5_best_positions",
    f"""WITH {EVENTS_SQL}, r AS (SELECT user_id, day_secs, cents, row_number() OVER (PARTITION BY user_id ORDER BY ts,
            event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM ev),
          g AS (SELECT user_id, max(day_secs) FILTER (WHERE pos = 1) AS a, max(day_secs) FILTER (WHERE pos = n AND n > 1)
            AS b, max(day_secs + cents * 100) FILTER (WHERE pos = 1) AS c FROM r GROUP BY 1),
          l AS (SELECT user_id, 1 AS k, a AS p FROM g UNION ALL SELECT user_id, 2, b FROM g
            UNION ALL SELECT user_id, 3, c FROM g WHERE c > a),
          u AS (SELECT user_id, min(k) AS k, p FROM l WHERE p < 2500000 GROUP BY user_id, p)
        SELECT user_id, string_agg(p, ',' ORDER BY k) AS positions FROM u GROUP BY user_id""",
)
def places(spark, d):
    e = events(spark, d).withColumn("later", F.col("day_secs") + F.col("cents") * 100)
    out = best_positions(e, ["user_id"], TIMES, "day_secs", "later", 2_500_000)
    return out.select("user_id", F.array_join("positions", ",").alias("positions"))


def _tree(spark, d):
    region = table(spark, d, "region").select(
        F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("up"),
        F.col("r_name").alias("name"), F.lit(True).alias("folder"),
    )
    nation = table(spark, d, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey")), F.concat(F.lit("r"), F.col("n_regionkey")), "n_name", F.lit(True)
    )
    customer = table(spark, d, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey")), F.concat(F.lit("n"), F.col("c_nationkey")), "c_name", F.lit(False)
    )
    return region.unionAll(nation).unionAll(customer)


@query(
    "g1_resolve_paths",
    """SELECT 'r' || r_regionkey AS id, r_name AS path, 1 AS depth FROM region
       UNION ALL SELECT 'n' || n_nationkey, r_name || '/' || n_name, 2 FROM nation JOIN region
         ON n_regionkey = r_regionkey
       UNION ALL SELECT 'c' || c_custkey, r_name || '/' || n_name || '/' || c_name, 3 FROM customer
         JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def paths(spark, d):
    return resolve_paths(_tree(spark, d), [], "id", "up", "name")


@query(
    "g1_lookup_path",
    """SELECT m.c_mktsegment, min(c_custkey) AS id FROM customer m JOIN nation ON c_nationkey = n_nationkey
       WHERE n_name = 'NATION_4' GROUP BY 1""",
)
def looked_up(spark, d):
    # One tree per market segment: a root, its nations, their customers all under the same name.
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    leaf = c.select(
        "c_mktsegment", F.col("c_custkey").alias("id"), (-F.col("c_nationkey") - 2).cast("long").alias("up"),
        F.lit("Entry").alias("name"), F.lit(False).alias("folder"),
    )
    folder = c.select(
        "c_mktsegment", (-F.col("c_nationkey") - 2).cast("long").alias("id"), F.lit(-1).cast("long").alias("up"), "n_name",
        F.lit(True),
    ).distinct()
    root = c.select("c_mktsegment", F.lit(-1).cast("long"), F.lit(None).cast("long"), F.lit(""), F.lit(True)).distinct()
    entries = leaf.unionAll(folder).unionAll(root)
    return lookup_path(entries, ["c_mktsegment"], "id", "up", "name", "folder", ["id"], "nation_4/ENTRY")


CHAIN_SQL = """n AS (SELECT count(*) AS n FROM supplier),
  nodes AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 13 = 5 THEN 'end' || s_suppkey END AS term FROM supplier),
  links AS (SELECT s_suppkey AS k, 1 AS o, (s_suppkey * 7 + 3) % n AS t FROM supplier, n
            UNION ALL SELECT s_suppkey, 2, (s_suppkey + 1) % n FROM supplier, n)"""


@query(
    "g2_follow_links",
    f"""WITH RECURSIVE {CHAIN_SQL},
        w AS (SELECT k AS f, k AS at, CAST([] AS INTEGER[]) AS path, [k] AS seen, term FROM nodes
          UNION ALL SELECT w.f, nodes.k, list_append(path, o), list_append(seen, nodes.k), nodes.term
          FROM w JOIN links ON links.k = w.at JOIN nodes ON nodes.k = links.t
          WHERE w.term IS NULL AND len(path) < 4 AND NOT list_contains(seen, links.t)),
        r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY path) AS rn FROM w WHERE term IS NOT NULL)
        SELECT f AS s_suppkey, term AS found, CAST(len(path) AS INTEGER) AS hops FROM r WHERE rn = 1""",
)
def followed(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey")
    n = s.count()
    end = F.when(F.col("s_suppkey") % 13 == 5, F.concat(F.lit("end"), F.col("s_suppkey")))
    nodes = s.withColumn("term", end)
    links = s.select(
        "s_suppkey",
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("o"), ((F.col("s_suppkey") * 7 + 3) % n).alias("t")),
                F.struct(F.lit(2).alias("o"), ((F.col("s_suppkey") + 1) % n).alias("t")),
            )
        ),
    )
    return follow_links(nodes, links, "s_suppkey", "term", "o", "t", 4)


@query(
    "g3_reachable_emits",
    """WITH e AS (SELECT 'r' || n_regionkey AS root, [n_nationkey, c_custkey, 0] AS path, c_mktsegment AS value
            FROM nation JOIN customer ON c_nationkey = n_nationkey
          UNION ALL SELECT 'r' || n_regionkey, [n_nationkey, c_custkey, o_orderkey + 1, 0], o_orderpriority
            FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey),
       m AS (SELECT root, value, min(path) AS path FROM e GROUP BY 1, 2),
       r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY path) AS emit_no FROM m)
       SELECT root, value, emit_no FROM r WHERE emit_no <= 8""",
)
def reachable(spark, d):
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    orders = table(spark, d, "orders")

    def name(letter, key):
        return F.concat(F.lit(letter), F.col(key))

    roots = table(spark, d, "region").select(name("r", "r_regionkey").alias("node"))
    edges = (
        nation.select(name("r", "n_regionkey").alias("node"), F.col("n_nationkey").cast("long").alias("o"),
                      name("n", "n_nationkey").alias("t"))
        .unionAll(customer.select(name("n", "c_nationkey"), "c_custkey", name("c", "c_custkey")))
        .unionAll(orders.select(name("c", "o_custkey"), F.col("o_orderkey") + 1, name("o", "o_orderkey")))
    )
    emits = customer.select(name("c", "c_custkey").alias("node"), F.lit(0).alias("o"), F.col("c_mktsegment").alias("v"))
    emits = emits.unionAll(orders.select(name("o", "o_orderkey"), F.lit(0), "o_orderpriority"))
    return reachable_emits(roots, edges, emits, "node", "o", "t", "v", cap=8)
