"""Ordered operators and set operations."""

from pyspark.sql import functions as F

from candex.catalog.registry import EVENTS_SQL, ITEMS_SQL, LINES, LINES_SQL, TIMES, events, items, query, table
from candex.functions.numbers import cents, int_div, join_bits
from candex.operators import windows as W
from candex.operators.areas import active_area
from candex.operators.folds import budget_greedy
from candex.plans.ordered import group_count, ordered, position

# Events numbered from 0 within their user.
NUMBERED_SQL = f"""{EVENTS_SQL}, num AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1
    AS j, count(*) OVER (PARTITION BY user_id) AS n FROM ev)"""

ORDERS_SQL = "od AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"


def _numbered(spark, d):
    rows = ordered(events(spark, d), ["user_id"], TIMES).scan(j=position(), n=group_count())
    return rows.with_columns(j=F.col("j") - 1).rows()


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", cents("o_totalprice").alias("cents"))


@query(
    "w1_strictly_increasing",
    f"""WITH {ORDERS_SQL}, r AS (SELECT o_custkey, o_orderkey, cents, max(cents) OVER (PARTITION BY o_custkey
            ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM od WHERE cents < 40000000)
        SELECT o_custkey, o_orderkey, cents FROM r WHERE top IS NULL OR cents > top""",
)
def records(spark, d):
    out = W.strictly_increasing(_orders(spark, d), ["o_custkey"], ["o_orderkey"], "cents", 40_000_000)
    return out.select("o_custkey", "o_orderkey", "cents")


@query(
    "w2_expand_index",
    f"""WITH {NUMBERED_SQL},
        c AS (SELECT user_id, event_id AS mark, CASE WHEN user_id % 10 = 0 THEN n - j ELSE j END AS first,
                     row_number() OVER (PARTITION BY user_id ORDER BY j) AS i FROM num WHERE event_type = 'signup'),
        x AS (SELECT *, lead(first) OVER (PARTITION BY user_id ORDER BY i) AS nxt FROM c),
        bad AS (SELECT DISTINCT user_id FROM x WHERE first > nxt),
        m AS (SELECT num.user_id, event_id, j, mark, i, row_number() OVER (PARTITION BY num.user_id, event_id
                     ORDER BY i DESC) AS rn FROM num JOIN c ON num.user_id = c.user_id AND first <= j)
        SELECT user_id, event_id, mark, CAST(i * 1024 + j AS BIGINT) AS code FROM m
        WHERE rn = 1 AND user_id NOT IN (SELECT user_id FROM bad)""",
)
def index_entries(spark, d):
    fine = _numbered(spark, d).select("user_id", "event_id", "event_type", "j", "n")
    first = F.when(F.col("user_id") % 10 == 0, F.col("n") - F.col("j")).otherwise(F.col("j"))
    marks = fine.where("event_type = 'signup'").withColumn("first", first)
    coarse = W.rank_candidates(marks, ["user_id"], [], ["j"]).select(
        "user_id", F.col("event_id").alias("mark"), "first", F.col("rank_no").alias("i")
    )
    rows, _ = W.expand_index(coarse, fine, ["user_id"], "i", "first", "j", ["mark", "i"])
    return rows.select("user_id", "event_id", "mark", join_bits("i", "j", 10).alias("code"))


@query(
    "w2_bad_index",
    f"""WITH {NUMBERED_SQL},
        c AS (SELECT user_id, CASE WHEN user_id % 10 = 0 THEN n - j ELSE j END AS first,
                     row_number() OVER (PARTITION BY user_id ORDER BY j) AS i FROM num WHERE event_type = 'signup'),
        x AS (SELECT *, lead(first) OVER (PARTITION BY user_id ORDER BY i) AS nxt FROM c)
        SELECT DISTINCT user_id FROM x WHERE first > nxt""",
)
def bad_index(spark, d):
    fine = _numbered(spark, d).select("user_id", "event_id", "event_type", "j", "n")
    first = F.when(F.col("user_id") % 10 == 0, F.col("n") - F.col("j")).otherwise(F.col("j"))
    coarse = fine.where("event_type = 'signup'").select("user_id", "j", first.alias("first"))
    return W.expand_index(coarse, fine, ["user_id"], "j", "first", "j", ["first"])[1]


SPANS_SQL = f"""{NUMBERED_SQL}, sp AS (SELECT user_id, event_id, cents, j AS pos,
    coalesce(lead(j) OVER (PARTITION BY user_id ORDER BY j), n) AS stop FROM num WHERE event_type = 'signup')"""


@query("w3_marks_to_spans", f"WITH {SPANS_SQL} SELECT user_id, event_id, pos, stop FROM sp")
def spans(spark, d):
    marks = _numbered(spark, d).where("event_type = 'signup'").withColumnRenamed("j", "pos")
    return W.marks_to_spans(marks, ["user_id"], "pos", "n").select("user_id", "event_id", "pos", "stop")


@query(
    "w3_first_span",
    f"""WITH {SPANS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS rn FROM sp
        WHERE cents > 5000) SELECT user_id, event_id, pos, stop FROM r WHERE rn = 1""",
)
def first_span(spark, d):
    marks = _numbered(spark, d).where("event_type = 'signup'").withColumnRenamed("j", "pos")
    out = W.first_span(marks, ["user_id"], "pos", "n", F.col("cents") > 5000)
    return out.select("user_id", "event_id", "pos", "stop")


@query(
    "w4_take_while",
    """WITH r AS (SELECT user_id, event_id, count(*) FILTER (WHERE event_type = 'error') OVER w AS bad,
            row_number() OVER w AS rn FROM events
            WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
       SELECT user_id, event_id FROM r WHERE bad = 0 AND rn <= 8""",
)
def before_errors(spark, d):
    e = table(spark, d, "events")
    return W.take_while(e, ["user_id"], TIMES, F.col("event_type") != "error", 8).select("user_id", "event_id")


TRIM_SQL = """g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
      count(*) OVER (PARTITION BY user_id) AS n FROM ev),
  h AS (SELECT *, min(pos) FILTER (WHERE NOT flat) OVER (PARTITION BY user_id) AS lo,
      max(pos) FILTER (WHERE NOT flat) OVER (PARTITION BY user_id) AS hi FROM
      (SELECT *, event_type NOT IN ('error', 'purchase') AS flat FROM g)),
  k AS (SELECT *, n // 4 AS cap, greatest(n // 60, 4) AS tol, least(coalesce(lo - 1, n), n // 4) AS a,
      least(coalesce(n - hi, n), n // 4) AS b FROM h),
  m AS (SELECT *, CASE WHEN (a >= cap AND b >= cap) OR n < 4 THEN 0 WHEN a >= cap OR b >= cap OR abs(a - b) > tol
      THEN least(a, b) ELSE a END AS top, CASE WHEN (a >= cap AND b >= cap) OR n < 4 THEN 0
      WHEN a >= cap OR b >= cap OR abs(a - b) > tol THEN least(a, b) ELSE b END AS bot FROM k)"""


@query(
    "w5_edge_trim",
    f"""WITH {EVENTS_SQL}, {TRIM_SQL} SELECT user_id, event_id FROM m WHERE pos > top - top % 2
        AND pos <= CASE WHEN bot = 0 THEN n ELSE least(n - bot + (n - bot) % 2, n) END""",
)
def trimmed(spark, d):
    e = table(spark, d, "events").withColumn("flat", ~F.col("event_type").isin("error", "purchase"))
    return W.edge_trim(e, ["user_id"], TIMES, "flat").select("user_id", "event_id")


def _lines_sql(cells: str, line: str, place: str) -> str:
    """Lines of each grid and whether they are flat and dark, on a sample of their cells."""
    return f"""(SELECT g, {line}, sum(v) <= 26 * count(*) AND count(*) * sum(v * v) - sum(v) * sum(v) <= 36 * count(*) * count(*) AS flat
      FROM (SELECT *, count(*) OVER w AS cells, min({place}) OVER w AS p0 FROM {cells} WINDOW w AS (PARTITION BY g, {line}))
      WHERE ({place} - p0) % (CASE WHEN cells >= 256 THEN 4 ELSE 2 END) = 0 GROUP BY g, {line})"""


def _bars_sql(lines: str, line: str, p: str) -> str:
    """First line, size, and the cuts at both ends."""
    return f"""(SELECT g, f AS {p}first, n AS {p}size,
        CASE WHEN n < 4 OR (a >= n // 4 AND b >= n // 4) THEN 0 WHEN odd THEN least(a, b) ELSE a END AS {p}lead,
        CASE WHEN n < 4 OR (a >= n // 4 AND b >= n // 4) THEN 0 WHEN odd THEN least(a, b) ELSE b END AS {p}trail
      FROM (SELECT *, a >= n // 4 OR b >= n // 4 OR abs(a - b) > greatest(n // 60, 4) AS odd
        FROM (SELECT g, f, n, least(coalesce(lo - f, n), n // 4) AS a, least(coalesce(t - hi, n), n // 4) AS b
          FROM (SELECT g, min({line}) AS f, max({line}) AS t, max({line}) - min({line}) + 1 AS n,
                  min({line}) FILTER (WHERE NOT flat) AS lo, max({line}) FILTER (WHERE NOT flat) AS hi FROM {lines} GROUP BY g))))"""


def _inside_sql(line: str, p: str) -> str:
    return f"{line} - {p}first >= {p}lead AND {line} - {p}first < {p}size - {p}trail"


def _even_sql(p: str) -> str:
    stop = f"({p}size - {p}trail)"
    return f"{p}lead - {p}lead % 2 AS {p}lead, CASE WHEN {p}trail = 0 THEN 0 ELSE {p}size - least({stop} + {stop} % 2, {p}size) END AS {p}trail"


@query(
    "w5_active_area",
    f"""WITH raw AS (SELECT vec_id // 64 AS g, vec_id % 64 AS r, generate_subscripts(embedding, 1) - 1 AS c, unnest(embedding) AS x
            FROM embeddings WHERE vec_id IS NOT NULL),
       cells AS (SELECT g, r, c, CASE WHEN g % 5 = 4 OR r < g * 5 % 14 OR r >= 64 - g * 5 % 14 - g % 6 OR c < g * 3 % 11
              OR c >= 64 - g * 3 % 11 - g % 3 * 2 THEN 16 + (r + c) % 2
            ELSE 40 + CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT) % 200 END AS v FROM raw WHERE x IS NOT NULL AND isfinite(x)),
       y AS {_bars_sql(_lines_sql("cells", "r", "c"), "r", "y")},
       part AS (SELECT c.* FROM cells c JOIN y USING (g) WHERE {_inside_sql("r", "y")}),
       x AS {_bars_sql(_lines_sql("part", "c", "r"), "c", "x")},
       b AS (SELECT g, yfirst, ysize, {_even_sql("y")}, xfirst, xsize, {_even_sql("x")},
            ylead + ytrail + xlead + xtrail > 0 AND xsize >= 4 AND ysize >= 4 AS bars FROM y JOIN x USING (g)),
       mid AS (SELECT g, r, c, v, count(*) OVER w AS cells, min(r) OVER w AS r0, min(c) OVER w AS c0 FROM cells JOIN b USING (g)
            WHERE bars AND {_inside_sql("r", "y")} AND {_inside_sql("c", "x")} WINDOW w AS (PARTITION BY g)),
       s AS (SELECT *, CASE WHEN cells <= 16384 THEN 1 WHEN cells <= 262144 THEN 2 ELSE 4 END AS step FROM mid),
       k AS (SELECT g, sum(v) <= 26 * count(*) AND count(*) * sum(v * v) - sum(v) * sum(v) <= 36 * count(*) * count(*) AS dark
            FROM s WHERE (r - r0) % step = 0 AND (c - c0) % step = 0 GROUP BY g),
       o AS (SELECT b.*, bars AND NOT coalesce(dark, FALSE) AS cut FROM b LEFT JOIN k USING (g))
       SELECT g, CAST(CASE WHEN cut THEN ylead ELSE 0 END AS BIGINT) AS top, CAST(CASE WHEN cut THEN xlead ELSE 0 END AS BIGINT) AS "left",
         CAST(CASE WHEN cut THEN ysize - ylead - ytrail ELSE ysize END AS BIGINT) AS height,
         CAST(CASE WHEN cut THEN xsize - xlead - xtrail ELSE xsize END AS BIGINT) AS width, cut FROM o""",
)
def framed(spark, d):
    """Vectors as lines of grids of 64, with bars whose thickness follows from the grid's number."""
    e = table(spark, d, "embeddings").where("vec_id IS NOT NULL")
    raw = e.select(int_div("vec_id", 64).alias("g"), (F.col("vec_id") % 64).alias("r"), F.posexplode("embedding").alias("c", "x"))
    raw = raw.where("x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')")
    g, r, c = F.col("g"), F.col("r"), F.col("c").cast("long")
    tall, wide = g * 5 % 14, g * 3 % 11
    bar = (g % 5 == 4) | (r < tall) | (r >= 64 - tall - g % 6) | (c < wide) | (c >= 64 - wide - g % 3 * 2)
    bright = F.floor(F.abs(F.col("x").cast("double")) * 1000).cast("long") % 200 + 40
    cells = raw.select("g", "r", c.alias("c"), F.when(bar, (r + c) % 2 + 16).otherwise(bright).alias("v"))
    return active_area(cells, ["g"], "r", "c", "v")


@query(
    "w6_cumulative_offsets",
    f"""WITH {ITEMS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
          CAST(sum(qty) OVER w - qty AS BIGINT) AS start, CAST(sum(qty) OVER w AS BIGINT) AS stop FROM li
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY {LINES_SQL} ROWS UNBOUNDED PRECEDING)""",
)
def offsets(spark, d):
    out = W.cumulative_offsets(items(spark, d), ["l_orderkey"], LINES, "qty")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "start", "stop")


@query(
    "w7_islands",
    """WITH r AS (SELECT user_id, event_id, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id
            ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events) SELECT * FROM r WHERE island > 0""",
)
def signup_islands(spark, d):
    out = W.islands(table(spark, d, "events"), ["user_id"], TIMES, F.col("event_type") == "signup")
    return out.select("user_id", "event_id", "island")


@query(
    "w8_budget_prefix",
    f"""WITH {ORDERS_SQL}, r AS (SELECT o_custkey, o_orderkey, sum(cents) OVER (PARTITION BY o_custkey
            ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS spent FROM od)
        SELECT o_custkey, o_orderkey FROM r WHERE spent <= 50000000""",
)
def affordable(spark, d):
    out = W.budget_prefix(_orders(spark, d), ["o_custkey"], ["o_orderkey"], "cents", 50_000_000)
    return out.select("o_custkey", "o_orderkey")


@query(
    "w8_budget_clipped",
    f"""WITH {ORDERS_SQL}, r AS (SELECT o_custkey, o_orderkey, cents, CAST(sum(cents) OVER (PARTITION BY o_custkey
            ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM od)
        SELECT o_custkey, o_orderkey, least(cents, 50000000 - (spent - cents)) AS taken FROM r
        WHERE spent - cents < 50000000""",
)
def affordable_clipped(spark, d):
    out = W.budget_prefix(_orders(spark, d), ["o_custkey"], ["o_orderkey"], "cents", 50_000_000, clip=True)
    return out.select("o_custkey", "o_orderkey", "taken")


@query(
    "w9_budget_greedy",
    f"""WITH RECURSIVE {ORDERS_SQL}, r AS (SELECT o_custkey, o_orderkey, cents, row_number() OVER (PARTITION BY o_custkey
            ORDER BY o_orderkey) AS rn FROM od),
          g AS (SELECT o_custkey, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS spent, 0 AS taken,
                  CAST(NULL AS BIGINT) AS hit FROM (SELECT DISTINCT o_custkey FROM od)
            UNION ALL
            SELECT r.o_custkey, r.rn,
              CASE WHEN spent + cents <= 90000000 AND taken < 6 THEN spent + cents ELSE spent END,
              CASE WHEN spent + cents <= 90000000 AND taken < 6 THEN taken + 1 ELSE taken END,
              CASE WHEN spent + cents <= 90000000 AND taken < 6 THEN r.o_orderkey END
            FROM g JOIN r ON r.o_custkey = g.o_custkey AND r.rn = g.rn + 1)
        SELECT o_custkey, hit AS o_orderkey FROM g WHERE hit IS NOT NULL""",
)
def greedy(spark, d):
    out = budget_greedy(_orders(spark, d), ["o_custkey"], ["o_orderkey"], "cents", 90_000_000, 6)
    return out.select("o_custkey", "o_orderkey")


@query(
    "w10_nested_quota",
    f"""WITH {EVENTS_SQL}, a AS (SELECT user_id, day, ts, event_id, row_number() OVER (PARTITION BY user_id, day
            ORDER BY ts, event_id) AS r1 FROM ev),
          b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r2 FROM a WHERE r1 <= 2)
        SELECT user_id, day, event_id FROM b WHERE r2 <= 10""",
)
def quotas(spark, d):
    out = W.nested_quota(events(spark, d), ["user_id"], ["day"], TIMES, 2, 10)
    return out.select("user_id", "day", "event_id")


@query(
    "w11_permille_sample",
    """WITH r AS (SELECT user_id, event_id, row_number() OVER w AS pos, count(*) OVER (PARTITION BY user_id) AS n
                  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       p(no, p) AS (VALUES (1, 250), (2, 400), (3, 150), (4, 550), (5, 700)),
       m AS (SELECT user_id, event_id, p, no, row_number() OVER (PARTITION BY user_id, event_id ORDER BY no) AS rn
             FROM r JOIN p ON (n - 1) * p // 1000 = pos - 1)
       SELECT user_id, event_id, CAST(p AS INTEGER) AS permille, CAST(no AS INTEGER) AS try_no FROM m WHERE rn = 1""",
)
def sampled(spark, d):
    out = W.permille_sample(table(spark, d, "events"), ["user_id"], TIMES)
    return out.select("user_id", "event_id", "permille", "try_no")


@query(
    "w12_cap_then_rank",
    """WITH a AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r1
                  FROM documents),
       b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank_no FROM a
             WHERE r1 <= 20)
       SELECT source, doc_id, n_chars, rank_no FROM b WHERE rank_no <= 3""",
)
def capped(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return W.cap_then_rank(docs, ["source"], ["doc_id"], 20, ["-n_chars"], 3)


@query(
    "w13_rank_candidates",
    """SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_retailprice DESC,
         p_partkey) AS rank_no FROM part""",
)
def ranked(spark, d):
    out = W.rank_candidates(table(spark, d, "part"), ["p_type"], ["-p_size", "-p_retailprice"], ["p_partkey"])
    return out.select("p_type", "p_partkey", "rank_no")


@query(
    "w14_first_acceptable_else_best",
    """WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY
            (n_chars BETWEEN 2500 AND 2600) DESC, CASE WHEN n_chars BETWEEN 2500 AND 2600 THEN doc_id END NULLS FIRST,
            n_chars DESC, doc_id) AS rn FROM documents)
       SELECT source, doc_id, n_chars FROM r WHERE rn = 1""",
)
def best_document(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    ok = F.col("n_chars").between(2500, 2600)
    return W.first_acceptable_else_best(docs, ["source"], ["doc_id"], ok, "n_chars")


@query(
    "w15_priority_fallback",
    """WITH s AS (SELECT doc_id, 'label' AS origin, 1 AS stage FROM labels WHERE quality = 1
            UNION ALL SELECT item_id, 'benchmark', 2 FROM benchmark UNION ALL SELECT doc_id, lang, 3 FROM documents),
       r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stage, origin) AS rn FROM s)
       SELECT doc_id, origin, CAST(stage AS INTEGER) AS stage FROM r WHERE rn = 1""",
)
def fallback(spark, d):
    stages = [
        table(spark, d, "labels").where("quality = 1").select("doc_id", F.lit("label").alias("origin")),
        table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("benchmark").alias("origin")),
        table(spark, d, "documents").select("doc_id", F.col("lang").alias("origin")),
    ]
    return W.priority_fallback(stages, ["doc_id"], ["origin"])


@query(
    "w16_two_view_fallback",
    f"""WITH {EVENTS_SQL}, a AS (SELECT user_id, event_id, cents FROM ev WHERE event_type = 'purchase' AND cents > 18000),
          b AS (SELECT user_id, event_id, cents FROM ev WHERE event_type = 'signup'),
          s AS (SELECT user_id FROM ev WHERE event_type = 'error' AND cents > 20000)
        SELECT *, 1 AS "view" FROM a UNION ALL SELECT *, 2 FROM b WHERE user_id NOT IN (SELECT user_id FROM a)
          AND NOT (user_id IN (SELECT user_id FROM s) AND cents > 5000)""",
)
def views(spark, d):
    e = events(spark, d).select("user_id", "event_id", "cents", "event_type")
    a = e.where("event_type = 'purchase' AND cents > 18000").drop("event_type")
    b = e.where("event_type = 'signup'").drop("event_type")
    searched = e.where("event_type = 'error' AND cents > 20000")
    return W.two_view_fallback(a, b, ["user_id"], searched, F.col("cents") > 5000)


@query(
    "w17_last_assignment",
    f"""WITH {EVENTS_SQL}, r AS (SELECT user_id, event_id, event_type, last_value(CASE WHEN event_type IN ('purchase',
            'error') THEN {{'v': CASE WHEN event_type = 'purchase' THEN cents END}} END IGNORE NULLS) OVER (PARTITION BY
            user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM ev)
        SELECT user_id, event_id, s.v AS assigned, s.v IS NOT NULL AS known FROM r WHERE event_type = 'click'""",
)
def assigned(spark, d):
    kind = F.col("event_type")
    out = W.last_assignment(
        events(spark, d), ["user_id"], TIMES, kind.isin("purchase", "error"), F.when(kind == "purchase", F.col("cents"))
    )
    return out.where(kind == "click").select("user_id", "event_id", "assigned", "known")


@query(
    "w18_choose_default",
    f"""WITH {ITEMS_SQL}, r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey
            ORDER BY CASE WHEN l_linenumber = l_orderkey % 9 THEN 0 WHEN l_linenumber = l_orderkey % 4 + 1 THEN 1
            ELSE 2 END, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn FROM li)
        SELECT l_orderkey, l_linenumber, l_partkey FROM r WHERE rn = 1""",
)
def preferred(spark, d):
    lines = items(spark, d).withColumns({"pick": F.col("l_orderkey") % 9, "hint": F.col("l_orderkey") % 4 + 1})
    out = W.choose_default(lines, ["l_orderkey"], "l_linenumber", "pick", "hint", LINES[1:])
    return out.select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "w19_start_gate",
    f"""WITH {EVENTS_SQL}, r AS (SELECT user_id, event_id, count(*) FILTER (WHERE event_type <> 'click' AND day_secs >=
            user_id % 30 * 86400) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS o FROM ev)
        SELECT user_id, event_id FROM r WHERE o > 0""",
)
def gated(spark, d):
    e = events(spark, d).withColumn("t", F.when(F.col("event_type") != "click", F.col("day_secs")))
    return W.start_gate(e, ["user_id"], TIMES, "t", F.col("user_id") % 30 * 86400).select("user_id", "event_id")


@query(
    "w20_until_marker",
    f"""WITH {EVENTS_SQL}, a AS (SELECT *, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id
            ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS o FROM ev),
          b AS (SELECT *, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e, sum(cents) OVER (PARTITION BY user_id
            ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS size FROM a WHERE o = 1)
        SELECT user_id, event_id FROM b WHERE e = 0 AND size <= 30000""",
)
def marked(spark, d):
    kind = F.col("event_type")
    out = W.until_marker(
        events(spark, d), ["user_id"], TIMES, kind == "signup", kind == "purchase", "cents", 30_000
    )
    return out.select("user_id", "event_id")


@query(
    "w21_first_match_in_group",
    f"""WITH {ITEMS_SQL}, r AS (SELECT l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_orderkey
            ORDER BY {LINES_SQL}) AS rn FROM li WHERE l_suppkey % 10 = l_orderkey % 10 AND l_orderkey % 10 <> 7)
        SELECT l_orderkey, l_linenumber, l_suppkey FROM r WHERE rn = 1""",
)
def valid_line(spark, d):
    lines = items(spark, d).withColumns({"ident": F.col("l_suppkey") % 10, "want": F.col("l_orderkey") % 10})
    out = W.first_match_in_group(lines, ["l_orderkey"], LINES, "ident", "want", 7)
    return out.select("l_orderkey", "l_linenumber", "l_suppkey")


@query(
    "u1_ordered_union_distinct",
    """WITH s AS (SELECT c_custkey, 1 AS list_no FROM customer WHERE c_mktsegment = 'BUILDING'
            UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_acctbal > 8000
            UNION ALL SELECT o_custkey, 3 FROM orders WHERE o_orderstatus = 'P')
       SELECT c_custkey, CAST(min(list_no) AS INTEGER) AS list_no FROM s GROUP BY c_custkey""",
)
def lists(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    late = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    frames = [c.where("c_mktsegment = 'BUILDING'").select("c_custkey"), c.where("c_acctbal > 8000").select("c_custkey"), late]
    return W.ordered_union_distinct(frames, ["c_custkey"], ["c_custkey"])


@query(
    "u2_limit_per_group",
    """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
                  FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE rn <= 3""",
)
def limited(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return W.limit_per_group(orders, ["o_custkey"], ["o_orderkey"], 3)
