"""Aggregations."""

from pyspark.sql import functions as F

from candex.catalog.registry import EVENTS_SQL, ITEMS_SQL, LINES, TIMES, events, items, query, table
from candex.functions.numbers import cents
from candex.operators import aggregates as A


@query(
    "a1_group_parts",
    f"""WITH {ITEMS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY
            l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn FROM li),
          p AS (SELECT l_orderkey, l_linenumber - 1 AS part, qty FROM o WHERE rn = 1)
        SELECT l_orderkey, max(CASE WHEN part = 0 THEN qty END) AS menu_size,
          coalesce(string_agg(part || ':' || qty, ',' ORDER BY part) FILTER (WHERE part <> 0 AND qty > 0), '') AS parts,
          CAST(coalesce(sum(qty) FILTER (WHERE part <> 0 AND qty > 0), 0) AS BIGINT) AS total
        FROM p GROUP BY l_orderkey""",
)
def parts_of_orders(spark, d):
    lines = items(spark, d).withColumn("part", F.col("l_linenumber") - 1)
    sets = A.group_parts(lines, ["l_orderkey"], "part", "qty", LINES)
    shown = F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["part"], p["size"])), ",")
    return sets.withColumn("parts", shown)


@query(
    "a2_top_groups",
    f"""WITH {ITEMS_SQL}, s AS (SELECT p_brand, l_partkey, CAST(sum(qty) AS BIGINT) AS total
            FROM li JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING sum(qty) >= 100),
          r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY total DESC, l_partkey) AS rn FROM s)
        SELECT p_brand, l_partkey, total FROM r WHERE rn <= 3""",
)
def largest_parts(spark, d):
    lines = items(spark, d).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return A.top_groups(lines, ["l_partkey"], "qty", 3, ["p_brand"], minimum=100)


@query(
    "a2_top_groups_overall",
    f"""WITH {ITEMS_SQL} SELECT l_suppkey, CAST(sum(qty) AS BIGINT) AS total FROM li GROUP BY 1
        ORDER BY total DESC, l_suppkey LIMIT 5""",
)
def largest_suppliers(spark, d):
    return A.top_groups(items(spark, d), ["l_suppkey"], "qty", 5)


MOMENTS_SQL = """n, CAST(s AS BIGINT) AS total, CAST(q AS BIGINT) AS squares, round(CAST(s AS DOUBLE) / n, 6) AS mean,
    round(sqrt(CAST(n * q - s * s AS DOUBLE)) / n, 6) AS stddev"""


def _rounded(df):
    return df.withColumns(
        {
            "total": F.col("total").cast("long"), "squares": F.col("squares").cast("long"),
            "mean": F.round("mean", 6), "stddev": F.round("stddev", 6),
        }
    )


@query(
    "a3_moments",
    f"""WITH {ITEMS_SQL}, m AS (SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(qty) AS HUGEINT) AS s,
            CAST(sum(qty * qty) AS HUGEINT) AS q FROM li GROUP BY 1, 2)
        SELECT l_returnflag, l_linestatus, {MOMENTS_SQL} FROM m""",
)
def quantity_moments(spark, d):
    return _rounded(A.moments(items(spark, d), ["l_returnflag", "l_linestatus"], "qty"))


LARGE = 3_000_000_019


@query(
    "a3_moments_large",
    f"""WITH {ITEMS_SQL}, v AS (SELECT l_returnflag, CAST(qty * {LARGE} - 70000000000 AS HUGEINT) AS x FROM li)
        SELECT l_returnflag, count(*) AS n, CAST(sum(x) AS VARCHAR) AS total, CAST(sum(x * x) AS VARCHAR) AS squares
        FROM v GROUP BY 1""",
)
def large_moments(spark, d):
    values = items(spark, d).withColumn("x", F.col("qty") * LARGE - 70_000_000_000)
    found = A.moments(values, ["l_returnflag"], "x")
    return found.select("l_returnflag", "n", F.col("total").cast("string").alias("total"), F.col("squares").cast("string").alias("squares"))


@query(
    "a4_grid_moments",
    f"""WITH {ITEMS_SQL}, g AS (SELECT *, count(*) OVER w AS cells, min(l_orderkey) OVER w AS r0,
            min(l_linenumber) OVER w AS c0 FROM li WINDOW w AS (PARTITION BY l_returnflag)),
          t AS (SELECT *, CASE WHEN cells <= 16384 THEN 1 WHEN cells <= 262144 THEN 2 ELSE 4 END AS step FROM g),
          m AS (SELECT l_returnflag, step, count(*) AS n, CAST(sum(qty) AS HUGEINT) AS s,
                CAST(sum(qty * qty) AS HUGEINT) AS q FROM t
                WHERE (l_orderkey - r0) % step = 0 AND (l_linenumber - c0) % step = 0 GROUP BY 1, 2)
        SELECT l_returnflag, step, {MOMENTS_SQL} FROM m""",
)
def grid(spark, d):
    return _rounded(A.grid_moments(items(spark, d), ["l_returnflag"], "l_orderkey", "l_linenumber", "qty"))


@query(
    "a5_flat_lines",
    f"""WITH {EVENTS_SQL}, g AS (SELECT day, hour, event_id, cents // 100 AS v, count(*) OVER w AS cells,
            min(event_id) OVER w AS p0 FROM ev WINDOW w AS (PARTITION BY day, hour)),
          t AS (SELECT *, CASE WHEN cells >= 256 THEN 4 ELSE 2 END AS step FROM g),
          m AS (SELECT day, hour, count(*) AS n, CAST(sum(v) AS HUGEINT) AS s, CAST(sum(v * v) AS HUGEINT) AS q
                FROM t WHERE (event_id - p0) % step = 0 GROUP BY 1, 2)
        SELECT day, hour, n, CAST(s AS BIGINT) AS total, s <= 40 * n AND n * q - s * s <= 900 * n * n AS flat FROM m""",
)
def flat_hours(spark, d):
    e = events(spark, d).withColumn("v", F.call_function("div", F.col("cents"), F.lit(100)))
    lines = A.flat_lines(e, ["day"], "hour", "event_id", "v", max_mean=40, max_variance=900)
    return lines.select("day", "hour", "n", F.col("total").cast("long").alias("total"), "flat")


@query(
    "a6_box_reduce",
    f"""WITH {EVENTS_SQL}, c AS (SELECT event_type, day, hour, CAST(sum(cents) AS BIGINT) AS v FROM ev GROUP BY 1, 2, 3)
        SELECT event_type, day // 2 AS box_row, hour // 2 AS box_col, CAST((sum(v) + 2) // 4 AS BIGINT) AS value
        FROM c GROUP BY 1, 2, 3 HAVING count(*) = 4""",
)
def boxes(spark, d):
    cells = events(spark, d).groupBy("event_type", "day", "hour").agg(F.sum("cents").alias("v"))
    return A.box_reduce(cells, ["event_type"], "day", "hour", "v", 2)


@query(
    "a7_damage_gate",
    """SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS bad, count(*) AS total
       FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'error') * 5 <= count(*)""",
)
def damaged(spark, d):
    bad = F.when(F.col("event_type") == "error", 1).otherwise(0)
    return A.damage_gate(table(spark, d, "events"), ["user_id"], bad, F.lit(1), ratio=5)


@query(
    "a8_stream_verdict",
    f"""WITH {EVENTS_SQL}, r AS (SELECT user_id, day, event_type = 'error' AS p,
            count(*) FILTER (WHERE event_type = 'error') OVER w AS np,
            count(*) FILTER (WHERE event_type <> 'error') OVER w AS nc FROM ev
            WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
          s AS (SELECT user_id, day, count(*) FILTER (WHERE NOT p) AS clear, count(*) FILTER (WHERE p) AS
            protected_rows, bool_or(nc = 0 AND np >= 2) AS early FROM r GROUP BY 1, 2)
        SELECT *, CASE WHEN early OR (protected_rows > 0 AND clear = 0) THEN 'protected' ELSE 'nothing' END AS verdict,
          clear > 0 AS saw_video FROM s""",
)
def verdicts(spark, d):
    e = events(spark, d).withColumn("bad", F.col("event_type") == "error")
    return A.stream_verdict(e, ["user_id", "day"], TIMES, "bad", limit=2)


@query(
    "a9_reconcile_size",
    f"""WITH {ITEMS_SQL}, s AS (SELECT l_orderkey, CAST(sum(price) AS BIGINT) AS total FROM li GROUP BY 1),
          o AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS declared FROM orders)
        SELECT o_orderkey, declared, coalesce(total, 0) AS described, least(declared, coalesce(total, 0)) AS deliverable,
          CASE WHEN declared > coalesce(total, 0) THEN 'oversize' ELSE 'ok' END AS status
        FROM o LEFT JOIN s ON o_orderkey = l_orderkey""",
)
def reconciled(spark, d):
    files = table(spark, d, "orders").select("o_orderkey", cents("o_totalprice").alias("declared"))
    parts = items(spark, d).withColumnRenamed("l_orderkey", "o_orderkey")
    return A.reconcile_size(files, parts, "o_orderkey", "declared", "price")


@query(
    "a10_latest_version",
    f"""WITH {EVENTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
            ORDER BY day DESC, event_id DESC) AS rn FROM ev)
        SELECT user_id, event_type, event_id, cents FROM r WHERE rn = 1""",
)
def latest(spark, d):
    out = A.latest_version(events(spark, d), ["user_id", "event_type"], "day", ["event_id"])
    return out.select("user_id", "event_type", "event_id", "cents")


@query(
    "a11_dedup_first",
    """WITH r AS (SELECT user_id, event_id, event_type,
            row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events)
       SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS kind
       FROM r WHERE rn = 1""",
)
def first_events(spark, d):
    kind = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    e = table(spark, d, "events").withColumn("kind", kind)
    return A.dedup_first(e, ["user_id", "kind"], TIMES, fold_case=True).select("user_id", "event_id", "kind")


FRAGMENTS_SQL = """a AS (SELECT *, role = 'user' AS f, role = 'assistant' AS l FROM conversations),
  b AS (SELECT *, count(*) FILTER (WHERE f) OVER w AS fragment,
          count(*) FILTER (WHERE l) OVER w - CAST(l AS INTEGER) AS ends FROM a
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
  c AS (SELECT *, max(CASE WHEN f THEN ends END) OVER (PARTITION BY conv_id, fragment) AS base,
          max(fragment) OVER (PARTITION BY conv_id) AS top FROM b WHERE fragment > 0),
  frag AS (SELECT conv_id, fragment, top, count(*) AS parts, string_agg(text, ' | ' ORDER BY turn) AS text,
          bool_or(l) AS complete FROM c WHERE ends = base GROUP BY 1, 2, 3)"""


def _fragments(spark, d, mode):
    turns = table(spark, d, "conversations").select(
        "conv_id", "turn", (F.col("role") == "user").alias("opens"), (F.col("role") == "assistant").alias("closes"),
        "text",
    )
    return A.reassemble(turns, ["conv_id"], ["turn"], "opens", "closes", "text", mode, " | ")


@query("a12_reassemble_close", f"WITH {FRAGMENTS_SQL} SELECT conv_id, fragment, parts, text, complete FROM frag")
def fragments_closed(spark, d):
    return _fragments(spark, d, "close")


@query(
    "a12_reassemble_replace",
    f"WITH {FRAGMENTS_SQL} SELECT conv_id, fragment, parts, text, complete FROM frag WHERE fragment = top",
)
def fragments_replaced(spark, d):
    return _fragments(spark, d, "replace")


@query(
    "a12_reassemble_stop",
    f"WITH {FRAGMENTS_SQL} SELECT conv_id, fragment, parts, text, complete FROM frag WHERE fragment = 1",
)
def fragments_stopped(spark, d):
    return _fragments(spark, d, "stop")


@query(
    "a13_chunk_coverage",
    f"""WITH {ITEMS_SQL}, r AS (SELECT l_suppkey, l_partkey * 1000 AS o, qty * 1000 AS n FROM li WHERE qty > 0),
          c AS (SELECT DISTINCT l_suppkey, unnest(range(o // 32768, (o + n - 1) // 32768 + 1)) AS chunk FROM r
                WHERE n < 32768),
          k AS (SELECT l_suppkey, count(*) AS chunks FROM c GROUP BY 1),
          x AS (SELECT l_suppkey, count(*) AS direct_reads, CAST(sum(n) AS BIGINT) AS direct_bytes FROM r
                WHERE n >= 32768 GROUP BY 1)
        SELECT l_suppkey, coalesce(chunks, 0) AS chunks, coalesce(direct_reads, 0) AS direct_reads,
          coalesce(direct_bytes, 0) AS direct_bytes, coalesce(chunks, 0) * 32768 + coalesce(direct_bytes, 0) AS bytes
        FROM k FULL JOIN x USING (l_suppkey)""",
)
def coverage(spark, d):
    reads = items(spark, d).select("l_suppkey", (F.col("l_partkey") * 1000).alias("o"), (F.col("qty") * 1000).alias("n"))
    return A.chunk_coverage(reads, ["l_suppkey"], "o", "n")
