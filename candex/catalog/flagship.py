"""The question the library is about: which row stands for each input?"""

from pyspark.sql import functions as F

from candex.catalog.registry import EVENTS_SQL, ITEMS_SQL, LINES, LINES_SQL, events, items, query, table
from candex.functions.numbers import int_div
from candex.operators.aggregates import group_parts, top_groups
from candex.operators.filters import quarantine, size_gate
from candex.operators.lookups import anti_seen, coalesce_backup, entry_ranges, locate_offset
from candex.operators.windows import (
    first_acceptable_else_best,
    limit_per_group,
    nested_quota,
    ordered_union_distinct,
    permille_sample,
    rank_candidates,
)
from candex.plans import limits
from candex.plans.joins import ranks_join
from candex.sources.tables import access_report

@query(
    "q1_best_documents",
    """WITH g AS (SELECT source, doc_id, lang, n_chars FROM documents WHERE coalesce(n_chars, 0) BETWEEN 1 AND 20000
                  AND lang IN ('en', 'fr', 'de') AND length(text) > 0),
       k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank_no FROM g),
       t AS (SELECT *, n_chars BETWEEN 1000 AND 2000 AS ok FROM k),
       b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ok DESC, CASE WHEN ok THEN rank_no END NULLS FIRST,
             n_chars DESC, rank_no) AS rn FROM t),
       a AS (SELECT source, count(*) AS reads, CAST(sum(n_chars) AS BIGINT) AS bytes FROM t GROUP BY source)
       SELECT source, doc_id, n_chars, rank_no, reads, bytes FROM b JOIN a USING (source) WHERE rn = 1""",
)
def best_documents(spark, d):
    """Size gate, quarantine, rank of all candidates, first acceptable else best, access report."""
    docs = table(spark, d, "documents").select(
        "source", "doc_id", "lang", "n_chars", F.length("text").alias("n_text")
    )
    rules = [
        ("corrupt", "no text", F.col("n_text") == 0),
        ("unsupported", "language", ~F.col("lang").isin("en", "fr", "de")),
    ]
    good, _ = quarantine(size_gate(docs, "n_chars", 20_000), rules)
    tried = rank_candidates(good, ["source"], ["-n_chars"], ["doc_id"])
    ok = F.col("n_chars").between(1000, 2000)
    best = first_acceptable_else_best(tried, ["source"], ["rank_no"], ok, "n_chars")
    report = access_report(tried, ["source"], "n_chars")
    return best.join(report, "source").select("source", "doc_id", "n_chars", "rank_no", "reads", "bytes")


# Places tried in a set, in per mille of its length.
PLACES = ((1, 250), (2, 400), (3, 700))


@query(
    "q2_group_search",
    f"""WITH {ITEMS_SQL}, l AS (SELECT o_custkey, li.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINES_SQL}) AS part
            FROM li JOIN orders ON l_orderkey = o_orderkey),
          once AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINES_SQL}) AS rn FROM l),
          sets AS (SELECT o_custkey, l_orderkey, sum(qty) FILTER (WHERE l_linenumber <> 1 AND qty > 0) AS total FROM once
            WHERE rn = 1 GROUP BY 1, 2),
          top AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY total DESC, l_orderkey) AS r FROM sets
            WHERE total >= 20),
          listed AS (SELECT o_custkey, o_orderkey AS l_orderkey, 1 AS list_no FROM orders WHERE o_orderpriority = '1-URGENT'
            UNION ALL SELECT o_custkey, l_orderkey, 2 FROM top WHERE r <= 2),
          q1 AS (SELECT o_custkey, l_orderkey, min(list_no) AS list_no FROM listed GROUP BY 1, 2),
          q2 AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, list_no ORDER BY l_orderkey) AS r1 FROM q1),
          q3 AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY list_no, l_orderkey) AS r2 FROM q2 WHERE r1 <= 2),
          q AS (SELECT o_custkey, l_orderkey, list_no FROM q3 WHERE r2 <= 3),
          ends AS (SELECT *, sum(qty) OVER (PARTITION BY l_orderkey ORDER BY part) AS e FROM l),
          size AS (SELECT l_orderkey, sum(qty) AS n FROM l GROUP BY 1),
          t AS (SELECT q.*, try_no, (n - 1) * p // 1000 AS pos FROM q JOIN size USING (l_orderkey)
            CROSS JOIN (VALUES (1, 250), (2, 400), (3, 700)) AS v(try_no, p)),
          h AS (SELECT t.o_custkey, 1 AS stage, list_no, t.l_orderkey, try_no, part, price FROM t
            JOIN ends ON ends.l_orderkey = t.l_orderkey AND e - qty <= pos AND pos < e),
          u AS (SELECT q.o_custkey, 2 AS stage, list_no, q.l_orderkey, part AS try_no, part, price FROM q JOIN l USING (l_orderkey)
            WHERE (q.l_orderkey, part) NOT IN (SELECT (l_orderkey, part) FROM h)),
          c AS (SELECT *, price BETWEEN 2000000 AND 3000000 AS ok FROM (FROM h UNION ALL FROM u)),
          b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY ok DESC, CASE WHEN ok THEN 0 ELSE -price END, stage,
            list_no, l_orderkey, try_no) AS rn FROM c)
        SELECT o_custkey, l_orderkey, CAST(part AS BIGINT) AS part, price, CAST(stage AS INTEGER) AS stage,
          CAST(list_no AS INTEGER) AS list_no, ok FROM b WHERE rn = 1""",
)
def group_search(spark, d):
    """The whole search for each customer: sets of parts, queue, quotas, sampled places, last resort, choice."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    # Sorted rows carry no more than the search reads.
    bought = items(spark, d).select("l_orderkey", *LINES, "qty", "price").join(orders.drop("o_orderpriority"), "l_orderkey")
    lines = rank_candidates(bought, ["l_orderkey"], [], LINES)
    # Read for the sets, the lengths, the places, the prices and the last resort.
    lines = limits.pin(lines.withColumnRenamed("rank_no", "part"))
    sets = group_parts(lines.withColumn("part", F.col("l_linenumber") - 1), ["o_custkey", "l_orderkey"], "part", "qty", LINES)
    largest = top_groups(sets, ["l_orderkey"], "total", 2, ["o_custkey"], minimum=20)
    urgent = orders.where("o_orderpriority = '1-URGENT'")
    names = ["o_custkey", "l_orderkey"]
    queue = ordered_union_distinct([urgent.select(names), largest.select(names)], names, ["l_orderkey"])
    queue = limits.pin(nested_quota(queue, ["o_custkey"], ["list_no"], ["list_no", "l_orderkey"], 2, 3))

    lengths = lines.groupBy("l_orderkey").agg(F.sum("qty").alias("n"))
    tries = F.explode(F.array(*[F.struct(F.lit(no).alias("no"), F.lit(p).alias("p")) for no, p in PLACES])).alias("t")
    wanted = queue.join(lengths, "l_orderkey").select(*names, "list_no", "n", tries)
    wanted = wanted.select(*names, "list_no", F.col("t.no").cast("long").alias("try_no"), int_div((F.col("n") - 1) * F.col("t.p"), 1000).alias("pos"))
    found = locate_offset(wanted, lines, "l_orderkey", "pos", ["part"], "qty", "part").where(~F.col("at_end"))
    prices = lines.select("l_orderkey", "part", "price")
    tried = found.join(prices, ["l_orderkey", "part"]).withColumn("stage", F.lit(1))
    rest = anti_seen(queue.join(prices, "l_orderkey"), found, ["l_orderkey", "part"])
    rest = rest.withColumns({"try_no": F.col("part"), "stage": F.lit(2)})
    columns = [*names, "list_no", "stage", "try_no", "part", "price"]
    ok = F.col("price").between(2_000_000, 3_000_000)
    attempts = tried.select(columns).unionByName(rest.select(columns))
    best = first_acceptable_else_best(attempts, ["o_custkey"], ["stage", "list_no", "l_orderkey", "try_no"], ok, "price")
    return best.select("o_custkey", "l_orderkey", "part", "price", "stage", "list_no", ok.alias("ok"))


@query(
    "q3_interval_search",
    f"""WITH {EVENTS_SQL},
          it AS (SELECT user_id, event_id AS item, CASE WHEN cents > 5000 THEN 'primary' ELSE 'backup' END AS origin,
              CASE WHEN cents > 5000 THEN day_secs ELSE day_secs - 86400 END AS t0,
              CASE WHEN cents > 5000 THEN day_secs + 86400 ELSE day_secs END AS t1
            FROM ev WHERE event_type = 'purchase' AND (cents > 5000 OR day_secs >= 86400)),
          en AS (SELECT user_id, event_id AS entry, day_secs AS t, cents FROM ev WHERE event_type IN ('view', 'click')),
          w AS (SELECT it.user_id, item, origin, entry, cents FROM it JOIN en USING (user_id)
            WHERE t >= greatest(t0 - 255, 0) AND t < t1),
          r AS (SELECT * FROM it WHERE item NOT IN (SELECT item FROM w)),
          s AS (SELECT user_id, item, origin, max(entry) AS entry FROM r JOIN en USING (user_id) WHERE t <= t0 GROUP BY 1, 2, 3),
          pairs AS (SELECT *, 'within' AS rule FROM w
            UNION ALL SELECT s.user_id, item, origin, entry, cents, 'start' FROM s JOIN en USING (entry)
            UNION ALL SELECT r.user_id, item, origin, entry, cents, 'all' FROM r JOIN en USING (user_id)
              WHERE item NOT IN (SELECT item FROM s)),
          big AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, item) AS k
            FROM (SELECT user_id, item, count(*) AS n FROM pairs GROUP BY 1, 2)),
          p AS (SELECT pairs.*, row_number() OVER w AS pos, count(*) OVER (PARTITION BY pairs.user_id, item) AS n
            FROM pairs JOIN big USING (user_id, item) WHERE k <= 3 WINDOW w AS (PARTITION BY pairs.user_id, item ORDER BY entry)),
          places(no, p) AS (VALUES (1, 250), (2, 400), (3, 150), (4, 550), (5, 700)),
          m AS (SELECT p.* EXCLUDE (n, pos), places.no AS try_no, row_number() OVER (PARTITION BY user_id, item, entry ORDER BY no) AS met
            FROM p JOIN places ON (n - 1) * places.p // 1000 = pos - 1),
          c AS (SELECT *, cents BETWEEN 3000 AND 6000 AS ok FROM m WHERE met = 1),
          b AS (SELECT *, row_number() OVER (PARTITION BY user_id, item ORDER BY ok DESC, CASE WHEN ok THEN 0 ELSE -cents END,
            try_no) AS rn FROM c)
        SELECT user_id, item, origin, rule, entry, cents, CAST(try_no AS INTEGER) AS try_no FROM b WHERE rn = 1""",
)
def interval_search(spark, d):
    """The search by time for each user: windows with a backup, entries in them, largest windows, places, choice."""
    e = events(spark, d)
    bought = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("item"), "day_secs", "cents")
    own = bought.select("user_id", "item", F.col("day_secs").alias("t0"), (F.col("day_secs") + 86400).alias("t1"), (F.col("cents") > 5000).alias("good"))
    spare = bought.select("user_id", "item", (F.col("day_secs") - 86400).alias("t0"), F.col("day_secs").alias("t1"), (F.col("day_secs") >= 86400).alias("good"))
    windows = coalesce_backup(own, spare, ["user_id", "item"], lambda c: c("good"))
    seen = e.where("event_type IN ('view', 'click')").select("user_id", F.col("event_id").alias("entry"), F.col("day_secs").alias("t"), "cents")
    # The ranges tell how many entries a window has: only the largest are joined to theirs.
    ranges, ranked = entry_ranges(windows, seen, ["user_id"], "item", "t0", "t1", "t", ["entry"], ["entry", "cents"])
    sizes = ranges.withColumn("n", F.col("last") - F.col("first") + 1)
    pairs = ranks_join(limit_per_group(sizes, ["user_id"], ["-n", "item"], 3), ranked, ["user_id"], "first", "last")
    pairs = pairs.select("user_id", "item", "_point.*", "rule")
    sampled = permille_sample(pairs, ["user_id", "item"], ["entry"])
    ok = F.col("cents").between(3000, 6000)
    best = first_acceptable_else_best(sampled, ["user_id", "item"], ["try_no"], ok, "cents")
    return best.join(windows.select("item", "origin"), "item").select("user_id", "item", "origin", "rule", "entry", "cents", "try_no")
