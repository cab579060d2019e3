"""Scans, names, filters and gates."""

from pyspark.sql import functions as F

from candex.catalog.registry import EVENTS_SQL, ITEMS_SQL, events, items, query, table
from candex.functions import names as N
from candex.operators.aggregates import moments
from candex.operators.filters import (
    bounds_gate,
    checksum_gate,
    first_by_name,
    keep_where,
    quality_band,
    quarantine,
    settle_errors,
    size_gate,
)
from candex.plans import limits
from candex.plans.ordered import first_rows
from candex.sources.tables import access_report, union_views, write_selection


@query(
    "s1_load_table",
    """SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem
       WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_quantity >= 10""",
)
def load_and_filter(spark, d):
    lines = table(spark, d, "lineitem")
    since = F.lit("1997-01-01").cast("timestamp_ntz")
    return lines.where((F.col("l_shipdate") >= since) & (F.col("l_quantity") >= 10)).select(
        "l_orderkey", "l_linenumber", "l_returnflag"
    )


@query(
    "s3_write_selection",
    """SELECT p_partkey, p_type FROM (
         SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) AS rn FROM part)
       WHERE rn <= 3""",
)
def write_and_read(spark, d):
    top = first_rows(table(spark, d, "part"), ["p_type"], ["-p_size", "p_partkey"], 3)
    path = write_selection(top.select("p_partkey", "p_type"), limits.scratch_path(spark, "selection"), "p_type")
    return spark.read.schema("p_partkey BIGINT, p_type STRING").parquet(path)


@query(
    "s4_access_report",
    f"""WITH {EVENTS_SQL} SELECT user_id, count(*) AS reads, CAST(sum(cents) AS BIGINT) AS bytes,
        max(event_type) AS view FROM ev GROUP BY user_id""",
)
def report(spark, d):
    return access_report(events(spark, d), ["user_id"], "cents", "event_type")


@query(
    "s5_union_views",
    """SELECT c_custkey AS id, c_name AS name, 'customers' AS view FROM customer
       UNION ALL SELECT s_suppkey, s_name, 'suppliers' FROM supplier""",
)
def two_views(spark, d):
    return union_views(
        {
            "customers": table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
            "suppliers": table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        }
    )


@query(
    "f1_first_by_name",
    """SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer
       WHERE lower(c_mktsegment) = 'building' AND c_acctbal >= 0 GROUP BY c_nationkey""",
)
def first_named(spark, d):
    hit = first_by_name(
        table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment", "Building", ["c_custkey"], F.col("c_acctbal") >= 0
    )
    return hit.select("c_nationkey", "c_custkey")


@query(
    "f2_keep_where",
    """SELECT o_orderkey, o_orderpriority FROM orders
       WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')""",
)
def filtered(spark, d):
    wanted = (F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return keep_where(table(spark, d, "orders"), wanted).select("o_orderkey", "o_orderpriority")


@query(
    "f3_split_ext",
    r"""SELECT page_id,
          CASE WHEN contains(url, '.') THEN regexp_extract(url, '(?s)^(.*)\.[^.]*$', 1) ELSE url END AS stem,
          CASE WHEN contains(url, '.') THEN regexp_extract(url, '(?s)\.([^.]*)$', 1) ELSE '' END AS ext,
          lower(CASE WHEN contains(url, '.') THEN regexp_extract(url, '(?s)\.([^.]*)$', 1) ELSE '' END)
            IN ('html', 'htm') AS is_html,
          lower(CASE WHEN contains(url, '.') THEN regexp_extract(url, '(?s)^(.*)\.[^.]*$', 1) ELSE url END)
            IN ('http://spam-farm.example') AS is_spam
        FROM pages""",
)
def split_names(spark, d):
    both = N.split_ext("url")
    return table(spark, d, "pages").select(
        "page_id", both["stem"].alias("stem"), both["ext"].alias("ext"),
        N.has_ext("url", ["HTML", "htm"]).alias("is_html"),
        N.stem_in("url", ["HTTP://spam-farm.example"]).alias("is_spam"),
    )


@query(
    "f4_dims_from_name",
    """WITH p AS (SELECT p_partkey, CAST(p_size % 5 AS BIGINT) AS a, p_partkey % 7 AS b,
                         CAST(p_size AS BIGINT) AS c FROM part),
            q AS (SELECT p_partkey, CASE WHEN a > 0 AND b > 0 THEN a WHEN b > 0 THEN b END AS w,
                         CASE WHEN a > 0 AND b > 0 THEN b WHEN b > 0 THEN c END AS h FROM p)
       SELECT p_partkey, w, h, CAST(coalesce(w * h, 0) AS BIGINT) AS area FROM q""",
)
def dims(spark, d):
    name = F.concat(
        "p_name", F.lit("_"), (F.col("p_size") % 5).cast("string"), F.lit("x"),
        (F.col("p_partkey") % 7).cast("string"), F.lit("X"), F.col("p_size").cast("string"), F.lit(".jpg"),
    )
    out = table(spark, d, "part").select("p_partkey", N.dims_from_name(name).alias("v"))
    return out.select("p_partkey", *[F.col(f"v.{c}").cast("long").alias(c) for c in ("w", "h", "area")])


PARTY_RULES = [
    ("customer", r"(?i)^customer#([0-9]{6})([0-9]{3})$", 1, 2),
    ("supplier", r"(?i)^supplier#([0-9]{9})$", 1, None),
    ("priority", r"^([1-3])-[A-Z]+$", 1, None),
]


@query(
    "f5_classify_name",
    """SELECT c_name AS name, 'customer' AS class, CAST(c_name[10:15] AS BIGINT) AS "set",
              CAST(c_name[16:18] AS BIGINT) AS part FROM customer
       UNION ALL SELECT s_name, 'supplier', CAST(s_name[10:18] AS BIGINT), 0 FROM supplier
       UNION ALL SELECT o_orderpriority, CASE WHEN o_orderpriority < '4' THEN 'priority' END,
              CASE WHEN o_orderpriority < '4' THEN CAST(o_orderpriority[1] AS BIGINT) END,
              CASE WHEN o_orderpriority < '4' THEN 0 END FROM orders""",
)
def classified(spark, d):
    all_names = (
        table(spark, d, "customer").select(F.col("c_name").alias("name"))
        .unionAll(table(spark, d, "supplier").select("s_name"))
        .unionAll(table(spark, d, "orders").select("o_orderpriority"))
    )
    return all_names.select("name", N.classify_name("name", PARTY_RULES).alias("v")).select("name", "v.*")


@query(
    "f5_size_rank",
    """SELECT p_partkey, CAST(CASE p_type[1] WHEN 'L' THEN 0 WHEN 'M' THEN 1 WHEN 'S' THEN 2 ELSE 3 END AS INTEGER)
       AS size_rank FROM part""",
)
def size_letters(spark, d):
    name = F.concat(F.lit("J00___5"), F.substring("p_type", 1, 1), F.lit(".mp2"))
    return table(spark, d, "part").select("p_partkey", N.size_rank(name).alias("size_rank"))


@query(
    "f6_clean_name",
    r"""SELECT page_id, nullif(regexp_replace(regexp_replace(url, '(?s)[#?].*$', ''), '[/]+$', ''), '') AS name
        FROM pages""",
)
def cleaned(spark, d):
    return table(spark, d, "pages").select("page_id", N.clean_name("url", "#?", "/").alias("name"))


SIGNATURES = [
    ("html5", "<!DOCTYPE ", ["html>", "HTML>"]),
    ("html", "<html"),
    ("old", "<!DOCTYPE "),
    ("secure", "https://"),
    ("plain", "http://"),
]


@query(
    "f7_sniff_signature",
    """SELECT page_id,
         CASE WHEN starts_with(html, '<!DOCTYPE html>') OR starts_with(html, '<!DOCTYPE HTML>') THEN 'html5'
              WHEN starts_with(html, '<html') THEN 'html' WHEN starts_with(html, '<!DOCTYPE ') THEN 'old'
              ELSE 'unknown' END AS kind,
         CASE WHEN starts_with(url, 'https://') THEN 'secure' WHEN starts_with(url, 'http://') THEN 'plain'
              ELSE 'unknown' END AS scheme FROM pages""",
)
def sniffed(spark, d):
    return table(spark, d, "pages").select(
        "page_id", N.sniff_signature("html", SIGNATURES).alias("kind"),
        N.sniff_signature("url", SIGNATURES).alias("scheme"),
    )


@query("f8_size_gate", "SELECT doc_id, n_chars FROM documents WHERE coalesce(n_chars, 0) BETWEEN 1 AND 3000")
def sized(spark, d):
    return size_gate(table(spark, d, "documents"), "n_chars", 3000).select("doc_id", "n_chars")


@query(
    "f9_bounds_gate",
    "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 30 AND p_retailprice BETWEEN 910.0 AND 960.0",
)
def bounded(spark, d):
    return bounds_gate(
        table(spark, d, "part"), {"p_size": (10, 30), "p_retailprice": (910.0, 960.0)}
    ).select("p_partkey")


@query(
    "f10_quality_band",
    f"""WITH {EVENTS_SQL}, m AS (
          SELECT user_id, count(*) AS n, CAST(sum(cents) AS HUGEINT) AS s, CAST(sum(cents * cents) AS HUGEINT) AS q
          FROM ev GROUP BY user_id)
        SELECT user_id, n, CAST(s AS BIGINT) AS total FROM m
        WHERE CAST(s AS DOUBLE) / n BETWEEN 4500 AND 5500
          AND sqrt(CAST(n * q - s * s AS DOUBLE)) / n >= 4800""",
)
def band(spark, d):
    stats = moments(events(spark, d), ["user_id"], "cents")
    good = stats.where(quality_band("mean", "stddev", 4500, 5500, 4800))
    return good.select("user_id", "n", F.col("total").cast("long").alias("total"))


@query(
    "f11_quarantine",
    f"""WITH {ITEMS_SQL}, j AS (SELECT CASE WHEN qty <= 0 THEN 'corrupt' WHEN qty > 45 THEN 'too large'
            WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'unsupported'
            WHEN price < qty * 2000 THEN 'corrupt' ELSE 'ok' END AS status,
          CASE WHEN qty <= 0 THEN 'no quantity' WHEN qty > 45 THEN 'quantity above 45'
            WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'returned and open'
            WHEN price < qty * 2000 THEN 'cheap' ELSE '' END AS reason FROM li)
        SELECT status, reason, count(*) AS n FROM j GROUP BY 1, 2""",
)
def quarantined(spark, d):
    rules = [
        ("corrupt", "no quantity", F.col("qty") <= 0),
        ("too large", "quantity above 45", F.col("qty") > 45),
        ("unsupported", "returned and open", (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")),
        ("corrupt", "cheap", F.col("price") < F.col("qty") * 2000),
    ]
    good, bad = quarantine(items(spark, d), rules)
    both = bad.select("status", "reason").unionAll(good.select(F.lit("ok"), F.lit("")))
    return both.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f11_settle_errors",
    """WITH a AS (SELECT doc_id, CASE WHEN n_chars > 2000 THEN 'too large' ELSE 'corrupt' END AS status,
                    'first ' || lang AS reason FROM documents),
            b AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'not found' ELSE 'no volume' END AS status,
                    'second' AS reason FROM labels)
       SELECT doc_id, CASE WHEN b.status = 'no volume' THEN a.status ELSE b.status END AS status,
         CASE WHEN b.status = 'no volume' THEN a.reason ELSE b.reason END AS reason FROM a JOIN b USING (doc_id)""",
)
def settled(spark, d):
    first = table(spark, d, "documents").select(
        "doc_id", F.when(F.col("n_chars") > 2000, "too large").otherwise("corrupt").alias("status"),
        F.concat(F.lit("first "), "lang").alias("reason"),
    )
    second = table(spark, d, "labels").select(
        "doc_id", F.when(F.col("quality") == 0, "not found").otherwise("no volume").alias("status"),
        F.lit("second").alias("reason"),
    )
    return settle_errors(first, second, ["doc_id"])


@query(
    "f12_checksum_gate",
    """WITH b AS (SELECT c_custkey, c_name, c_nationkey, unnest(string_split(c_name, '')) AS c FROM customer)
       SELECT c_custkey, c_name FROM b GROUP BY c_custkey, c_name, c_nationkey
       HAVING sum(ascii(c)) % 256 = 37 + c_nationkey""",
)
def checked(spark, d):
    kept = checksum_gate(table(spark, d, "customer"), "c_name", F.col("c_nationkey") + 37)
    return kept.select("c_custkey", "c_name")
