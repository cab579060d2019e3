"""The operators as queries on the test tables, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candex.llm.exact import DigestIndex, digest
from candex.llm.language import bucket, fit_languages, predict_language
from candex.llm.lines import drop_repeated_lines
from candex.llm.minhash import near_duplicates
from candex.llm.mixing import plan_mixture, word_count
from candex.llm.ngrams import fit_bigrams, held_out, score_texts
from candex.llm.packing import pack
from candex.llm.phrases import collocations
from candex.llm.secrets import find_secrets, listed
from candex.llm.tokens import read_tokens, write_tokens
from candex.llm.urls import UrlRules, judge_urls
from candex.llm.vectors import near_vectors
from candex.llm.whitening import whiten
from candex.sources.tables import load_table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a query and the SQL that gives the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op9_exact_dedup", r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS size,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r""")
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents against an empty index, which then holds them."""
    found = DigestIndex.open(spark).admit(load_table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op3_minhash_near_dedup")
def minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents linked by 80 % of their four-word runs."""
    return near_duplicates(load_table(spark, folder, "documents"), words=4, percent=80)


@query("op7_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from two thirds of the labels."""
    docs = load_table(spark, folder, "documents").select("doc_id", "lang", "text", (bucket("doc_id", 3) == 1).alias("held_out"))
    model = fit_languages(docs, ~F.col("held_out"))
    return predict_language(docs, model, ["doc_id", "held_out"])


@query("op2_curriculum_mix", r"""
WITH d AS (SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS mark,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place, source_size * 3 AS cap FROM s),
w AS (SELECT *, place % 3 + 1.0::DOUBLE AS weight FROM p),
o AS (SELECT *, sum(source_size) OVER () AS total,
    cap * sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
      <= (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         * weight AS short FROM w),
c AS (SELECT *, bool_and(short) OVER (ORDER BY cap / weight, place ROWS UNBOUNDED PRECEDING) AS capped FROM o),
t AS (SELECT source, source_size, place, CASE WHEN capped THEN cap::DOUBLE ELSE
    weight * (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT capped THEN weight END) OVER () END AS target FROM c),
l AS (SELECT doc_id, size, source_size, target, place,
    sum(size) OVER (PARTITION BY d.source ORDER BY mark, doc_id, size ROWS UNBOUNDED PRECEDING) - size + size / 2 AS middle
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CAST((middle < target)::INT + (middle + source_size < target)::INT + (middle + source_size * 2 < target)::INT AS BIGINT) AS takes,
    middle / target AS share, place % 3 AS kind FROM l)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * takes AS BIGINT) AS taken, takes,
    round(CASE WHEN takes = 0 THEN NULL WHEN kind = 0 THEN coalesce(2 * share / (0.5 + sqrt(0.25 + 2 * share)), 0)
      WHEN kind = 1 THEN share ELSE 2 * (share * 3) / (4.0 + sqrt(16.0 + 2 * -2.0 * (share * 3))) END, 9) AS first_position FROM k""")
def curriculum_mix(spark: SparkSession, folder: str) -> DataFrame:
    """What a mix of weights 1, 2, 3 along a curriculum takes of every document."""
    plan = plan_mixture(load_table(spark, folder, "documents"))
    first = F.round(F.try_element_at("positions", F.lit(1)), 9)
    return plan.select(
        "doc_id", "size", "source_size", "target", "taken", F.size("positions").cast("long").alias("takes"), first.alias("first_position")
    )


@query("op8_conflict_packing")
def conflict_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in bins of 2048 words, equal texts apart, at most two of a source together."""
    docs = load_table(spark, folder, "documents")
    return pack(docs.select("doc_id", "source", word_count("text").alias("size"), digest("text").alias("cluster")))


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op4_url_filter", r"""
WITH rules(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
    ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
m AS (SELECT page_id, host, path, arg_max(rhost || rpath, len(rhost || rpath)) AS rule, arg_max(rverdict, len(rhost || rpath)) AS rv
    FROM p LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM m""")
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's URL under four rules."""
    rules = UrlRules.build(spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))
    return judge_urls(load_table(spark, folder, "pages"), rules, ["page_id"])


@query("op10_line_dedup", r"""
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM s),
k AS (SELECT *, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM x),
f AS (SELECT doc_id, pos, row_number() OVER w AS i, t, lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2,
    lead(pos, 1) OVER w AS pos1, lead(pos, 2) OVER w AS pos2 FROM k WHERE t <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
w AS (SELECT doc_id, i, [pos, pos1, pos2] AS covers, t || chr(10) || t1 || chr(10) || t2 AS win FROM f WHERE t2 IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n, count(*) OVER (PARTITION BY win) AS copies FROM w),
cut AS (SELECT doc_id, unnest(covers) AS pos FROM r WHERE n > 1
    EXCEPT SELECT doc_id, unnest(covers) FROM r WHERE n = 1 AND copies > 1),
l AS (SELECT x.doc_id, string_agg(line, chr(10) ORDER BY x.pos) FILTER (cut.pos IS NULL) AS bare, count(cut.pos) AS n_removed
    FROM x LEFT JOIN cut ON x.doc_id = cut.doc_id AND x.pos = cut.pos GROUP BY x.doc_id)
SELECT s.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed,
    CASE WHEN text IS NOT NULL THEN coalesce(bare, '') END AS text FROM s LEFT JOIN l ON s.doc_id = l.doc_id""")
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the later occurrences of repeated three-line windows."""
    return drop_repeated_lines(load_table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


@query("op6_kneser_ney")
def kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    """Every document scored by the bigrams of nine tenths of them."""
    docs = load_table(spark, folder, "documents").select("doc_id", "text", held_out().alias("held_out"))
    return score_texts(docs, fit_bigrams(docs.where(~F.col("held_out"))), ["doc_id", "held_out"])


@query("op5_nn_descent", """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""")
def nn_descent(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors linked with those of their label at a cosine of 0.98."""
    return near_vectors(load_table(spark, folder, "embeddings"))


@query("op1_token_files")
def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as token ids, written to files and read back."""
    files = write_tokens(load_table(spark, folder, "documents"))
    return read_tokens(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op11_jacobi_davidson")
def jacobi_davidson(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors whitened along the 32 leading eigenvectors of their covariance."""
    return whiten(load_table(spark, folder, "embeddings"))


@query("op12_secret_scan")
def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Assignments, access keys, hexadecimal strings and random strings in all documents."""
    found = find_secrets(load_table(spark, folder, "documents"), ["doc_id"])
    base = ("assign", "access", "hex")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, base), F.sha2(listed("spans", base), 256).alias("base_sha256"), listed("spans").alias("spans"))


@query("op13_collocations", r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
    FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS pos FROM p),
g AS (SELECT lang, ws[pos : pos + k - 1] AS gram, k FROM i, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE pos + k - 1 <= len(ws)),
f AS MATERIALIZED (SELECT lang, gram, k, count(*) AS f FROM g GROUP BY lang, gram, k HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
u AS MATERIALIZED (SELECT lang, gram, k, f AS a, cut, gram[1 : cut] AS lg, gram[cut + 1 : k] AS rg
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k > 1)),
x AS (SELECT u.*, n.n, l.f AS l, r.f AS r, CAST(1000 * a::HUGEINT * n.n // (l.f::HUGEINT * r.f) AS BIGINT) AS score
    FROM u JOIN n ON u.lang = n.lang JOIN f l ON l.lang = u.lang AND l.gram = u.lg JOIN f r ON r.lang = u.lang AND r.gram = u.rg),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) = 1),
o AS (SELECT lang, lg AS gram, max(a) AS more FROM u WHERE cut = k - 1 GROUP BY ALL
    UNION ALL SELECT lang, rg, max(a) FROM u WHERE cut = 1 GROUP BY ALL),
m AS (SELECT lang, gram, max(more) AS more FROM o GROUP BY ALL),
s AS (SELECT b.*, array_to_string(b.gram, ' ') AS phrase FROM b LEFT JOIN m ON b.lang = m.lang AND b.gram = m.gram
    WHERE coalesce(100 * more < 100 * a, true))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM s
QUALIFY rank <= 2000""")
def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 phrases of each language that hold together best."""
    return collocations(load_table(spark, folder, "documents"))
