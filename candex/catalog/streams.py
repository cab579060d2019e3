"""Streaming queries, each equal to its batch form."""

from pyspark.sql import functions as F

from candex.catalog.aggregates import FRAGMENTS_SQL
from candex.catalog.registry import EVENTS_SQL, ORACLES, TIMES, query
from candex.functions.numbers import cents, int_div
from candex.streaming import operators as T
from candex.streaming.sinks import drain_append, drain_update, stream_table


def _events(spark, d):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return stream_table(spark, d, "events").select(
        "event_id", "ts", "user_id", "event_type", cents("value").alias("cents"),
        F.timestamp_diff("SECOND", start, F.col("ts")).alias("day_secs"),
    )


@query(
    "t1_stream_reassemble",
    f"""WITH {FRAGMENTS_SQL} SELECT conv_id, fragment, parts, text, complete FROM frag WHERE complete OR fragment < top""",
)
def reassembled(spark, d):
    turns = stream_table(spark, d, "conversations").select(
        "conv_id", "turn", (F.col("role") == "user").alias("opens"), (F.col("role") == "assistant").alias("closes"),
        "text",
    )
    return drain_append(
        T.stream_reassemble(turns, ["conv_id"], ["turn"], "opens", "closes", "text", " | "), "reassemble"
    )


@query(
    "t2_stream_counters",
    f"""WITH {EVENTS_SQL} SELECT user_id, day, count(*) FILTER (WHERE event_type <> 'error') AS clear,
          count(*) FILTER (WHERE event_type = 'error') AS protected_rows FROM ev GROUP BY 1, 2""",
)
def counted(spark, d):
    e = _events(spark, d).withColumn("day", int_div("day_secs", 86400))
    sums = T.stream_counters(e, ["user_id", "day"], F.col("event_type") == "error")
    return drain_update(sums, ["user_id", "day"], "counters")


@query("t3_stream_first_acceptable", ORACLES["w14_first_acceptable_else_best"])
def chosen(spark, d):
    docs = stream_table(spark, d, "documents").select("source", "doc_id", "n_chars")
    best = T.stream_first_acceptable(
        docs, ["source"], ["doc_id"], F.col("n_chars").between(2500, 2600), "n_chars", ["doc_id", "n_chars"]
    )
    return drain_update(best, ["source"], "best")


@query("t4_stream_start_gate", ORACLES["w19_start_gate"])
def gated(spark, d):
    e = _events(spark, d).select(
        "user_id", *TIMES, F.when(F.col("event_type") != "click", F.col("day_secs")).alias("t"),
        (F.col("user_id") % 30 * 86400).alias("at"),
    )
    return drain_append(T.stream_start_gate(e, ["user_id"], TIMES, "t", "at"), "gate").select("user_id", "event_id")


@query("t5_stream_until_marker", ORACLES["w20_until_marker"])
def marked(spark, d):
    e = _events(spark, d).select(
        "user_id", *TIMES, (F.col("event_type") == "signup").alias("opens"),
        (F.col("event_type") == "purchase").alias("ends"), "cents",
    )
    out = T.stream_until_marker(e, ["user_id"], TIMES, "opens", "ends", "cents", 30_000)
    return drain_append(out, "marker").select("user_id", "event_id")
