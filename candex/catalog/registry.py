"""Registration of queries with their SQL, and the derived inputs they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candex.functions.numbers import cents, int_div
from candex.sources.tables import load_table

QUERIES: dict = {}
ORACLES: dict = {}

# A total order of the lines of an order.
LINES = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
LINES_SQL = ", ".join(LINES)

# A total order of the events of a user.
TIMES = ["ts", "event_id"]

# Derived inputs in SQL, to put in front of a query.
EVENTS_SQL = """ev AS (
  SELECT *, day_secs // 86400 AS day, day_secs // 3600 % 24 AS hour FROM (
    SELECT event_id, ts, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents,
           (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000 AS day_secs FROM events))"""
ITEMS_SQL = """li AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, l_shipdate, l_extendedprice,
         CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS price FROM lineitem)"""


def query(name: str, sql: str | None = None):
    """Registers a query and the SQL that gives the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with whole cents and the second, hour and day since the first of January 2024."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    out = load_table(spark, folder, "events").select(
        "event_id", "ts", "user_id", "event_type", cents("value").alias("cents"),
        F.timestamp_diff("SECOND", start, F.col("ts")).alias("day_secs"),
    )
    return out.withColumns(
        {"day": int_div("day_secs", 86400), "hour": int_div("day_secs", 3600) % 24}
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with whole quantities and prices in cents."""
    return load_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate",
        "l_extendedprice", F.col("l_quantity").cast("long").alias("qty"), cents("l_extendedprice").alias("price"),
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return load_table(spark, folder, name)
