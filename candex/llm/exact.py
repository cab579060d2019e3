"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch of documents is reduced to one row per digest, joined
against the index with a sort-merge anti-join, and what is new is appended. Only DataFrame operations are used.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candex.llm.frames import one_row_each
from candex.plans.limits import pin, scratch_path

SPACES = "\t\n\x0b\x0c\r "


def digest(text: str) -> Column:
    """SHA-256 of a text without ASCII white space, as 32 bytes; a null text counts as empty."""
    bare = reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("")), SPACES, F.coalesce(F.col(text), F.lit("")))
    return F.unhex(F.sha2(bare, 256))


@dataclass(frozen=True)
class DigestIndex:
    """A persistent index of admitted texts: ``digest, keep_id, batch``.

    ``path`` is a folder all executors share. Opening it again, in this session or another, finds what was
    appended before; the number of buckets must then be the same. ``close`` forgets the table's name, not its files.
    """

    spark: SparkSession
    table: str
    buckets: int

    @staticmethod
    def open(spark: SparkSession, path: str | None = None, buckets: int | None = None) -> DigestIndex:
        path = path or scratch_path(spark, "digests")
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"candex_digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        return DigestIndex(spark, table, buckets)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def admit(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batch: str | None = None) -> DataFrame:
        """Compares ``docs`` with the index and with each other, and appends the texts not seen before.

        Texts are equal when they are identical without ASCII white space. Of the equal rows of a batch the one
        with the most code points, then the smallest id (null last) stays, unless an earlier batch holds the text:
        then that row's id is ``keep_id`` and no row of this batch is kept. Returns one row per row of ``docs``:
        ``doc_id, keep_id, group_size`` (rows of this batch with the text)``, kept, digest, size, repeats`` (rows of one text,
        id and size, of which at most one is kept). Other columns are ignored; an empty table gives no rows.

        A batch that is admitted again under its name, say after a job that died half way, does not meet itself: its rows get
        the verdicts they got the first time, and nothing is appended twice. A text that several writers have appended is one
        text, of the smallest id.
        """
        batch = batch or uuid.uuid4().hex
        rows = pin(
            docs.select(
                F.col(doc_id).cast("long").alias("doc_id"),
                digest(text).alias("digest"),
                F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("size"),
                F.monotonically_increasing_id().alias("row"),
            )
        )
        # Rows of one text, id and size are told apart by their written number.
        alike = rows.groupBy("digest", "size", "doc_id").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("repeats"))
        best = F.min(F.struct(-F.col("size"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"), F.col("repeats")))
        groups = pin(
            alike.groupBy("digest")
            .agg(best.alias("best"), F.sum("repeats").alias("group_size"))
            .select("digest", F.col("best.doc_id").alias("keep_id"), "group_size", F.col("best.row").alias("keep_row"), F.col("best.repeats").alias("repeats"))
        )
        index = self.spark.table(self.table)
        earlier = index.where(F.col("batch") != batch).hint("merge")
        fresh = pin(groups.join(earlier.select("digest"), "digest", "left_anti").withColumn("fresh", F.lit(True)))
        held = earlier.groupBy("digest").agg(F.min("keep_id").alias("keep_id"))
        known = groups.drop("keep_id").join(held.hint("merge"), "digest").withColumn("fresh", F.lit(False))
        verdicts = pin(fresh.unionByName(known))
        mine = index.where(F.col("batch") == batch).select("digest")
        new = fresh.select("digest", "keep_id", F.lit(batch).alias("batch")).join(mine.hint("merge"), "digest", "left_anti")
        pin(new).repartition(self.buckets, "digest").write.insertInto(self.table)
        return rows.join(verdicts, "digest").select(
            "doc_id", "keep_id", "group_size", (F.col("fresh") & (F.col("row") == F.col("keep_row"))).alias("kept"), "digest", "size",
            "repeats",
        )


def drop_copies(docs: DataFrame, index: DigestIndex, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the index keeps, with all their columns: one row of each text, also where ids are null or
    repeat. Of rows that share text, id and length, one stays by a hash of all columns."""
    kept = index.admit(docs, doc_id, text).where("kept")
    size = F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    match = [(F.col(doc_id).cast("long"), "doc_id"), (digest(text), "digest"), (size, "size")]
    return one_row_each(docs, kept, match, "repeats")
