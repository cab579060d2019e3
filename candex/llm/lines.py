"""Removal of repeated passages by overlapping windows of three lines; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candex.llm.frames import unused
from candex.plans.limits import pin

BLANKS = " \t\x0b\x0c\r"


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lines: int = 3) -> DataFrame:
    """Lines to cut: ``doc_id, mark, cut`` (array of line numbers from 0) for documents that lose some.

    ``mark`` is a hash of the text and tells apart rows that share an id.
    """
    numbered = F.transform("parts", lambda x, i: F.struct(i.alias("at"), F.trim(x, F.lit(BLANKS)).alias("line")))
    # Generated columns are worked out once a row; in a lambda an expression would be worked out for every line.
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.explode(F.array(F.split(text, "\n"))).alias("parts"))
    rows = rows.select("doc_id", "mark", F.explode(F.array(F.filter(numbered, lambda x: x.line != ""))).alias("kept")).where(F.size("kept") >= lines)

    def window(i):
        part = F.slice("kept", i + 1, F.lit(lines))
        key = F.unhex(F.md5(F.array_join(F.transform(part, lambda x: x.line), "\n").cast("binary")))
        return F.struct(i.alias("i"), key.alias("key"), F.transform(part, lambda x: x.at).alias("covers"))

    found = F.transform(F.sequence(F.lit(0), F.size("kept") - lines), window)
    windows = pin(rows.select("doc_id", "mark", F.inline(found)))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark", "i"))
    repeated = pin(
        windows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).where("n > 1")
        .select("key", F.col("first.doc_id").alias("f_doc"), F.col("first.mark").alias("f_mark"), F.col("first.i").alias("f_i"))
    )
    is_first = F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("mark") == F.col("f_mark")) & (F.col("i") == F.col("f_i"))
    covered = windows.join(repeated, "key").select("doc_id", "mark", "covers", is_first.alias("stays"))
    merged = covered.groupBy("doc_id", "mark").agg(
        # Sets, as rows of one id and text have the same windows.
        F.flatten(F.collect_set(F.when(~F.col("stays"), F.col("covers")))).alias("later"),
        F.flatten(F.collect_set(F.when(F.col("stays"), F.col("covers")))).alias("first"),
    )
    return merged.select("doc_id", "mark", F.array_except("later", "first").alias("cut")).where(F.size("cut") > 0)


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lines: int = 3) -> DataFrame:
    """``docs`` with repeated passages removed from ``text``, and ``n_lines`` and ``n_removed`` added.

    A window is three consecutive lines that are not blank, compared without leading and trailing blanks. Of equal
    windows anywhere, the first by id (null last), then text hash and place, stays; the lines that later ones cover
    are cut, except those that the first occurrence of a repeated window covers: one whole copy of every passage
    stays, also where a passage overlaps itself. Blank lines stay. Documents with fewer lines, empty texts and texts
    without repeats are unchanged; a null text has 0 lines. Rows with one id and one text are cut alike. Other
    columns pass, but for columns named ``n_lines`` and ``n_removed``, which are replaced.
    """
    own, mark, cut, parts = unused(docs, "own", "mark", "cut", "parts")
    cuts = repeated_windows(docs, doc_id, text, lines).select(F.col("doc_id").alias(own), F.col("mark").alias(mark), F.col("cut").alias(cut))
    rows = docs.drop("n_lines", "n_removed")
    rows = rows.join(cuts, F.col(doc_id).cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(text) == F.col(mark)), "left")
    # One row each, also for a null text; the lines are an attribute from here on and not split again for every line.
    rows = rows.select("*", F.explode(F.array(F.split(text, "\n"))).alias(parts))
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(cut))
    bare = F.array_join(F.transform(left, lambda i: F.get(F.col(parts), i)), "\n")
    return rows.withColumns(
        {
            "n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).cast("long"),
            "n_removed": F.when(F.col(cut).isNull(), 0).otherwise(F.size(cut)).cast("long"),
            text: F.when(F.col(cut).isNull(), F.col(text)).otherwise(bare),
        }
    ).drop(own, mark, cut, parts)
