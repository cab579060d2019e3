"""Mixing sources to target weights along a time-varying curriculum.

Every source has a schedule, its weight as a piecewise linear function of training time 0 to 1. The integrals of the
schedules share out the words; a source can be repeated only so often, and what it cannot give is shared by the rest.
The documents of a source are laid out in hash order as one line of words, repeated as often as the target asks; the
place of a document on that line is a cumulative demand, and inverting the integrated schedule gives its position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candex.plans.limits import pin

#: Schedules with the integrals 1, 2 and 3: one grows, one is even, one fades.
CURRICULUM = ([(0.0, 0.5), (1.0, 1.5)], [(0.0, 2.0), (1.0, 2.0)], [(0.0, 4.0), (1.0, 2.0)])
_PER_BUCKET, _MOST_BITS = 1000, 16


def word_count(text: str) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _areas(knots: list[tuple[float, float]]) -> tuple[float, list[tuple]]:
    """The integral of a schedule, and its pieces: start, end, weights there, integral before and after."""
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        if not (t0 < t1 and w0 >= 0 and w1 >= 0):
            raise ValueError("knots of a schedule need growing times and weights of at least 0")
        area = (w0 + w1) / 2 * (t1 - t0)
        pieces.append((t0, t1, w0, w1, total, total + area))
        total += area
    if total <= 0 or knots[0][0] != 0 or knots[-1][0] != 1:
        raise ValueError("a schedule runs from 0 to 1 and has a weight somewhere")
    return total, pieces


def _dealt(place: Column, values: list) -> Column:
    """The value for a source's place, the list repeating."""
    return F.element_at(F.array(*values), (place % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, schedules=CURRICULUM, max_repeats: int = 3) -> DataFrame:
    """``source, source_size, place, target`` from ``source, source_size``: one row per source, null last.

    Targets share the sum of all sizes by the integrals of the schedules, dealt to the sources in code point order.
    None is above ``max_repeats`` times its source; the excess is shared by weight among the others until none is.
    The table has a row per source and is small beside the documents.
    """
    weights = [F.lit(float(_areas(s)[0])) for s in schedules]
    everything = W.partitionBy()
    ranked = sizes.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", _dealt(F.col("place"), weights)).withColumn("cap", F.col("source_size") * F.lit(max_repeats))
    by_need = W.orderBy(F.col("cap") / F.col("weight"), "place")
    before, since = by_need.rowsBetween(W.unboundedPreceding, -1), by_need.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0))
    short = ranked.withColumn("total", total).withColumn("_short", F.col("cap") * F.sum("weight").over(since) <= left * F.col("weight"))
    short = short.withColumn("_capped", F.bool_and("_short").over(by_need.rowsBetween(W.unboundedPreceding, 0)))
    spent = F.coalesce(F.sum(F.when(F.col("_capped"), F.col("cap"))).over(everything), F.lit(0))
    shared = F.sum(F.when(~F.col("_capped"), F.col("weight"))).over(everything)
    target = F.when(F.col("_capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * (F.col("total") - spent) / shared)
    return short.select("source", "source_size", "place", target.alias("target"))


def _position(demand: Column, place: Column, schedules) -> Column:
    """The training time at which a source has asked for the share ``demand`` of its words."""
    kind = "array<struct<t0:double,t1:double,w0:double,w1:double,c0:double,c1:double>>"
    tables = [F.array(*[F.struct(*map(F.lit, p)) for p in _areas(s)[1]]).cast(kind) for s in schedules]
    totals = [F.lit(float(_areas(s)[0])) for s in schedules]
    area = demand * _dealt(place, totals)
    piece = F.element_at(F.filter(_dealt(place, tables), lambda p: (area < p.c1) | (p.t1 == 1)), 1)
    need = area - piece.c0
    slope = (piece.w1 - piece.w0) / (piece.t1 - piece.t0)
    root = piece.w0 + F.sqrt(F.greatest(piece.w0 * piece.w0 + 2 * slope * need, F.lit(0.0)))
    return piece.t0 + F.coalesce(2 * need / F.nullif(root, F.lit(0.0)), F.lit(0.0))


def plan_mixture(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", schedules=CURRICULUM, max_repeats: int = 3
) -> DataFrame:
    """What the mix takes of every document, and when.

    Returns ``doc_id, source, size, source_size, target, taken, positions`` for every row of ``docs``, range-sorted by
    the first position (rows that are not taken come first). Documents are taken whole; the words taken of a source
    differ from its target by at most half a document. A document is taken at most ``max_repeats`` times. The order
    of a source is the MD5 of the id as text, then id and size, so reruns agree; a null id counts as empty text and
    repeated rows lie side by side. Texts without words have size 0 and take nothing. A null source is one source, in
    last place. Other columns are ignored; an empty table gives no rows.
    """
    placed = _laid_out(docs, doc_id, source, text, schedules, max_repeats)
    first = F.try_element_at("positions", F.lit(1))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(partitions, first, "doc_id").sortWithinPartitions(first, "doc_id")


def _laid_out(docs: DataFrame, doc_id: str, source: str, text: str, schedules, max_repeats: int, whole: bool = False) -> DataFrame:
    """The rows of ``plan_mixture`` in any order; with ``whole``, the row of ``docs`` as a struct ``row`` besides."""
    mark = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    names = [F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"), mark.alias("mark")]
    rows = pin(docs.select(*names))
    bits = min(_MOST_BITS, max(0, math.ceil(math.log2(max(1, rows.count()) / _PER_BUCKET))))
    # Hash order is even: the leading bits of the mark cut every source into buckets of about the same share.
    lead = F.conv(F.substring("mark", 1, 8), 16, 10).cast("long")
    bucketed = lambda r: r.withColumn("bucket", F.shiftright(lead, 32 - bits).cast("int"))
    rows = bucketed(rows)
    sums = pin(rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket")))
    targets = pin(source_targets(sums.groupBy("source").agg(F.sum("in_bucket").alias("source_size")), schedules, max_repeats))
    ahead = F.sum("in_bucket").over(W.partitionBy("source").orderBy("bucket")) - F.col("in_bucket")
    starts = sums.select("source", "bucket", ahead.alias("ahead"))
    known = targets.select(F.col("source").alias("_source"), "source_size", "place", "target")
    starts = pin(starts.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")).withColumnsRenamed({"source": "_source", "bucket": "_bucket"})

    within = W.partitionBy("source", "bucket").orderBy("mark", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    # Whole rows are read again rather than written with their sizes.
    rows = bucketed(docs.select(*names, F.struct("*").alias("row"))) if whole else rows
    placed = rows.withColumn("before", F.sum("size").over(within) - F.col("size"))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    middle = F.col("ahead") + F.col("before") + F.col("size") / 2
    passes = F.array(*[middle + F.col("source_size") * F.lit(i) for i in range(max_repeats)])
    placed = placed.withColumn("passes", F.filter(passes, lambda m: m < F.col("target")))
    positions = F.transform("passes", lambda m: _position(m / F.col("target"), F.col("place"), schedules))
    taken = (F.col("size") * F.size("passes")).alias("taken")
    return placed.select("doc_id", "source", "size", "source_size", "target", taken, positions.alias("positions"), *["row"] * whole)


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", schedules=CURRICULUM, max_repeats: int = 3) -> DataFrame:
    """The documents the mix takes, with all their columns, once per take and range-sorted by training position.

    Every row has its own takes, also if it shares its id.
    """
    rows = _laid_out(docs, doc_id, source, text, schedules, max_repeats, whole=True)
    rows = rows.select("doc_id", "row", F.explode("positions").alias("at"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(partitions, "at", "doc_id").sortWithinPartitions("at", "doc_id").select("row.*")
