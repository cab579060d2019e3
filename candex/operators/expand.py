"""Runs, intervals and nested rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candex.functions.numbers import _c
from candex.plans import limits
from candex.plans.joins import explode_range
from candex.plans.ordered import group_count, join_on, next_value, ordered, position, previous_value, running_count, running_sum


def rle_expand(
    df: DataFrame, keys: list[str], order: list[str], run: str, value: str, width=None, transparent=None,
    budget: int | None = None, group_rows=None,
) -> DataFrame:
    """Cells of (run, value) rows: ``keys, cell, value``, cells counted from 0 and clipped to ``width``.

    Transparent runs advance but draw nothing. With ``budget``, every run costs one and one more for each cell
    drawn; the first run that does not fit ends the group.
    """
    rows = ordered(df, keys, order, group_rows).scan(_stop=running_sum(F.col(run).cast("long")))
    stop = F.col("_stop") if width is None else F.least(F.col("_stop"), _c(width))
    start = F.col("_stop") - F.coalesce(F.col(run).cast("long"), F.lit(0))
    hidden = F.lit(False) if transparent is None else F.coalesce(F.col(value) == F.lit(transparent), F.lit(False))
    rows = rows.with_columns(_from=start, _to=F.when(hidden, start).otherwise(F.greatest(stop, start)))
    if budget is not None:
        cost = F.lit(1) + F.col("_to") - F.col("_from")
        rows = rows.scan(_cost=running_sum(cost)).where(F.col("_cost") <= budget)
    cells = explode_range(rows.rows(), F.col("_from"), F.col("_to"), "cell")
    return cells.select(*keys, "cell", value)


def rle_encode(df: DataFrame, keys: list[str], order: list[str], v: str, group_rows=None) -> DataFrame:
    """Maximal runs of equal values: ``keys, run_no, start`` (from 0), ``run, value``."""
    rows = ordered(df, keys, order, group_rows).scan(
        _pos=position(), _before=previous_value(F.struct(F.col(v).alias("v")))
    )
    opens = F.col("_before").isNull() | ~F.col("_before.v").eqNullSafe(F.col(v))
    runs = rows.scan(run_no=running_count(opens)).rows()
    return runs.groupBy(*keys, "run_no").agg(
        (F.min("_pos") - 1).alias("start"), F.count(F.lit(1)).alias("run"), F.first(v).alias("value")
    )


def _dyadic(start: str, stop: str) -> Column:
    """The nodes ``level, place`` (cells ``[place, place + 1) * 2^level``) that an interval is made of, at most two a level."""
    length = F.col(stop) - F.col(start)
    levels = F.sequence(F.lit(0), F.length(F.bin(length)) - 1)

    def at_level(j: Column) -> Column:
        low = -F.call_function("shiftright", -F.col(start), j)
        high = F.call_function("shiftright", F.col(stop), j)
        node = lambda place, taken: F.when(taken & (low < high), F.struct(j.alias("level"), place.alias("place")))
        return F.array(node(low, low.bitwiseAND(F.lit(1)) == 1), node(high - 1, high.bitwiseAND(F.lit(1)) == 1))

    return F.filter(F.flatten(F.transform(levels, at_level)), lambda node: node.isNotNull())


#: Intervals of one group that a task may paint at once, and about how many it gets; types whose equality Arrow shares with Spark.
_PAINTED, _BUCKET = 500_000, 100_000
_SIMPLE = (T.IntegralType, T.StringType, T.BooleanType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each distinct value, null included."""
    return pc.fill_null(column.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _paint(table: pa.Table, keys: int) -> pa.Table:
    """The runs seen of whole groups of intervals: columns are the keys, then start, stop, number and value.

    All groups lie behind each other on one line of bounds. A stretch takes the last drawing of the blocks it is in: an
    interval is two blocks of one power of two, and from the longest down each block hands its drawing to its halves.
    """
    group = np.zeros(len(table), np.int64)
    for i in range(keys):
        own = _codes(table.column(i))
        group = np.unique(group * (own.max(initial=0) + 2) + own + 1, return_inverse=True)[1]
    low, high = (table.column(keys + i).to_numpy() for i in (0, 1))
    drawn = np.asarray(pc.sort_indices(table.column(keys + 2), null_placement="at_start")).astype(np.int64)
    rank = np.empty_like(drawn)
    rank[drawn] = np.arange(len(drawn))

    groups, places = np.concatenate([group, group]), np.concatenate([low, high])
    by = np.lexsort((places, groups))
    fresh = np.ones(len(by), bool)
    fresh[1:] = (np.diff(groups[by]) != 0) | (np.diff(places[by]) != 0)
    bound = np.empty(len(by), np.int64)
    bound[by] = np.cumsum(fresh) - 1
    places = places[by][fresh]
    first, last = bound[: len(low)], bound[len(low) :]
    level = np.frexp((last - first).astype(float))[1] - 1
    top = np.full(len(places), -1, np.int64)
    for k in range(int(level.max(initial=0)), -1, -1):
        half = 1 << k
        below = top.copy()
        np.maximum(below[half:], top[:-half], out=below[half:])
        top, here = below, level == k
        np.maximum.at(top, first[here], rank[here])
        np.maximum.at(top, last[here] - half, rank[here])

    seen = np.flatnonzero(top >= 0)
    rows = drawn[top[seen]]
    value = _codes(table.column(keys + 3))[rows]
    opens = np.ones(len(seen), bool)
    opens[1:] = (np.diff(seen) != 1) | (np.diff(value) != 0)
    starts = np.flatnonzero(opens)
    ends = np.append(starts[1:], len(seen))[: len(starts)] - 1
    chosen = table.take(pa.array(rows[starts]))
    columns = [*chosen.columns[:keys], pa.array(places[seen[starts]]), pa.array(places[seen[ends] + 1]), chosen.column(keys + 3)]
    return pa.table(columns, names=[*table.column_names[:keys], "start", "stop", "value"])


def paint_runs(df: DataFrame, keys: list[str], start: str, stop: str, draw_no: str, value: str, group_rows=None) -> DataFrame:
    """What is seen of ``[start, stop)`` intervals drawn over each other, as maximal runs: ``keys, start, stop, value``.

    ``draw_no`` is unique per ``keys``; the greatest one is on top. Null bounds and empty intervals draw nothing; a null
    value is drawn like others. Spark deals whole groups to tasks, which paint many of them at once, a row for each interval.
    Groups of more than ``group_rows`` are put together from dyadic nodes; so are keys, numbers and values without a plain type.
    """
    drawn = df.where(F.col(start) < F.col(stop)).select(
        *keys, F.col(start).cast("long").alias("_a"), F.col(stop).cast("long").alias("_b"), F.col(draw_no).alias("_no"),
        F.when(F.col(draw_no).isNotNull(), F.col(value)).alias("_v"),
    )
    if not all(isinstance(drawn.schema[c].dataType, _SIMPLE) for c in [*keys, "_no", "_v"]):
        return _paint_large(drawn, keys, group_rows)
    buckets, large = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), None
    if group_rows is not None or not limits.small_input(drawn):
        most = min(limits.limit(df.sparkSession, "groupRows") if group_rows is None else group_rows, _PAINTED)
        drawn = limits.pin(drawn)
        buckets = max(buckets, drawn.count() // _BUCKET)
        large = limits.pin(drawn.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).drop("_n"))
        large = None if large.isEmpty() else large
    names = [*keys, "_a", "_b", "_no", "_v"]
    cold = drawn if large is None else join_on(drawn, large, keys, "left_anti")
    cold = cold.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)], F.pmod(F.xxhash64(F.lit(0), *keys), F.lit(buckets)).alias("_bucket"))
    n, kinds = len(keys), [drawn.schema[c].dataType for c in [*keys, "_a", "_b", "_v"]]
    fields = [*[f"_c{i}" for i in range(n)], "start", "stop", "value"]
    schema = T.StructType([T.StructField(c, kind) for c, kind in zip(fields, kinds, strict=True)])
    runs = cold.groupBy("_bucket").applyInArrow(lambda table: _paint(table.drop_columns("_bucket"), n), schema)
    runs = runs.select(*[F.col(f"_c{i}").alias(k) for i, k in enumerate(keys)], "start", "stop", "value")
    return runs if large is None else runs.unionByName(_paint_large(join_on(drawn, large, keys, "left_semi"), keys, group_rows))


def _paint_large(drawn: DataFrame, keys: list[str], group_rows: int | None) -> DataFrame:
    """``paint_runs`` for groups too large for a task. Intervals are put together from dyadic nodes, at most two of each size,
    of which every node keeps its last drawing. Between two neighbouring bounds nothing changes, so each stretch between bounds
    looks at the nodes above its first cell. An interval costs rows in proportion to the logarithm of its length.
    """
    drawn = drawn.withColumn("_d", F.struct(F.col("_no").alias("no"), F.col("_v").alias("v"))).drop("_no", "_v")
    nodes = drawn.select(*keys, "_d", F.inline(_dyadic("_a", "_b")))
    nodes = limits.pin(nodes.groupBy(*keys, "level", "place").agg(F.max_by("_d", "_d.no").alias("_d")))
    levels = [r[0] for r in nodes.select("level").distinct().collect()]  # at most 63
    bounds = drawn.select(*keys, F.explode(F.array("_a", "_b")).alias("_a")).distinct()
    stretches = ordered(bounds, keys, ["_a"], group_rows).scan(_b=next_value("_a")).rows().where(F.col("_b").isNotNull())
    above = F.array(*[F.struct(F.lit(j).alias("level"), F.shiftright("_a", j).alias("place")) for j in sorted(levels)])
    if not levels:
        above = F.array().cast("array<struct<level:int,place:bigint>>")
    seen = join_on(stretches.select(*keys, "_a", "_b", F.inline(above)), nodes, [*keys, "level", "place"])
    top = seen.groupBy(*keys, "_a", "_b").agg(F.max_by("_d", "_d.no").alias("_d"))
    before = ordered(top, keys, ["_a"], group_rows).scan(_before=previous_value(F.struct("_b", "_d.v")))
    opens = F.col("_before").isNull() | (F.col("_before._b") != F.col("_a")) | ~F.col("_before.v").eqNullSafe(F.col("_d.v"))
    runs = before.scan(_run=running_count(opens)).rows()
    return runs.groupBy(*keys, "_run").agg(F.min("_a").alias("start"), F.max("_b").alias("stop"), F.first("_d.v").alias("value")).drop("_run")


def paint_last(df: DataFrame, keys: list[str], start: str, stop: str, draw_no: str, value: str, group_rows=None) -> DataFrame:
    """Cells covered by ``[start, stop)`` intervals show the last drawn: ``keys, cell, value``.

    ``draw_no`` is unique per ``keys``. The runs of ``paint_runs``, cell by cell: a cell is written once, however many
    intervals cover it.
    """
    runs = paint_runs(df, keys, start, stop, draw_no, value, group_rows)
    return explode_range(runs, F.col("start"), F.col("stop"), "cell").select(*keys, "cell", "value")


def nested_flatten(df: DataFrame, path: list[str], keep: list[str]) -> DataFrame:
    """One row per innermost element along a path of nested arrays of structs, with ``<name>_pos`` from 0."""
    out = df
    names = list(keep)
    source: Column = F.col(path[0])
    for depth, name in enumerate(path):
        out = out.select("*", F.posexplode(source).alias(f"{name}_pos", f"_{name}"))
        names.append(f"{name}_pos")
        if depth + 1 < len(path):
            source = F.col(f"_{name}.{path[depth + 1]}")
    last = path[-1]
    inner = dict(out.dtypes)[f"_{last}"]
    return out.select(*names, f"_{last}.*" if inner.startswith("struct") else F.col(f"_{last}").alias(last))


def best_positions(
    df: DataFrame, keys: list[str], order: list[str], first: str, last: str, total, limit: int = 3, group_rows=None
) -> DataFrame:
    """Places to look at in a chain of cells: start of the first cell, start of the last one (when there are
    several), end of the first one (only if later); in range, distinct, at most ``limit``, in this order."""
    rows = ordered(df, keys, order, group_rows).scan(_pos=position(), _n=group_count()).rows()
    ends = rows.where((F.col("_pos") == 1) | (F.col("_pos") == F.col("_n")))
    cells = ends.groupBy(*keys).agg(
        F.max(F.when(F.col("_pos") == 1, F.col(first))).alias("_a"),
        F.max(F.when((F.col("_pos") == F.col("_n")) & (F.col("_n") > 1), F.col(first))).alias("_b"),
        F.max(F.when(F.col("_pos") == 1, F.col(last))).alias("_c"),
    )
    later = F.when(F.col("_c") > F.col("_a"), F.col("_c"))
    places = F.filter(F.array("_a", "_b", later), lambda p: p.isNotNull() & (p < _c(total)))
    places = F.slice(F.array_distinct(places), 1, limit)
    return cells.select(*keys, places.alias("positions")).where(F.size("positions") > 0)
