"""Ordered scans over groups of any size.

``ordered(df, keys, order)`` gives a handle whose ``scan`` adds running values, positions, neighbours and
group totals. Groups up to ``spark.candex.groupRows`` rows use plain windows. Larger ones are found by a
pre-aggregated count, range-partitioned by ``keys + order`` into chunks that Spark balances by sampling, and
pinned; each chunk is scanned on its own and the values that earlier chunks carry over are added from a table
with one row per (group, chunk). So no task ever holds more than about one chunk of a group, and the result is
the same as with one window. ``order`` must be a total order within a group; a leading ``-`` means descending.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candex.plans import limits

CHUNK = "_chunk"


@dataclass(frozen=True)
class Step:
    """One value to compute: how rows combine, over what, and whether the row itself counts."""

    kind: str
    value: Column
    inclusive: bool = True


def _column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def position() -> Step:
    """1-based place of the row in its group."""
    return Step("sum", F.lit(1).cast("long"))


def running_sum(value, inclusive: bool = True) -> Step:
    """Sum of the non-null values so far, 0 before the first."""
    return Step("sum", F.coalesce(_column(value), F.lit(0)), inclusive)


def running_count(condition: Column, inclusive: bool = True) -> Step:
    """Number of rows so far that meet the condition."""
    return Step("sum", F.when(condition, 1).otherwise(0).cast("long"), inclusive)


def running_max(value, inclusive: bool = True) -> Step:
    """Largest non-null value so far."""
    return Step("max", _column(value), inclusive)


def running_last(value, inclusive: bool = True) -> Step:
    """Last non-null value so far."""
    return Step("last", _column(value), inclusive)


def next_value(value) -> Step:
    """Value of the following row, null for the last one."""
    return Step("next", _column(value))


def previous_value(value) -> Step:
    """Value of the preceding row, null for the first one."""
    return Step("previous", _column(value))


def group_sum(value) -> Step:
    """Sum over the whole group."""
    return Step("group_sum", F.coalesce(_column(value), F.lit(0)))


def group_count() -> Step:
    """Rows of the whole group."""
    return Step("group_sum", F.lit(1).cast("long"))


def group_min(value) -> Step:
    return Step("group_min", _column(value))


def group_max(value) -> Step:
    return Step("group_max", _column(value))


def sort_columns(order) -> list[Column]:
    """Sort expressions of an order list."""
    out = []
    for item in order:
        if not isinstance(item, str):
            out.append(item)
        elif item.startswith("-"):
            out.append(F.col(item[1:]).desc())
        else:
            out.append(F.col(item).asc())
    return out


def same_keys(left: list[Column], right: list[Column]) -> Column:
    """Null-safe equality of two key lists."""
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right)], F.lit(True))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on columns of the same names in which null equals null."""
    names = [f"_right_{k}" for k in keys]
    renamed = right.withColumnsRenamed(dict(zip(keys, names)))
    out = left.join(renamed, same_keys([F.col(k) for k in keys], [F.col(n) for n in names]), how)
    return out if how in ("left_semi", "left_anti") else out.drop(*names)


_WINDOW = {"sum": F.sum, "max": F.max, "group_sum": F.sum, "group_min": F.min, "group_max": F.max}


def _plain(step: Step, running: W, whole: W) -> Column:
    """The step as a single window expression."""
    if step.kind.startswith("group_"):
        return _WINDOW[step.kind](step.value).over(whole)
    if step.kind == "next":
        return F.lead(step.value).over(running)
    if step.kind == "previous":
        return F.lag(step.value).over(running)
    frame = running.rowsBetween(W.unboundedPreceding, 0 if step.inclusive else -1)
    if step.kind == "last":
        return F.last(step.value, ignorenulls=True).over(frame)
    value = _WINDOW[step.kind](step.value).over(frame)
    return F.coalesce(value, F.lit(0)) if step.kind == "sum" else value


@dataclass(frozen=True)
class Ordered:
    """Rows with a group key and a total order; hot groups are kept apart in chunks."""

    keys: tuple
    order: tuple
    cold: DataFrame
    hot: DataFrame | None = None

    def _each(self, change) -> Ordered:
        return replace(self, cold=change(self.cold), hot=None if self.hot is None else change(self.hot))

    def with_columns(self, **columns: Column) -> Ordered:
        """Adds row-wise columns."""
        return self._each(lambda df: df.withColumns(columns))

    def where(self, condition: Column) -> Ordered:
        """Keeps some rows; the chunks stay valid."""
        return self._each(lambda df: df.where(condition))

    def drop(self, *names: str) -> Ordered:
        return self._each(lambda df: df.drop(*names))

    def rows(self, *drop: str) -> DataFrame:
        """The rows as one DataFrame."""
        cold = self.cold.drop(*drop)
        if self.hot is None:
            return cold
        return cold.unionByName(self.hot.drop(CHUNK, *drop))

    def scan(self, **steps: Step) -> Ordered:
        """Adds one column per step."""
        by = [F.col(k) for k in self.keys]
        running = W.partitionBy(*by).orderBy(*sort_columns(self.order))
        whole = W.partitionBy(*by)
        cold = self.cold.withColumns({n: _plain(s, running, whole) for n, s in steps.items()})
        hot = None if self.hot is None else self._scan_chunks(steps)
        return replace(self, cold=cold, hot=hot)

    def _scan_chunks(self, steps: dict[str, Step]) -> DataFrame:
        keys = list(self.keys)
        by = [F.col(k) for k in keys]
        inner = W.partitionBy(*by, CHUNK).orderBy(*sort_columns(self.order))
        # Sums and extremes of a chunk need no order: they combine on the map side, and only the scan itself is shuffled.
        placed = any(s.kind in ("last", "next", "previous") for s in steps.values())
        chunked = self.hot.withColumn("_place", F.row_number().over(inner)) if placed else self.hot

        # What one chunk contributes, and what all chunks before (or after) it carry over.
        part, carry = [], []
        over = W.partitionBy(*by).orderBy(CHUNK)
        before = over.rowsBetween(W.unboundedPreceding, -1)
        for name, s in steps.items():
            t = f"_t_{name}"
            if s.kind == "sum":
                part.append(F.sum(s.value).alias(t))
                carry.append(F.sum(t).over(before).alias(f"_c_{name}"))
            elif s.kind == "max":
                part.append(F.max(s.value).alias(t))
                carry.append(F.max(t).over(before).alias(f"_c_{name}"))
            elif s.kind == "last":
                part.append(F.max_by(s.value, F.when(s.value.isNotNull(), F.col("_place"))).alias(t))
                carry.append(F.last(t, ignorenulls=True).over(before).alias(f"_c_{name}"))
            elif s.kind == "next":
                part.append(F.min_by(F.struct(s.value.alias("v")), F.col("_place")).alias(t))
                carry.append(F.lead(t).over(over).alias(f"_c_{name}"))
            elif s.kind == "previous":
                part.append(F.max_by(F.struct(s.value.alias("v")), F.col("_place")).alias(t))
                carry.append(F.lag(t).over(over).alias(f"_c_{name}"))
            else:
                total = _WINDOW[s.kind]
                part.append(total(s.value).alias(t))
                carry.append(total(t).over(W.partitionBy(*by)).alias(f"_c_{name}"))
        table = chunked.groupBy(*keys, CHUNK).agg(*part)
        table = table.select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(CHUNK).alias("_kc"), *carry
        )

        local = {}
        for name, s in steps.items():
            if s.kind in ("next", "previous"):
                near = F.lead if s.kind == "next" else F.lag
                local[f"_l_{name}"] = near(F.struct(s.value.alias("v"))).over(inner)
            elif not s.kind.startswith("group_"):
                local[f"_l_{name}"] = _plain(s, inner, inner)
        rows = chunked.withColumns(local) if local else chunked
        # One row per (hot group, chunk). Written out, or every later scan would compute this one twice more.
        # Its size is known then, and Spark broadcasts it if it is below its threshold in bytes.
        table = limits.pin(table)
        match = same_keys(by + [F.col(CHUNK)], [F.col(f"_k{i}") for i in range(len(keys))] + [F.col("_kc")])
        rows = rows.join(table, match, "left")

        out = {}
        for name, s in steps.items():
            mine, earlier = F.col(f"_l_{name}"), F.col(f"_c_{name}")
            if s.kind == "sum":
                out[name] = F.coalesce(mine, F.lit(0)) + F.coalesce(earlier, F.lit(0))
            elif s.kind == "max":
                out[name] = F.greatest(mine, earlier)
            elif s.kind == "last":
                out[name] = F.coalesce(mine, earlier)
            elif s.kind in ("next", "previous"):
                out[name] = F.coalesce(mine, earlier)["v"]
            else:
                out[name] = earlier
        return rows.select(*[F.col(c) for c in self.hot.columns if c not in out], *[v.alias(n) for n, v in out.items()])


def ordered(df: DataFrame, keys, order, group_rows: int | None = None, spread=()) -> Ordered:
    """Prepares ``df`` for scans per ``keys`` in ``order``; ``group_rows`` overrides the session's limit.

    Where the scans do not depend on the order of rows that are equal in ``order``, ``spread`` tells such rows apart where a
    large group is cut into chunks; it is neither sorted by within a chunk nor carried along.
    """
    spark = df.sparkSession
    keys, order = tuple(keys), tuple(order)
    if group_rows is None:
        if limits.small_input(df):
            return Ordered(keys, order, df)
        group_rows = limits.limit(spark, "groupRows")
    by = [F.col(k) for k in keys]
    # Pre-aggregated: at most rows / group_rows groups can pass.
    large = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > group_rows)
    large = limits.pin(large.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n"))
    found, rows = large.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if not found:
        return Ordered(keys, order, df)
    names = large.drop("_n")
    match = same_keys(by, [F.col(f"_k{i}") for i in range(len(keys))])
    if keys:
        hot, cold = df.join(names, match, "left_semi"), df.join(names, match, "left_anti")
    else:
        hot, cold = df, df.where(F.lit(False))
    chunks = int(-(-rows // group_rows) + 1)
    hot = hot.repartitionByRange(chunks, *by, *sort_columns(order), *spread)
    hot = limits.pin(hot.withColumn(CHUNK, F.spark_partition_id()))
    return Ordered(keys, order, cold, hot)


def first_rows(df: DataFrame, keys, order, n: int = 1, number: str = "") -> DataFrame:
    """The first ``n`` rows of each group in ``order``; ``number`` names a column for their place, from 1.

    A constant ``n`` lets Spark limit each map task's groups before the shuffle (WindowGroupLimit), so a hot
    group sends at most ``n`` rows per task. Spark does so up to a threshold; larger ``n`` use a scan.
    """
    keys = [_column(k) for k in keys]
    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        names = [f"_by{i}" for i in range(len(keys))]
        groups = ordered(df.withColumns(dict(zip(names, keys))), names, order)
        out = groups.scan(_rn=position()).where(F.col("_rn") <= n).rows(*names)
    else:
        place = F.row_number().over(W.partitionBy(*keys).orderBy(*sort_columns(order)))
        out = df.withColumn("_rn", place).where(F.col("_rn") <= n)
    if number:
        out = out.withColumn(number, F.col("_rn").cast("long"))
    return out.drop("_rn")
