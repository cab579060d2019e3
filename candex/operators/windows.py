"""Ordered operators: prefixes, runs, budgets, samples, ranks and fallbacks.

All take ``keys`` (the group) and ``order`` (a total order within it). Running values come from
``plans.ordered``, which splits groups too large for one task; "first n" choices are cut on the map side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candex.functions.numbers import _c, int_div
from candex.plans.joins import asof
from candex.plans.ordered import (
    first_rows,
    group_count,
    group_max,
    group_min,
    group_sum,
    join_on,
    next_value,
    ordered,
    position,
    running_count,
    running_last,
    running_max,
    running_sum,
)

# Places to sample, in per mille of a group, in the order they are tried.
CLIP_PERMILLES = [250, 400, 150, 550, 700]
TITLE_PERMILLES = [250, 400, 150, 550, 700, 0]


def strictly_increasing(df, keys, order, v: str, limit=None, group_rows=None) -> DataFrame:
    """Drops rows at or above ``limit``, then rows not above the last kept value.

    Kept values increase, so the last kept one is the largest value seen before.
    """
    rows = df if limit is None else df.where(F.col(v) < _c(limit))
    seen = ordered(rows, keys, order, group_rows).scan(_top=running_max(v, inclusive=False))
    return seen.where(F.col("_top").isNull() | (F.col(v) > F.col("_top"))).rows("_top")


def expand_index(
    coarse: DataFrame, fine: DataFrame, by: list[str], coarse_order: str, first: str, position_col: str,
    payload: list[str], group_rows=None,
) -> tuple[DataFrame, DataFrame]:
    """Gives fine rows the columns of their coarse row: positions ``[first, next first)``, the last to the end.

    Returns ``(rows, bad)``: ``bad`` holds the groups whose references decrease or point past the fine rows;
    none of their rows is expanded. Fine positions count from 0 without gaps.
    """
    sizes = fine.groupBy(*by).agg((F.max(position_col) + 1).alias("_size"))
    ends = ordered(coarse, by, [coarse_order], group_rows).scan(_next=next_value(first)).rows()
    wrong = F.max((F.col(first) > F.col("_next")).cast("int")).alias("_down")
    bad = (
        ends.groupBy(*by).agg(wrong, F.max(first).alias("_top"))
        .transform(lambda groups: join_on(groups, sizes, by, "left"))
        .where((F.coalesce("_down", F.lit(0)) > 0) | (F.col("_top") > F.coalesce("_size", F.lit(0))))
        .select(*by)
    )
    found = asof(fine, coarse, by, position_col, first, payload, [coarse_order], "_m", group_rows)
    rows = found.where(F.col("_m").isNotNull()).select(*fine.columns, *[F.col(f"_m.{c}").alias(c) for c in payload])
    return join_on(rows, bad, by, "left_anti"), bad


def marks_to_spans(df, keys, pos: str, total: str, group_rows=None) -> DataFrame:
    """Each start mark spans ``[pos, stop)`` up to the next mark, the last one up to ``total``."""
    out = ordered(df, keys, [pos], group_rows).scan(_next=next_value(pos))
    return out.with_columns(stop=F.coalesce("_next", _c(total))).rows("_next")


def first_span(df, keys, pos: str, total: str, wanted: Column, group_rows=None) -> DataFrame:
    """The first span whose mark is the wanted one."""
    return first_rows(marks_to_spans(df, keys, pos, total, group_rows).where(wanted), keys, [pos])


def take_while(df, keys, order, ok: Column, cap: int | None = None, group_rows=None) -> DataFrame:
    """Rows before the first bad one; at most ``cap`` of them."""
    good = F.coalesce(ok, F.lit(False))
    rows = ordered(df, keys, order, group_rows).scan(_bad=running_count(~good)).where(F.col("_bad") == 0).drop("_bad")
    return rows.rows() if cap is None else first_rows(rows.rows(), keys, order, cap)


def edge_trim(df, keys, order, flat: str, moments=None, dark=(26, 36), group_rows=None) -> DataFrame:
    """Cuts flat rows from both ends of each group.

    Each run counts up to a quarter of the rows. Both at the cap: no cut. One at the cap, or thicknesses more
    than ``max(n / 60, 4)`` apart: the thinner one on both sides. Cuts are rounded outward to even places.
    With ``moments`` (columns n, sum, squares per row) a middle that is just as dark keeps everything.
    """
    flag = F.coalesce(F.col(flat), F.lit(False))
    rows = ordered(df, keys, order, group_rows).scan(_pos=position(), _n=group_count())
    rows = rows.scan(
        _lo=group_min(F.when(~flag, F.col("_pos"))), _hi=group_max(F.when(~flag, F.col("_pos")))
    )
    n = F.col("_n")
    cap = int_div(n, 4)
    lead = F.least(F.coalesce(F.col("_lo") - 1, n), cap)
    trail = F.least(F.coalesce(n - F.col("_hi"), n), cap)
    rows = rows.with_columns(_lead=lead, _trail=trail, _cap=cap)
    a, b, cap = F.col("_lead"), F.col("_trail"), F.col("_cap")
    tolerance = F.greatest(int_div(n, 60), F.lit(4))
    uneven = (a >= cap) | (b >= cap) | (F.abs(a - b) > tolerance)
    none = ((a >= cap) & (b >= cap)) | (n < 4)
    thin = F.least(a, b)
    rows = rows.with_columns(
        _top=F.when(none, 0).when(uneven, thin).otherwise(a), _end=F.when(none, 0).when(uneven, thin).otherwise(b)
    )
    start = F.col("_top") - F.col("_top") % 2
    stop = n - F.col("_end")
    stop = F.when(F.col("_end") == 0, n).otherwise(F.least(stop + stop % 2, n))
    kept = (F.col("_pos") > start) & (F.col("_pos") <= stop)
    rows = rows.with_columns(_kept=kept)
    helpers = ["_pos", "_n", "_lo", "_hi", "_lead", "_trail", "_cap", "_top", "_end", "_kept"]
    if moments is None:
        return rows.where(F.col("_kept")).rows(*helpers)
    wide = [F.when(F.col("_kept"), F.col(c)).cast("decimal(38,0)") for c in moments]
    rows = rows.scan(_mn=group_sum(wide[0]), _ms=group_sum(wide[1]), _mq=group_sum(wide[2]))
    m, s, q = F.col("_mn"), F.col("_ms"), F.col("_mq")
    black = (s <= m * dark[0]) & (m * q - s * s <= m * m * dark[1])
    return rows.where(F.col("_kept") | black).rows(*helpers, "_mn", "_ms", "_mq")


def cumulative_offsets(df, keys, order, length: str, group_rows=None) -> DataFrame:
    """``[start, stop)`` of each piece in the concatenation of its group."""
    rows = ordered(df, keys, order, group_rows).scan(stop=running_sum(length))
    return rows.with_columns(start=F.col("stop") - F.coalesce(F.col(length), F.lit(0))).rows()


def islands(df, keys, order, is_start: Column, group_rows=None) -> DataFrame:
    """Numbers the runs opened by start rows from 1; rows before the first start are dropped."""
    start = F.coalesce(is_start, F.lit(False))
    return ordered(df, keys, order, group_rows).scan(island=running_count(start)).where(F.col("island") > 0).rows()


def budget_prefix(df, keys, order, cost: str, budget, clip: bool = False, group_rows=None) -> DataFrame:
    """Rows up to the first that would exceed the budget (costs >= 0); ``clip`` keeps what is left of that one
    in ``taken``."""
    rows = ordered(df, keys, order, group_rows).scan(_spent=running_sum(cost))
    if not clip:
        return rows.where(F.col("_spent") <= _c(budget)).rows("_spent")
    before = F.col("_spent") - F.coalesce(F.col(cost), F.lit(0))
    rows = rows.with_columns(taken=F.least(F.coalesce(F.col(cost), F.lit(0)), _c(budget) - before))
    return rows.where(before < _c(budget)).rows("_spent")


def nested_quota(df, group: list[str], sub: list[str], order, k_sub: int, k_group: int) -> DataFrame:
    """At most ``k_sub`` rows per attempt and ``k_group`` for all attempts of a group, in order."""
    return first_rows(first_rows(df, [*group, *sub], order, k_sub), group, order, k_group)


def permille_sample(df, keys, order, permilles=CLIP_PERMILLES, group_rows=None) -> DataFrame:
    """The rows at ``(n - 1) * p / 1000``; ``permille`` and ``try_no`` (from 1) tell by which place each was
    chosen. A row met by several places counts for the first."""
    rows = ordered(df, keys, order, group_rows).scan(_pos=position(), _n=group_count())
    tries = F.array(*[F.struct(F.lit(i + 1).alias("no"), F.lit(p).alias("p")) for i, p in enumerate(permilles)])
    hits = F.filter(tries, lambda t: int_div((F.col("_n") - 1) * t["p"], 1000) == F.col("_pos") - 1)
    rows = rows.with_columns(_hit=F.get(hits, F.lit(0))).where(F.col("_hit").isNotNull())
    return rows.with_columns(permille=F.col("_hit.p"), try_no=F.col("_hit.no")).rows("_hit", "_pos", "_n")


def cap_then_rank(df, keys, order, cap: int, rank, k: int) -> DataFrame:
    """The first ``cap`` rows in arrival order are considered, then the best ``k`` by ``rank`` stay (ties keep
    arrival order); ``rank_no`` counts from 1."""
    return first_rows(first_rows(df, keys, order, cap), keys, [*rank, *order], k, "rank_no")


def rank_candidates(df, keys, rank, order, group_rows=None) -> DataFrame:
    """``rank_no`` of every row by ``rank`` (prefix ``-`` for largest first), ties in arrival order."""
    return ordered(df, keys, [*rank, *order], group_rows).scan(rank_no=position()).rows()


def first_acceptable_else_best(df, keys, order: list[str], ok: Column, score: str) -> DataFrame:
    """First acceptable attempt; without one, the highest score, ties to the earliest attempt."""
    good = F.coalesce(ok, F.lit(False))
    by = [good.desc(), *[F.when(good, F.col(c)).asc() for c in order], F.col(score).desc()]
    return first_rows(df, keys, [*by, *order])


def priority_fallback(stages: list[DataFrame], keys, order) -> DataFrame:
    """Each key takes the first row (by ``order``) of the first stage that has one; ``stage`` counts from 1."""
    numbered = [s.withColumn("stage", F.lit(i + 1)) for i, s in enumerate(stages)]
    return first_rows(reduce(DataFrame.unionByName, numbered), keys, ["stage", *order])


def two_view_fallback(
    first: DataFrame, second: DataFrame, keys: list[str], searched: DataFrame | None = None,
    costly: Column | None = None,
) -> DataFrame:
    """Rows of the second view only for keys the first did not resolve; keys in ``searched`` do not repeat the
    ``costly`` rows there."""
    rest = second.join(first.select(*keys).distinct(), keys, "left_anti")
    if searched is not None and costly is not None:
        done = searched.select(*keys).distinct().withColumn("_done", F.lit(True))
        rest = rest.join(done, keys, "left").where(F.col("_done").isNull() | ~costly).drop("_done")
    return first.withColumn("view", F.lit(1)).unionByName(rest.withColumn("view", F.lit(2)))


def last_assignment(df, keys, order, is_set: Column, value: Column, group_rows=None) -> DataFrame:
    """``known``: whether a value was set before the row and not cleared since; ``assigned``: that value.

    An assignment of null clears.
    """
    sets = F.when(F.coalesce(is_set, F.lit(False)), F.struct(value.alias("v")))
    rows = ordered(df, keys, order, group_rows).scan(_set=running_last(sets, inclusive=False))
    return rows.with_columns(assigned=F.col("_set.v"), known=F.col("_set.v").isNotNull()).rows("_set")


def choose_default(df, keys, ident: str, default: str, hint: str, order) -> DataFrame:
    """The row with the default id if the group has it, else with the hinted id, else the first."""
    rank = F.when(F.col(ident) == F.col(default), 0).when(F.col(ident) == F.col(hint), 1).otherwise(2)
    return first_rows(df, keys, [rank.asc(), *order])


def start_gate(df, keys, order, t: str, at, group_rows=None) -> DataFrame:
    """Drops rows until the first with ``t >= at``; later ones stay, also those without a time."""
    opens = F.coalesce(F.col(t) >= _c(at), F.lit(False))
    return ordered(df, keys, order, group_rows).scan(_open=running_count(opens)).where(F.col("_open") > 0).rows("_open")


def until_marker(
    df, keys, order, first: Column, end: Column, size: str | None = None, cap: int | None = None, group_rows=None
) -> DataFrame:
    """Rows from the first opening row to the first end marker after it (included). A second opening, or a row
    that would take the size past ``cap``, also ends the set and is left out."""
    opens, ends = F.coalesce(first, F.lit(False)), F.coalesce(end, F.lit(False))
    rows = ordered(df, keys, order, group_rows).scan(_open=running_count(opens)).where(F.col("_open") == 1)
    rows = rows.scan(_ended=running_count(ends & ~opens, inclusive=False)).where(F.col("_ended") == 0)
    if size is not None:
        rows = rows.scan(_size=running_sum(size)).where(F.col("_size") <= cap).drop("_size")
    return rows.rows("_open", "_ended")


def first_match_in_group(df, keys, order, ident: str, want: str, sentinel=None) -> DataFrame:
    """First member whose id is the group's valid id; the sentinel never matches."""
    hit = F.col(ident) == F.col(want)
    if sentinel is not None:
        hit = hit & (F.col(want) != F.lit(sentinel))
    return first_rows(df.where(hit), keys, order)


def ordered_union_distinct(frames: list[DataFrame], keys, order) -> DataFrame:
    """Lists appended in order (``list_no`` from 1, each in ``order``); later duplicates are dropped."""
    numbered = [f.withColumn("list_no", F.lit(i + 1)) for i, f in enumerate(frames)]
    return first_rows(reduce(DataFrame.unionByName, numbered), keys, ["list_no", *order])


def limit_per_group(df, keys, order, n: int) -> DataFrame:
    """At most ``n`` entries per group, the first ones."""
    return first_rows(df, keys, order, n)
