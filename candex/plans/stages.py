"""Stages that run one after the other, each only for the keys that none before it has resolved.

A stage is planned when it is its turn, with the unresolved keys as a written table. Their number and the least and
greatest value of each key are known then: the range becomes a filter that reaches the scan of the stage's input, and a
semi-join with the written keys, which Spark broadcasts if they are few, takes the rest out before anything is
shuffled. When no key is left, later stages are never planned and have no jobs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candex.plans import limits
from candex.plans.ordered import first_rows, join_on

#: Types whose least and greatest value can be put into a filter as they come back from the aggregate.
_RANGED = (T.IntegralType, T.StringType, T.DateType)


@dataclass(frozen=True)
class Stage:
    """One way to resolve keys. ``rows`` gets the unresolved keys and gives candidate rows, of these keys or more.

    A ``costly`` stage is not repeated for keys that were searched before.
    """

    name: str
    rows: Callable[[DataFrame], DataFrame]
    costly: bool = False


@dataclass(frozen=True)
class Report:
    """What a stage was asked for and gave; ``ran`` is false for those behind the last unresolved key."""

    name: str
    wanted: int
    resolved: int
    ran: bool


def within(rows: DataFrame, open_keys: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``open_keys``: a range filter for each key of a type that has one, then a semi-join."""
    ranged = [k for k in keys if isinstance(open_keys.schema[k].dataType, _RANGED)]
    if ranged:
        ends = open_keys.agg(*[f(k) for k in ranged for f in (F.min, F.max)], *[F.count_if(F.col(k).isNull()) for k in ranged]).first()
        for i, k in enumerate(ranged):
            low, high, nulls = ends[2 * i], ends[2 * i + 1], ends[2 * len(ranged) + i]
            near = F.col(k).between(low, high) if low is not None else F.lit(False)
            rows = rows.where(near | F.col(k).isNull() if nulls else near)
    return join_on(rows, open_keys, keys, "left_semi")


def run_stages(
    wanted: DataFrame, keys: list[str], stages: list[Stage], order, searched: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, list[Report]]:
    """Resolves the keys of ``wanted`` by the first stage that has a row for them.

    Returns the chosen rows (the columns of the stages, and ``stage`` from 1), the keys that no stage resolved, and a
    report on each stage. Of the rows of a key in a stage the first by ``order`` is chosen; null is a key like others. Costly
    stages leave out the keys of ``searched``. Every stage must give the same columns; a table without keys plans no stage,
    and its result has the columns of the first one.
    """
    open_keys = limits.pin(wanted.select(*keys).distinct())
    left = open_keys.count()
    found, reports = [], []
    for number, stage in enumerate(stages, start=1):
        if not left:
            reports.append(Report(stage.name, 0, 0, False))
            continue
        asked = open_keys
        if stage.costly and searched is not None:
            asked = limits.pin(join_on(open_keys, searched.select(*keys).distinct(), keys, "left_anti"))
            if asked.isEmpty():
                reports.append(Report(stage.name, 0, 0, False))
                continue
        rows = within(stage.rows(asked), asked, keys)
        chosen = limits.pin(first_rows(rows, keys, order).withColumn("stage", F.lit(number)))
        resolved = chosen.count()
        reports.append(Report(stage.name, left, resolved, True))
        if resolved:
            found.append(chosen)
            open_keys = limits.pin(join_on(open_keys, chosen.select(*keys), keys, "left_anti"))
            left -= resolved
    if not found:
        found = [stages[0].rows(open_keys.limit(0)).limit(0).withColumn("stage", F.lit(0))]
    return reduce(DataFrame.unionByName, found), open_keys, reports
