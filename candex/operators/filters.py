"""Row filters and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candex.functions.names import byte_sum, fold
from candex.functions.numbers import _c
from candex.plans.ordered import first_rows


def first_by_name(df: DataFrame, parent, name: str, value: str, order, kind: Column | None = None) -> DataFrame:
    """First entry per parent whose name is ``value``, whatever the case, and which is of the wanted kind."""
    hits = df.where(fold(name) == fold(F.lit(value)))
    if kind is not None:
        hits = hits.where(kind)
    return first_rows(hits, parent, order)


def keep_where(df: DataFrame, predicate: Column) -> DataFrame:
    """All rows the predicate accepts."""
    return df.where(predicate)


def size_gate(df: DataFrame, size, maximum: int, minimum: int = 1) -> DataFrame:
    """Drops empty, oversized and unknown sizes."""
    return df.where(F.coalesce(_c(size), F.lit(0)).between(minimum, maximum))


def bounds_gate(df: DataFrame, bounds: dict) -> DataFrame:
    """Keeps rows with every dimension within its ``(low, high)``."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).between(lo, hi) for c, (lo, hi) in bounds.items()]))


def quality_band(mean, stddev, mean_lo=30, mean_hi=225, sd_lo=10) -> Column:
    """Whether a mean lies in the band and the spread is large enough."""
    return F.coalesce(_c(mean).between(mean_lo, mean_hi) & (_c(stddev) >= sd_lo), F.lit(False))


def quarantine(df: DataFrame, rules) -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)``: each ``(status, reason, bad)`` is asked in order, the first bad one is recorded.

    A rule that is null for a row does not reject it.
    """
    why = F.coalesce(
        *[
            F.when(bad, F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason")))
            for status, reason, bad in rules
        ]
    )
    judged = df.withColumn("_why", why)
    good = judged.where(F.col("_why").isNull()).drop("_why")
    rejects = judged.where(F.col("_why").isNotNull())
    return good, rejects.select(*df.columns, "_why.status", "_why.reason")


def settle_errors(
    first: DataFrame, second: DataFrame, keys: list[str], status: str = "status", weak: str = "no volume"
) -> DataFrame:
    """The error of inputs that two attempts in turn left without a result: the second one's, unless that is
    only the ``weak`` one (nothing to look at), in which case the first one's stands."""
    fields = [c for c in first.columns if c not in keys]
    a = first.select(*keys, F.struct(*fields).alias("_a"))
    b = second.select(*keys, F.struct(*fields).alias("_b"))
    both = a.join(b, keys)
    stands = F.when(F.col(f"_b.{status}") == weak, F.col("_a")).otherwise(F.col("_b"))
    return both.select(*keys, stands.alias("_e")).select(*keys, "_e.*")


def checksum_gate(df: DataFrame, text, expected, skip: int | None = None) -> DataFrame:
    """Keeps rows whose bytes sum to the stored check value modulo 256."""
    return df.where(byte_sum(text, skip) == _c(expected))
