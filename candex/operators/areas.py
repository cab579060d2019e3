"""Flat dark bars cut from both axes of a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candex.functions.numbers import int_div
from candex.operators.aggregates import WIDE, flat_lines, grid_moments
from candex.plans import limits
from candex.plans.ordered import join_on


def bar_pairs(lines: DataFrame, keys: list[str], line: str, prefix: str) -> DataFrame:
    """The cuts of each group at both ends of its lines: ``first`` line, ``size``, ``lead`` and ``trail``, with a prefix.

    Each run of flat lines counts up to a quarter of the size. Both at that: no cut. One at that, or more than
    ``max(size / 60, 4)`` apart: the thinner one on both sides. Lines without a row count as flat. Plain aggregates:
    no window, so a group may have any number of lines.
    """
    solid = F.when(~F.col("flat"), F.col(line))
    ends = lines.groupBy(*keys).agg(F.min(line).alias("_from"), F.max(line).alias("_to"), F.min(solid).alias("_lo"), F.max(solid).alias("_hi"))
    size = F.col("_to") - F.col("_from") + 1
    cap = int_div(size, 4)
    a = F.least(F.coalesce(F.col("_lo") - F.col("_from"), size), cap)
    b = F.least(F.coalesce(F.col("_to") - F.col("_hi"), size), cap)
    none = (size < 4) | ((a >= cap) & (b >= cap))
    uneven = (a >= cap) | (b >= cap) | (F.abs(a - b) > F.greatest(int_div(size, 60), F.lit(4)))

    def cut(own: Column) -> Column:
        return F.when(none, 0).when(uneven, F.least(a, b)).otherwise(own).cast("long")

    found = {"first": F.col("_from").cast("long"), "size": size.cast("long"), "lead": cut(a), "trail": cut(b)}
    return ends.select(*keys, *[v.alias(f"{prefix}{name}") for name, v in found.items()])


def active_area(df: DataFrame, keys: list[str], row: str, col: str, v: str, max_mean: int = 26, max_variance: int = 36) -> DataFrame:
    """The part of each grid left after cutting flat dark bars: ``keys, top, left, height, width, cut``.

    ``df`` has one row per cell; ``row`` and ``col`` are integers, places are counted from their smallest values. Rows are
    judged over their whole width, columns only on the rows that remain, so bars above and below do not make every column
    dark. Cuts go outward to even places. The whole grid stays (``cut`` false) if either side has fewer than 4 lines, if
    there are no bars, or if what would remain is as dark as a bar. Cells that are null are left out of the sums; keys may be null.

    Three aggregations over the cells, each combined on the map side by line and place modulo 4; what is joined back to the
    cells is one row per grid.
    """
    cells = df.select(*keys, F.col(row).cast("long").alias("_row"), F.col(col).cast("long").alias("_col"), F.col(v).alias("_v"))

    def within(bars: DataFrame, inside: Column) -> DataFrame:
        return join_on(cells, bars, keys).where(inside).select(*keys, "_row", "_col", "_v")

    def between(place: str, prefix: str) -> Column:
        at = F.col(place) - F.col(f"{prefix}first")
        return (at >= F.col(f"{prefix}lead")) & (at < F.col(f"{prefix}size") - F.col(f"{prefix}trail"))

    down = limits.pin(bar_pairs(flat_lines(cells, keys, "_row", "_col", "_v", max_mean, max_variance), keys, "_row", "_y"))
    left = within(down, between("_row", "_y"))
    across = bar_pairs(flat_lines(left, keys, "_col", "_row", "_v", max_mean, max_variance), keys, "_col", "_x")

    bars = join_on(down, across, keys)
    none = F.lit(0).cast("long")
    for p in ("_x", "_y"):
        lead, trail, size = (F.col(f"{p}{n}") for n in ("lead", "trail", "size"))
        stop = size - trail
        end = F.when(trail == 0, none).otherwise(size - F.least(stop + stop % 2, size))
        bars = bars.withColumns({f"{p}lead": lead - lead % 2, f"{p}trail": end, f"{p}bar": lead + trail > 0})
    bars = limits.pin(bars.withColumn("_cut", (F.col("_xbar") | F.col("_ybar")) & (F.col("_xsize") >= 4) & (F.col("_ysize") >= 4)))

    middle = within(bars.where("_cut"), between("_row", "_y") & between("_col", "_x"))
    m = grid_moments(middle, keys, "_row", "_col", "_v")
    n, s, q = F.col("n").cast(WIDE), F.col("total"), F.col("squares")
    dark = (n > 0) & (s <= n * max_mean) & (n * q - s * s <= n * n * max_variance)
    known = join_on(bars, m.select(*keys, dark.alias("_dark")), keys, "left")
    known = known.withColumn("_cut", F.col("_cut") & ~F.coalesce("_dark", F.lit(False)))
    kept = lambda c: F.when(F.col("_cut"), F.col(c)).otherwise(none)
    return known.select(
        *keys, kept("_ylead").alias("top"), kept("_xlead").alias("left"),
        (F.col("_ysize") - kept("_ylead") - kept("_ytrail")).alias("height"),
        (F.col("_xsize") - kept("_xlead") - kept("_xtrail")).alias("width"), F.col("_cut").alias("cut"),
    )
