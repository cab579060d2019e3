"""Integer arithmetic, bit fields, checked sums, sizes and ratios as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def int_div(a, b) -> Column:
    """Integer division that truncates towards zero."""
    return F.call_function("div", _c(a), _c(b))


def align_down(v, unit) -> Column:
    """Largest multiple of ``unit`` not above ``v`` (v >= 0)."""
    return _c(v) - _c(v) % _c(unit)


def align_up(v, unit) -> Column:
    """Smallest multiple of ``unit`` not below ``v`` (v >= 0)."""
    return ceil_div(v, unit) * _c(unit)


def ceil_div(a, b) -> Column:
    """``a / b`` rounded up (a >= 0, b > 0)."""
    return int_div(_c(a) + _c(b) - 1, b)


def div_half_up(a, b) -> Column:
    """``a / b`` rounded half up (a >= 0, b > 0)."""
    return int_div(_c(a) + int_div(b, 2), b)


def bits(v, shift: int, width: int) -> Column:
    """The ``width``-bit field of ``v`` that starts at bit ``shift``."""
    return F.shiftright(_c(v).cast("long"), shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def join_bits(high, low, width: int) -> Column:
    """``high`` above a ``width``-bit ``low``."""
    return F.shiftleft(_c(high).cast("long"), width).bitwiseOR(_c(low).cast("long"))


def tick_scale(v, from_hz: int, to_hz: int) -> Column:
    """Ticks of one clock in ticks of another, rounded down."""
    return int_div(_c(v) * to_hz, from_hz)


def checked_sum(*values) -> Column:
    """``struct(value, status)``: the sum, or null and ``overflow``."""
    return _checked(reduce(_sum_or_null, [_c(v).cast("long") for v in values]))


def checked_product(*values) -> Column:
    """``struct(value, status)``: the product, or null and ``overflow``."""
    return _checked(reduce(_product_or_null, [_c(v).cast("long") for v in values]))


LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


# Comparing against the bounds first keeps rows that overflow as cheap as the others: the try_ functions raise
# and catch an exception for each of them.
def _sum_or_null(a: Column, b: Column) -> Column:
    fits = F.when(b >= 0, a <= F.lit(LONG_MAX) - b).otherwise(a >= F.lit(LONG_MIN) - b)
    return F.when(fits, a + b)


def _product_or_null(a: Column, b: Column) -> Column:
    least = (a == LONG_MIN) | (b == LONG_MIN)
    size = F.abs(F.when(b == 0, 1).otherwise(b))
    below = -F.abs(a) >= int_div(F.lit(LONG_MIN), size)
    small = F.when((a < 0) != (b < 0), below).otherwise(F.abs(a) <= int_div(F.lit(LONG_MAX), size))
    return F.when(least, F.try_multiply(a, b)).when((b == 0) | small, a * b)


def _checked(total: Column) -> Column:
    return F.struct(
        total.alias("value"), F.when(total.isNull(), F.lit("overflow")).otherwise(F.lit("ok")).alias("status")
    )


def fit_box(w, h, side) -> Column:
    """``struct(w, h)`` shrunk to fit a square of ``side``, aspect kept, at least 1, never enlarged."""
    w, h, side = (_c(v).cast("long") for v in (w, h, side))
    inside = F.greatest(w, h) <= side
    wide = w >= h
    one = F.lit(1).cast("long")
    return F.struct(
        F.when(inside, w).when(wide, side).otherwise(F.greatest(int_div(w * side, h), one)).alias("w"),
        F.when(inside, h).when(wide, F.greatest(int_div(h * side, w), one)).otherwise(side).alias("h"),
    )


def display_size(w, h, num, den) -> Column:
    """``struct(w, h)`` on screen for a pixel shape ``num:den`` clamped to 1:4 .. 4:1; zero terms are square."""
    w, h, num, den = (_c(v).cast("long") for v in (w, h, num, den))
    square = (num == 0) | (den == 0)
    n = F.when(square, 1).when(num > den * 4, 4).when(den > num * 4, 1).otherwise(num)
    d = F.when(square, 1).when(num > den * 4, 1).when(den > num * 4, 4).otherwise(den)
    return F.struct(
        F.greatest(div_half_up(w * n, d), F.lit(1).cast("long")).alias("w"),
        F.greatest(h, F.lit(1).cast("long")).alias("h"),
    )


def reduction_factor(w, h, side, num=1, den=1) -> Column:
    """Largest whole factor that leaves the longer side on screen at least ``2 * side``."""
    shown = display_size(w, h, num, den)
    by_size = int_div(F.greatest(shown["w"], shown["h"]), F.greatest(_c(side).cast("long"), F.lit(1)) * 2)
    return F.greatest(
        F.least(by_size, int_div(_c(w).cast("long"), 2), int_div(_c(h).cast("long"), 2)), F.lit(1).cast("long")
    )


def ratio_reduce(a, b) -> Column:
    """``struct(num, den)`` divided by their greatest common divisor; a zero term gives 1:1."""
    a, b = _c(a).cast("long"), _c(b).cast("long")

    def step(acc: Column, _: Column) -> Column:
        done = acc["y"] == 0
        return F.struct(
            F.when(done, acc["x"]).otherwise(acc["y"]).alias("x"),
            F.when(done, acc["y"]).otherwise(acc["x"] % F.when(done, 1).otherwise(acc["y"])).alias("y"),
        )

    zero = (a == 0) | (b == 0)
    start = F.struct(a.alias("x"), b.alias("y"))
    # Euclid's steps are at most log(smaller) / log(golden ratio), plus one to put the larger number first.
    steps = F.ceil(F.log2(F.when(zero, 1).otherwise(F.least(a, b)).cast("double")) * 1.4405).cast("int") + 3
    gcd = F.aggregate(F.sequence(F.lit(1), steps), start, step)["x"]
    one = F.lit(1).cast("long")
    safe = F.when(zero, one).otherwise(gcd)
    return F.struct(
        F.when(zero, one).otherwise(int_div(a, safe)).alias("num"),
        F.when(zero, one).otherwise(int_div(b, safe)).alias("den"),
    )


def cents(v) -> Column:
    """A money value as whole cents."""
    return F.round(_c(v) * 100).cast("long")
