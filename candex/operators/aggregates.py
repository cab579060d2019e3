"""Aggregations. All of them combine on the map side; arrays are only built from groups bounded by a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candex.functions.names import fold
from candex.functions.numbers import _c, div_half_up, int_div
from candex.plans.ordered import first_rows, group_max, ordered, running_count, running_last, running_sum

WIDE = "decimal(38,0)"


def group_parts(df: DataFrame, keys: list[str], part: str, size: str, order, parts: tuple[int, int] | None = None) -> DataFrame:
    """One row per set: size of part 0 (the menu), the other parts with a size, in order, and their total.

    The first row of each (set, part) counts; rows without a part number are not parts, nor are those outside
    ``parts`` where it is given. The array of a set has as many entries as the set has parts.
    """
    known = df.where(F.col(part).isNotNull() if parts is None else F.col(part).between(*parts))
    once = first_rows(known, [*keys, part], order)
    title = (F.col(part) != 0) & (F.col(size) > 0)
    return once.groupBy(*keys).agg(
        F.max(F.when(F.col(part) == 0, F.col(size))).alias("menu_size"),
        F.array_sort(
            F.collect_list(F.when(title, F.struct(F.col(part).alias("part"), F.col(size).alias("size"))))
        ).alias("parts"),
        F.coalesce(F.sum(F.when(title, F.col(size))), F.lit(0)).alias("total"),
    )


def top_groups(
    df: DataFrame, keys: list[str], total: str, k: int, within: list[str] = (), minimum: int = 1
) -> DataFrame:
    """The ``k`` largest groups by the sum of ``total``, ties to the lower key; smaller than ``minimum`` drop out.

    ``within`` asks for the top ``k`` of each outer group.
    """
    sums = df.groupBy(*within, *keys).agg(F.sum(total).alias("total")).where(F.col("total") >= minimum)
    return first_rows(sums, list(within), ["-total", *keys], k)


# Bits of one digit of a sum. Digits are summed as plain longs and put together afterwards: exact for all longs and
# up to 2^42 rows, without a wide decimal per row.
DIGIT = 21
# A value is high * 2^32 + low with both within 2^31, so that their products are longs.
HALF = 32
SQUARES = tuple(f"{p}{i}" for p in ("hh", "hl", "ll") for i in range(3))


def _digit_sums(v: Column) -> list[Column]:
    """Counts and sums of ``v`` and of its squares, by digits."""
    mask = F.lit((1 << DIGIT) - 1).cast("long")
    # Sign-extended low half; the high half makes up for it.
    low = F.shiftright(F.shiftleft(v, HALF), HALF)
    high = F.shiftright(v, HALF) + F.when(low < 0, 1).otherwise(0)
    sums = [F.count(v).alias("n"), F.sum(v.bitwiseAND(mask)).alias("s0"), F.sum(F.shiftright(v, DIGIT)).alias("s1")]
    for name, product in (("hh", high * high), ("hl", high * low), ("ll", low * low)):
        sums += [
            F.sum(product.bitwiseAND(mask)).alias(f"{name}0"),
            F.sum(F.shiftright(product, DIGIT).bitwiseAND(mask)).alias(f"{name}1"),
            F.sum(F.shiftright(product, 2 * DIGIT)).alias(f"{name}2"),
        ]
    return sums


def _joined(parts: list[Column]) -> Column:
    """A sum put together from its digits; nothing counts as 0."""
    total = F.lit(0).cast(WIDE)
    for i, p in enumerate(parts):
        total = total + F.coalesce(p, F.lit(0).cast("long")).cast("decimal(19,0)") * F.lit(1 << (DIGIT * i)).cast(
            "decimal(14,0)"
        )
    return total.cast(WIDE)


def _moments(n: Column, s: list[Column], q: list[Column]) -> dict:
    """Count, exact sums, mean and population standard deviation.

    The deviation comes from exact integers as long as they have at most 38 digits, else from doubles.
    """
    total = _joined(s)
    hh, hl, ll = (_joined(q[i : i + 3]) for i in (0, 3, 6))
    wide = lambda x, bits: x * F.lit(1 << bits).cast("decimal(20,0)")
    squares = (wide(wide(hh, 32).cast(WIDE), 32) + wide(hl, HALF + 1) + ll).cast(WIDE)
    exact = F.try_subtract(F.try_multiply(n.cast(WIDE), squares), F.try_multiply(total, total))
    rough = n.cast("double") * squares.cast("double") - total.cast("double") * total.cast("double")
    spread = F.greatest(F.coalesce(exact.cast("double"), rough), F.lit(0.0))
    count = n.cast("double")
    return {
        "n": n,
        "total": total,
        "squares": squares,
        "mean": F.when(n > 0, total.cast("double") / count).otherwise(0.0),
        "stddev": F.when(n > 0, F.sqrt(spread) / count).otherwise(0.0),
    }


def moments(df: DataFrame, keys: list[str], v) -> DataFrame:
    """Exact count, sum and sum of squares of integers, with mean and population standard deviation."""
    sums = df.groupBy(*keys).agg(*_digit_sums(_c(v).cast("long")))
    c = F.col
    values = _moments(c("n"), [c("s0"), c("s1")], [c(x) for x in SQUARES])
    return sums.select(*keys, *[e.alias(name) for name, e in values.items()])


DIGITS = ("n", "s0", "s1", *SQUARES)


def _class_moments(keep) -> dict:
    """``_moments`` over the classes that ``keep`` accepts."""
    chosen = F.filter("_classes", keep)

    def add(field: str) -> Column:
        zero = F.lit(0).cast("long")
        return F.aggregate(chosen, zero, lambda a, c: a + F.coalesce(c[field], zero))

    n, s0, s1, *squares = (add(f) for f in DIGITS)
    return _moments(n, [s0, s1], squares)


def grid_moments(df: DataFrame, keys: list[str], row: str, col: str, v, limits=(16_384, 262_144)) -> DataFrame:
    """``moments`` on a grid sample: every cell up to the first limit, every 2nd row and column up to the
    second, else every 4th, counted from the smallest row and column of the group.

    The step is known only after the cells are counted. Sums are kept per (row mod 4, column mod 4), so one
    pre-aggregated pass serves every step: 16 classes per group are picked from afterwards.
    """
    classes = df.groupBy(*keys, F.pmod(row, F.lit(4)).alias("_r"), F.pmod(col, F.lit(4)).alias("_k")).agg(
        *_digit_sums(_c(v).cast("long")), F.count(F.lit(1)).alias("cells"), F.min(row).alias("r0"), F.min(col).alias("c0")
    )
    groups = classes.groupBy(*keys).agg(
        F.sum("cells").alias("_cells"),
        F.min("r0").alias("_r0"),
        F.min("c0").alias("_c0"),
        F.collect_list(F.struct("_r", "_k", *DIGITS)).alias("_classes"),
    )
    small, medium = limits
    step = F.when(F.col("_cells") <= small, 1).when(F.col("_cells") <= medium, 2).otherwise(4)
    groups = groups.withColumn("step", step)

    def keep(c: Column) -> Column:
        on_row = F.pmod(c["_r"] - F.col("_r0"), F.col("step")) == 0
        return on_row & (F.pmod(c["_k"] - F.col("_c0"), F.col("step")) == 0)

    return groups.select(*keys, "step", *[e.alias(name) for name, e in _class_moments(keep).items()])


def flat_lines(
    df: DataFrame, keys: list[str], line: str, pos: str, v, max_mean: int = 26, max_variance: int = 36,
    long_line: int = 256,
) -> DataFrame:
    """Whether each line is flat and dark, on every 4th (long lines) or 2nd sample from its first position.

    Integer arithmetic only: ``sum <= mean * n`` and ``n * squares - sum^2 <= variance * n^2``.
    """
    classes = df.groupBy(*keys, line, F.pmod(pos, F.lit(4)).alias("_k")).agg(
        *_digit_sums(_c(v).cast("long")), F.count(F.lit(1)).alias("cells"), F.min(pos).alias("p0")
    )
    lines = classes.groupBy(*keys, line).agg(
        F.sum("cells").alias("_cells"),
        F.min("p0").alias("_p0"),
        F.collect_list(F.struct("_k", *DIGITS)).alias("_classes"),
    )
    lines = lines.withColumn("step", F.when(F.col("_cells") >= long_line, 4).otherwise(2))

    def keep(c: Column) -> Column:
        return F.pmod(c["_k"] - F.col("_p0"), F.col("step")) == 0

    values = _class_moments(keep)
    lines = lines.select(*keys, line, "step", *[values[f].alias(f) for f in ("n", "total", "squares")])
    n, s, q = F.col("n").cast(WIDE), F.col("total"), F.col("squares")
    flat = (n > 0) & (s <= n * max_mean) & (n * q - s * s <= n * n * max_variance)
    return lines.withColumn("flat", F.coalesce(flat, F.lit(False)))


def box_reduce(df: DataFrame, keys: list[str], row: str, col: str, v, factor: int, origin=(0, 0)) -> DataFrame:
    """Whole ``factor`` x ``factor`` boxes averaged, half up; boxes with missing cells are dropped."""
    r, c = (F.col(row) - origin[0]).cast("long"), (F.col(col) - origin[1]).cast("long")
    boxes = (
        df.where((r >= 0) & (c >= 0))
        .groupBy(*keys, int_div(r, factor).alias("box_row"), int_div(c, factor).alias("box_col"))
        .agg(F.sum(_c(v).cast("long")).alias("_s"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") == factor * factor)
    )
    return boxes.select(*keys, "box_row", "box_col", div_half_up("_s", "_n").alias("value"))


def damage_gate(df: DataFrame, keys: list[str], bad, total, ratio: int = 10) -> DataFrame:
    """Groups with something in them and at most one bad item in ``ratio``."""
    sums = df.groupBy(*keys).agg(F.sum(_c(bad)).alias("bad"), F.sum(_c(total)).alias("total"))
    return sums.where((F.col("total") > 0) & (F.col("bad") * ratio <= F.col("total")))


def stream_verdict(
    df: DataFrame, keys: list[str], order, protected: str, limit: int = 8, group_rows: int | None = None
) -> DataFrame:
    """``protected`` as soon as ``limit`` protected rows came before any clear one, or at the end when there
    are some and no clear ones; else ``nothing``. ``early`` tells that the limit decided."""
    flag = F.coalesce(F.col(protected), F.lit(False))
    runs = ordered(df, keys, order, group_rows).scan(_p=running_count(flag), _c=running_count(~flag)).rows()
    sums = runs.groupBy(*keys).agg(
        F.count_if(~flag).alias("clear"),
        F.count_if(flag).alias("protected_rows"),
        F.bool_or((F.col("_c") == 0) & (F.col("_p") >= limit)).alias("early"),
    )
    shut = F.col("early") | ((F.col("protected_rows") > 0) & (F.col("clear") == 0))
    return sums.withColumns(
        {"verdict": F.when(shut, "protected").otherwise("nothing"), "saw_video": F.col("clear") > 0}
    )


def reconcile_size(files: DataFrame, extents: DataFrame, key: str, declared: str, length: str) -> DataFrame:
    """Deliverable size: the declared one, at most the sum of the extents; ``oversize`` marks a shortfall."""
    sums = extents.groupBy(key).agg(F.sum(length).alias("described"))
    out = files.join(sums, key, "left").withColumn("described", F.coalesce("described", F.lit(0)))
    return out.withColumns(
        {
            "deliverable": F.least(F.col(declared), F.col("described")),
            "status": F.when(F.col(declared) > F.col("described"), "oversize").otherwise("ok"),
        }
    )


def latest_version(df: DataFrame, keys: list[str], seq: str, order: list[str]) -> DataFrame:
    """Last write per key: highest sequence, ties to the later row."""
    return first_rows(df, keys, [F.col(seq).desc(), *[F.col(c).desc() for c in order]])


def dedup_first(df: DataFrame, keys: list[str], order, fold_case: bool = False) -> DataFrame:
    """First occurrence per key, optionally whatever the case of its strings."""
    strings = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    by = [fold(k) if fold_case and k in strings else F.col(k) for k in keys]
    return first_rows(df, by, order)


def reassemble(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    is_first: str,
    is_last: str,
    part: str,
    on_new_first: str = "close",
    separator: str = "",
    max_length: int | None = None,
    stated: str | None = None,
    broken: str | None = None,
    group_rows: int | None = None,
) -> DataFrame:
    """Joins a first part and its continuations.

    A fragment is complete at its last part, or once it holds the length ``stated`` in its first row (it is cut
    there). Continuations without a first, or after completion, are dropped; so is everything from a ``broken``
    row to the next first. A new first closes the fragment before it (``close``, packets: every fragment is
    kept), replaces it (``replace``, objects: the last fragment of the key stays) or stops the set (``stop``,
    compositions: the first one stays). With ``max_length``, a longer fragment has neither ``parts`` nor ``text``
    and is not complete; its parts are not gathered. Output: ``keys, fragment, parts, text, complete``.
    """
    no = F.lit(False)
    bad = no if broken is None else F.coalesce(F.col(broken), no)
    first = F.coalesce(F.col(is_first), no) & ~bad
    last = F.coalesce(F.col(is_last), no) & ~bad
    # 0 stands for no stated length.
    goal = F.lit(0) if stated is None else F.greatest(F.coalesce(F.col(stated), F.lit(0)), F.lit(0))
    size = F.when(bad, 0).otherwise(F.length(F.coalesce(F.col(part), F.lit(""))) + len(separator)).cast("long")
    rows = ordered(df, keys, order, group_rows).scan(
        fragment=running_count(first), _ends=running_count(last | bad, inclusive=False), _len=running_sum(size)
    )
    rows = rows.where(F.col("fragment") > 0)
    # Values at the fragment's first row: ends seen and length gathered before it, length stated.
    steps = {
        "_ends0": running_last(F.when(first, F.col("_ends"))),
        "_len0": running_last(F.when(first, F.col("_len") - size)),
        "_goal": running_last(F.when(first, goal.cast("long"))),
    }
    if on_new_first == "replace":
        steps["_top"] = group_max("fragment")
    rows = rows.scan(**steps)
    rows = rows.with_columns(_used=F.col("_len") - F.col("_len0") - len(separator)).rows()
    used, goal = F.col("_used"), F.col("_goal")
    rows = rows.where((F.col("_ends") == F.col("_ends0")) & ~bad & ((goal == 0) | (used - size < goal)))
    if on_new_first == "stop":
        rows = rows.where(F.col("fragment") == 1)
    elif on_new_first == "replace":
        rows = rows.where(F.col("fragment") == F.col("_top"))
    full = (goal > 0) & (used >= goal)
    fits = F.lit(True) if max_length is None else (used <= max_length) | full
    filled = F.col(part) != "" if not separator else F.col(part).isNotNull()
    piece = F.when(fits & filled, F.struct(*[F.col(c) for c in order], F.col(part).alias("_part")))
    out = rows.groupBy(*keys, "fragment").agg(
        F.count(F.lit(1)).alias("parts"),
        F.bool_or(last | full).alias("complete"),
        F.bool_and(fits).alias("_fits"),
        F.max(goal).alias("_cut"),
        F.array_sort(F.collect_list(piece)).alias("_pieces"),
    )
    text = F.array_join(F.transform("_pieces", lambda p: p["_part"]), separator)
    text = F.when(F.col("_cut") == 0, text).otherwise(F.left(text, F.col("_cut").cast("int")))
    fit = F.col("_fits")
    return out.select(
        *keys, "fragment", F.when(fit, F.col("parts")).alias("parts"), F.when(fit, text).alias("text"), (fit & F.col("complete")).alias("complete")
    )


def chunk_coverage(
    df: DataFrame, keys: list[str], off, length, chunk: int = 32_768, sizes: DataFrame | None = None, size: str = "size"
) -> DataFrame:
    """Chunks and bytes read per key: ranges shorter than a chunk load the aligned chunks they touch (each
    once), longer ones are read directly. With ``sizes`` (one ``size`` per key) a last chunk ends there."""
    spans = df.select(*keys, _c(off).cast("long").alias("_o"), _c(length).cast("long").alias("_l")).where("_l > 0")
    long = F.col("_l") >= chunk
    # A range shorter than a chunk touches at most two of them.
    touched = F.array_distinct(
        F.array(int_div("_o", chunk), int_div(F.col("_o") + F.col("_l") - 1, chunk))
    )
    small = spans.where(~long).select(*keys, F.explode(touched).alias("_chunk")).distinct()
    loaded = F.lit(chunk).cast("long")
    if sizes is not None:
        small = small.join(sizes.select(*keys, F.col(size).alias("_size")), keys, "left")
        loaded = F.least(loaded, F.col("_size") - F.col("_chunk") * chunk)
    cached = small.select(
        *keys, F.lit(1).alias("chunks"), loaded.alias("chunk_bytes"), F.lit(0).alias("direct_reads"),
        F.lit(0).cast("long").alias("direct_bytes"),
    )
    direct = spans.where(long).select(
        *keys, F.lit(0).alias("chunks"), F.lit(0).cast("long").alias("chunk_bytes"), F.lit(1).alias("direct_reads"),
        F.col("_l").alias("direct_bytes"),
    )
    out = cached.unionByName(direct).groupBy(*keys).agg(
        F.sum("chunks").alias("chunks"), F.sum("direct_reads").alias("direct_reads"),
        F.sum("direct_bytes").alias("direct_bytes"), F.sum("chunk_bytes").alias("_cached"),
    )
    return out.withColumn("bytes", F.col("_cached") + F.col("direct_bytes")).drop("_cached")
