"""Lookups and joins.

Equi-joins carry no broadcast hints: Spark broadcasts a side only below its own size threshold, and adaptive
execution splits the hot keys of the others (one side is unique in each lookup here).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candex.functions.numbers import _c, int_div
from candex.plans import limits
from candex.plans.joins import asof, explode_range, rank_bounds, ranks_join
from candex.plans.ordered import group_max, group_min, group_sum, join_on, next_value, ordered, position, running_max, running_sum

# Bytes that hold the picture at an entry point, per profile, for size codes 1 to 6.
PICTURE_BOUNDS = {
    "hd": [131072, 262144, 393216, 589824, 917504, 1310720],
    "uhd": [786432, 1572864, 2359296, 3145728, 3932160, 4718592],
}

# Bytes to read first without a bound, and at most, per profile; bytes added to a bound.
DEFAULT_SPANS = {"hd": 1 << 20, "uhd": 3 << 20}
MAX_SPANS = {"hd": 2 << 20, "uhd": 6 << 20}
SPAN_EXTRA = 6144


def picture_bounds(spark: SparkSession) -> DataFrame:
    """``PICTURE_BOUNDS`` as a table of profile, code and bound."""
    rows = ", ".join(
        f"('{profile}', {code}, {bound}L)" for profile, sizes in PICTURE_BOUNDS.items() for code, bound in enumerate(sizes, 1)
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(profile, code, bound)")


def range_lookup(
    points: DataFrame, ranges: DataFrame, p: str, first: str, blocks: str, target: str, by=(), group_rows=None
) -> DataFrame:
    """Translates ``p`` through ranges ``[first, first + blocks)``: ``address`` = target + distance.

    ``status`` is ``ok``, ``outside`` (before the first range or in a gap) or ``not recorded`` (null target).
    """
    found = asof(points, ranges, list(by), p, first, [first, blocks, target], match="_r", group_rows=group_rows)
    rel = F.col(p) - F.col(f"_r.{first}")
    inside = F.coalesce(rel < F.col(f"_r.{blocks}"), F.lit(False))
    known = F.col(f"_r.{target}")
    return found.withColumns(
        {
            "status": F.when(~inside, "outside").when(known.isNull(), "not recorded").otherwise("ok"),
            "address": F.when(inside, known + rel),
        }
    ).drop("_r")


def remap_lookup(keys: DataFrame, remap: DataFrame, key: str, value: str, sentinel, base=0) -> DataFrame:
    """Remaps ``key``; status ``outside`` when the table has no entry, ``unallocated`` for the sentinel."""
    table = remap.select(F.col(key), F.col(value).alias("_mapped"), F.lit(True).alias("_known"))
    mapped = F.col("_mapped")
    status = (
        F.when(F.col("_known").isNull(), "outside")
        .when(mapped.eqNullSafe(F.lit(sentinel)), "unallocated")
        .otherwise("ok")
    )
    out = keys.join(table, key, "left").withColumn("status", status)
    return out.withColumn("address", F.when(F.col("status") == "ok", _c(base) + mapped)).drop("_mapped", "_known")


def two_level_lookup(
    df: DataFrame, refs: DataFrame, bases: DataFrame, ref: str, number: str, base: str
) -> DataFrame:
    """``ref`` -> ``number`` (in ``refs``) -> ``base`` (in ``bases``); the missing hop is named in ``status``."""
    hop1 = refs.select(ref, number, F.lit(True).alias("_hop1"))
    hop2 = bases.select(number, base, F.lit(True).alias("_hop2"))
    status = F.when(F.col("_hop1").isNull(), "no map").when(F.col("_hop2").isNull(), "no partition").otherwise("ok")
    out = df.join(hop1, ref, "left").join(hop2, number, "left").withColumn("status", status)
    return out.drop("_hop1", "_hop2")


def slice_extents(
    requests: DataFrame,
    extents: DataFrame,
    key: str,
    request: str,
    off: str,
    length: str,
    order: list[str],
    ext_len: str,
    sector: str,
    size: str,
    group_rows: int | None = None,
) -> DataFrame:
    """Cuts each request ``[off, off + length)`` of a file into pieces by extent.

    ``extents`` are consecutive in ``order``; a null ``sector`` is a hole. ``requests`` carries the declared
    ``size``, to which the range is clipped. A part past the last extent is one more hole. Pieces:
    ``key, request, ord`` (1-based extent, null past the end), ``start, stop`` (file offsets), ``hole``, and
    ``address`` = sector + offset within the extent. ``(key, request)`` is unique among the requests.

    Extents tile the file, so a request covers a run of extent numbers: one scan over both sides gives its
    ends and the pieces come from an equi-join on (file, extent number), which spreads even one huge file.
    """
    # Read by the scan and by the join: written once.
    placed = limits.pin(
        ordered(extents.where(F.col(ext_len) > 0), [key], order, group_rows)
        .scan(ord=position(), ext_stop=running_sum(ext_len))
        .rows()
        .select(key, "ord", (F.col("ext_stop") - F.col(ext_len)).alias("ext_start"), "ext_stop", sector)
    )
    stop = F.least(F.col(off) + F.col(length), F.col(size))
    wanted = requests.select(key, request, F.col(off).cast("long").alias("_off"), stop.cast("long").alias("_stop"))
    wanted = wanted.where("_off < _stop")
    # Starts increase with the extent number, so the rank of a start is that number.
    runs, _ = rank_bounds(
        wanted, placed, [key], [request, "_off", "_stop"], {"_a": (F.col("_off"), True), "_b": (F.col("_stop"), False)},
        "ext_start", ["ord"], ["ext_stop"], group_rows, points_too=False, _covered=group_max("_point.ext_stop"),
    )
    # Read for the pieces and for what lies past the last extent: the scan runs once.
    wanted = limits.pin(runs.select(key, "_span.*", "_a", "_b", F.coalesce("_covered", F.lit(0).cast("long")).alias("_covered")))
    runs = explode_range(wanted.where("_off < _covered"), F.col("_a"), F.col("_b") + 1, "ord")
    pieces = join_on(runs.select(key, request, "_off", "_stop", "ord"), placed, [key, "ord"])
    begin = F.greatest("_off", "ext_start")
    pieces = pieces.select(
        key,
        request,
        "ord",
        begin.alias("start"),
        F.least("_stop", "ext_stop").alias("stop"),
        F.col(sector).isNull().alias("hole"),
        (F.col(sector) + (begin - F.col("ext_start"))).alias("address"),
    )
    tail = wanted.where(F.col("_covered") < F.col("_stop")).select(
        key,
        request,
        F.lit(None).cast("long").alias("ord"),
        F.greatest("_off", "_covered").alias("start"),
        F.col("_stop").alias("stop"),
        F.lit(True).alias("hole"),
        F.lit(None).cast("long").alias("address"),
    )
    return pieces.unionByName(tail)


def translate_extents(
    pieces: DataFrame, ranges: DataFrame, key: list[str], address: str, length: str, first: str, blocks: str, target: str,
    by=(), group_rows: int | None = None,
) -> DataFrame:
    """Translates whole intervals ``[address, address + length)`` through ranges, cut at the borders of both.

    An address belongs to the last range that begins at or before it (of equal ones the longest), if it is less than ``blocks``
    from its beginning, as in ``range_lookup``. Parts: ``by, key, start`` (distance from the piece's address)``, length,
    target`` (of the part's first cell) and ``status``: ``ok``, ``not recorded`` (null target) or ``outside``. The parts of a
    piece add up to it. Pieces of null address or of no length have none. ``by`` and ``key`` are unique among the pieces.

    Both sides go through one scan that numbers the ranges, so a piece covers a run of numbers, and the parts come from an
    equi-join on them: neither a long piece nor a crowded map is one task.
    """
    by = list(by)
    best = ranges.where(F.col(first).isNotNull()).groupBy(*by, F.col(first).cast("long").alias("_first")).agg(
        F.max(F.struct(F.coalesce(F.col(blocks), F.lit(0)).cast("long").alias("n"), F.col(target).alias("t"))).alias("_r")
    )
    placed = ordered(best, by, ["_first"], group_rows).scan(_next=next_value("_first")).rows()
    placed = placed.select(*by, "_first", "_next", (F.col("_first") + F.col("_r.n")).alias("_stop"), F.col("_r.t").alias("_t"))
    spans = pieces.select(*by, *key, F.col(address).cast("long").alias("_a"), (F.col(address) + F.col(length)).cast("long").alias("_b"))
    spans = spans.where("_a < _b")
    runs, dots = rank_bounds(
        spans, placed, by, [*key, "_a", "_b"], {"_from": (F.col("_a"), True), "_upto": (F.col("_b"), False)}, "_first", ["_first"],
        ["_first", "_next", "_stop", "_t"], group_rows, _least=group_min("_point._first"),
    )
    # The runs are read for the parts before all ranges and for those in them.
    runs = limits.pin(runs)
    a, b = F.col("_span._a"), F.col("_span._b")
    kind = ranges.schema[target].dataType

    def part(begin: Column, end: Column, goal: Column, status: Column) -> Column:
        return F.struct(
            (begin - a).alias("start"), (end - begin).alias("length"), goal.cast(kind).alias("target"), status.alias("status")
        )

    none, outside = F.lit(None), F.lit("outside")
    ahead = runs.where("_from = 0").select(*by, "_span", part(a, F.least(b, "_least"), none, outside).alias("_part"))
    met = ranks_join(runs.withColumn("_from", F.greatest("_from", F.lit(1))).where("_from <= _upto"), dots, by, "_from", "_upto")
    begin, following = F.greatest(a, F.col("_point._first")), F.least(b, F.col("_point._next"))
    stop = F.least(F.col("_point._stop"), following)
    goal = F.col("_point._t") + (begin - F.col("_point._first"))
    held = part(begin, stop, goal, F.when(F.col("_point._t").isNull(), "not recorded").otherwise("ok"))
    gap = part(F.greatest(begin, F.col("_point._stop")), following, none, outside)
    cut = met.select(*by, "_span", F.explode(F.array(held, gap)).alias("_part"))
    parts = ahead.unionByName(cut).where(F.col("_part.length") > 0)
    return parts.select(*by, *[F.col(f"_span.{k}").alias(k) for k in key], "_part.*")


def locate_offset(
    positions: DataFrame, parts: DataFrame, key: str, pos: str, order: list[str], length: str, part: str,
    group_rows: int | None = None,
) -> DataFrame:
    """Place of a byte position in concatenated parts: ``part`` and ``offset``, or ``at_end`` past the last."""
    placed = (
        ordered(parts.where(F.col(length) > 0), [key], order, group_rows)
        .scan(_stop=running_sum(length))
        .rows()
        .select(key, part, (F.col("_stop") - F.col(length)).alias("_start"), "_stop")
    )
    found = asof(positions, placed, [key], pos, "_start", [part, "_start", "_stop"], match="_m", group_rows=group_rows)
    inside = F.coalesce(F.col(pos) < F.col("_m._stop"), F.lit(False))
    return found.select(
        *positions.columns,
        F.when(inside, F.col(f"_m.{part}")).alias("part"),
        F.when(inside, F.col(pos) - F.col("_m._start")).otherwise(0).alias("offset"),
        (~inside).alias("at_end"),
    )


def asof_backward(
    left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, payload: list[str],
    right_order: list[str] | None = None, group_rows: int | None = None,
) -> DataFrame:
    """Adds the columns of the last right row, in stream order, with ``right_on <= left_on``; else nulls."""
    out = asof(left, right, by, left_on, right_on, payload, right_order, "_m", group_rows)
    return out.select(*left.columns, *[F.col(f"_m.{c}").alias(c) for c in payload])


def entry_ranges(
    items: DataFrame, entries: DataFrame, by: list[str], item: str, in_time: str, out_time: str, t: str,
    order: list[str], payload: list[str], slack: int = 255, group_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(ranges, ranked)``: per item the ``rule`` and the ranks ``first .. last`` of its entries.

    Rules: ``within``, entries with ``in - slack <= t < out``; without any ``start``, the last one in stream
    ``order`` at or before ``in``; without that ``all`` entries of the key. ``ranked`` holds the entries with
    their ``_rank`` by time. One row per item, however many entries a range covers: sample or cap ranges before
    joining them to the entries. Items of keys without entries are dropped; ``item`` is unique per ``by``.
    """
    low = F.greatest(F.col(in_time) - slack, F.lit(0))
    # The latest entry in stream order is wanted at IN: that bound comes first.
    bounds = {"_in": (F.col(in_time), True), "_lo": (low, False), "_hi": (F.col(out_time), False)}
    last = F.when(F.col("_side") == 1, F.struct(F.col("_at").alias("at"), F.col("_rank").alias("rank")))
    runs, ranked = rank_bounds(
        items, entries, by, [item], bounds, t, order, payload, group_rows,
        _start=running_max(last), _total=group_sum((F.col("_side") == 1).cast("long")),
    )
    within, begins = F.col("_hi") > F.col("_lo"), F.col("_start").isNotNull()
    ranges = runs.where("_total > 0").select(
        *by,
        "_span.*",
        F.when(within, "within").when(begins, "start").otherwise("all").alias("rule"),
        F.when(within, F.col("_lo") + 1).when(begins, F.col("_start.rank")).otherwise(1).alias("first"),
        F.when(within, F.col("_hi")).when(begins, F.col("_start.rank")).otherwise(F.col("_total")).alias("last"),
    )
    return ranges, ranked


def interval_join_fallback(
    items: DataFrame, entries: DataFrame, by: list[str], item: str, in_time: str, out_time: str, t: str,
    order: list[str], payload: list[str], slack: int = 255, group_rows: int | None = None,
) -> DataFrame:
    """The entries of each item by the rules of ``entry_ranges``: ``by, item, payload, rule``."""
    ranges, ranked = entry_ranges(items, entries, by, item, in_time, out_time, t, order, payload, slack, group_rows)
    pairs = ranks_join(ranges, ranked, by, "first", "last")
    return pairs.select(*by, item, "_point.*", "rule")


def resolve_start(
    starts: DataFrame, items: DataFrame, marks: DataFrame, playlist: str, kind: str, n: str, item: str,
    in_time: str, out_time: str, mark: str, time: str,
) -> DataFrame:
    """The item a start leads to: ``kind`` first, item (number ``n``) or mark (number ``n``).

    A missing mark and an item number out of range lead to item 0; the mark's time replaces IN only when it
    lies in ``[in, out)`` of the item reached. Starts of playlists without items are dropped.
    """
    m = marks.select(
        F.col(playlist), F.col(mark).alias(n), F.col(item).alias("_mi"), F.col(time).alias("_mt"),
        F.lit("mark").alias(kind),
    )
    asked = starts.join(m, [playlist, kind, n], "left")
    wanted = F.when(F.col(kind) == "item", F.col(n)).when(F.col(kind) == "mark", F.col("_mi"))
    asked = asked.withColumn("_want", F.coalesce(wanted, F.lit(0)))
    i = items.select(playlist, F.col(item).alias("_want"), F.col(in_time).alias("_in"), F.col(out_time).alias("_out"))
    zero = items.where(F.col(item) == 0).select(
        playlist, F.col(in_time).alias("_in0"), F.col(out_time).alias("_out0")
    )
    found = asked.join(i, [playlist, "_want"], "left").join(zero, playlist)
    hit = F.col("_in").isNotNull()
    begin = F.coalesce("_in", "_in0")
    mid = hit & (F.col("_mt") >= F.col("_in")) & (F.col("_mt") < F.col("_out")) & (F.col(kind) == "mark")
    return found.select(
        *starts.columns,
        F.when(hit, F.col("_want")).otherwise(0).alias(item),
        F.when(mid, F.col("_mt")).otherwise(begin).alias(in_time),
        F.coalesce("_out", "_out0").alias(out_time),
    )


def coalesce_backup(primary: DataFrame, backup: DataFrame, key: list[str], valid) -> DataFrame:
    """The whole record from ``primary`` if valid, else from ``backup`` if valid, else none.

    ``valid`` makes the condition from a function that gives a record's column by name.
    """
    fields = [c for c in primary.columns if c not in key]
    a = primary.select(*key, F.struct(*fields).alias("_a"))
    b = backup.select(*key, F.struct(*fields).alias("_b"))
    both = a.join(b, key, "full")

    def usable(side: str) -> Column:
        return F.coalesce(F.col(side).isNotNull() & valid(lambda c: F.col(f"{side}.{c}")), F.lit(False))

    pick = F.when(usable("_a"), F.struct(F.lit("primary").alias("origin"), "_a.*"))
    pick = pick.when(usable("_b"), F.struct(F.lit("backup").alias("origin"), "_b.*"))
    return both.select(*key, pick.alias("_r")).where(F.col("_r").isNotNull()).select(*key, "_r.*")


def semi_supported(df: DataFrame, supported: DataFrame, key) -> DataFrame:
    """Rows whose kind is supported; the kinds are made distinct first, so each is asked once."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(supported.select(*keys).distinct(), keys, "left_semi")


def anti_seen(df: DataFrame, seen: DataFrame, keys) -> DataFrame:
    """Rows whose position was not tried before."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.join(seen.select(*keys), keys, "left_anti")


def dict_join_default(df: DataFrame, dictionary: DataFrame, key: str, value: str, default) -> DataFrame:
    """Dictionary value of ``key``; undefined entries take the default."""
    table = dictionary.select(key, F.col(value).alias("_v"))
    return df.join(table, key, "left").withColumn(value, F.coalesce("_v", F.lit(default))).drop("_v")


def first_resolvable_ref(df: DataFrame, row_id: list[str], refs: str, targets: DataFrame, target: str) -> DataFrame:
    """First id of the ordered list ``refs`` that is among ``targets`` (exists and is complete)."""
    each = df.select(*row_id, F.posexplode(refs).alias("_pos", target))
    known = each.join(targets.select(target).distinct(), target, "left_semi")
    first = known.groupBy(*row_id).agg(F.min(F.struct("_pos", target)).alias("_f"))
    return df.join(first.select(*row_id, F.col(f"_f.{target}").alias("ref")), row_id)


def code_bound(
    df: DataFrame, bounds: DataFrame, code: str, profile: str, bound: str, default: Column, cap: Column, extra=0
) -> DataFrame:
    """Bound by (code, profile) plus ``extra``; codes without one take ``default``; the result is capped."""
    table = bounds.select(code, profile, F.col(bound).alias("_b"))
    out = df.join(table, [code, profile], "left")
    return out.withColumn(bound, F.least(F.coalesce(F.col("_b") + extra, default), cap)).drop("_b")


def compare_tables(
    a: DataFrame, b: DataFrame, key: list[str], value: str, group: list[str], peak: float = 255.0,
    max_diff: int = 4, min_psnr: float = 48.0,
) -> DataFrame:
    """Largest difference, mean squared error, PSNR (null when equal: infinite) and verdict per group.

    Values are integers. Keys found on one side only are counted as ``missing`` and fail the group.
    """
    left = a.select(*key, F.col(value).alias("_a"), F.lit(1).alias("_ha"))
    right = b.select(*key, F.col(value).alias("_b"), F.lit(1).alias("_hb"))
    d = F.abs(F.col("_a").cast("decimal(19,0)") - F.col("_b").cast("decimal(19,0)")).cast("decimal(19,0)")
    both = left.join(right, key, "full").withColumn("_d", d)
    stats = both.groupBy(*group).agg(
        F.count("_d").alias("n"),
        F.max("_d").cast("long").alias("max_diff"),
        F.sum((F.col("_d") * F.col("_d")).cast("decimal(38,0)")).alias("sq"),
        F.count_if(F.col("_ha").isNull() | F.col("_hb").isNull()).alias("missing"),
    )
    mse = F.col("sq").cast("double") / F.col("n")
    psnr = F.when(mse > 0, F.lit(10.0) * F.log10(F.lit(peak * peak) / mse))
    stats = stats.withColumns({"mse": mse, "psnr": psnr})
    close = (F.col("max_diff") <= max_diff) & (F.col("psnr").isNull() | (F.col("psnr") >= min_psnr))
    return stats.withColumn("passed", F.coalesce(close, F.lit(False)) & (F.col("missing") == 0)).drop("sq")


def worst_group(stats: DataFrame) -> DataFrame:
    """The overall result of ``compare_tables``: the worst group's figures; passed only if all did."""
    return stats.agg(
        F.max("max_diff").alias("max_diff"), F.min("psnr").alias("psnr"), F.bool_and("passed").alias("passed")
    )
