"""Folds: values that depend on the rows before them in a way no running sum can express.

A fold walks one group's array in order, so groups are kept below ``spark.candex.foldRows`` rows first.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candex.functions.numbers import _c, int_div
from candex.plans import limits
from candex.plans.ordered import first_rows, ordered, position, running_count, running_sum, same_keys


def _greedy_fold(df: DataFrame, keys: list[str], order: list[str], cost: str) -> DataFrame:
    """Greedy choice inside arrays; ``_left`` and ``_quota`` are the group's budget and count."""
    keep = [c for c in df.columns if c not in ("_left", "_quota")]
    item = F.struct(*order, F.col(cost).cast("long").alias("_cost"), F.struct(*keep).alias("_row"))
    groups = df.groupBy(*keys).agg(
        F.array_sort(F.collect_list(item)).alias("_items"), F.max("_left").alias("_left"), F.max("_quota").alias("_quota")
    )
    numbered = F.transform("_items", lambda x, i: F.struct(x["_cost"].alias("cost"), i.alias("i")))
    start = F.struct(F.col("_left").alias("left"), F.array().cast("array<int>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = (x["cost"] <= acc["left"]) & F.coalesce(F.size(acc["taken"]) < F.col("_quota"), F.lit(True))
        return F.struct(
            F.when(fits, acc["left"] - x["cost"]).otherwise(acc["left"]).alias("left"),
            F.when(fits, F.concat(acc["taken"], F.array(x["i"]))).otherwise(acc["taken"]).alias("taken"),
        )

    taken = F.aggregate(numbered, start, step)["taken"]
    rows = F.transform(taken, lambda i: F.get(F.col("_items"), i)["_row"])
    return groups.select(F.inline(rows))


def budget_greedy(
    df: DataFrame, keys: list[str], order: list[str], cost: str, budget: int, max_n: int | None = None,
    fold_rows: int | None = None, group_rows: int | None = None,
) -> DataFrame:
    """Takes rows in order while they fit: one that does not is skipped, later smaller ones may still be taken;
    with ``max_n`` at most so many per group.

    Groups up to ``fold_rows`` rows are folded. A larger one goes through rounds: with L left, rows that cost at most
    half of it are taken until either a dearer row fits into what is left or they have used up more than half of L.
    Every row up to there is decided, and less than half of L is left: after at most log2(budget) + 1 rounds nothing is.
    The result is exact.
    """
    quota = F.lit(max_n).cast("long")
    fits = df.where(F.col(cost).between(0, budget)).withColumns({"_left": F.lit(budget).cast("long"), "_quota": quota})
    fold_rows = fold_rows or limits.limit(df.sparkSession, "foldRows")
    by = [F.col(k) for k in keys]
    names = [f"_k{i}" for i in range(len(keys))]
    match = same_keys(by, [F.col(n) for n in names])
    renamed = [k.alias(n) for k, n in zip(by, names, strict=True)]

    def split(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Rows of groups that can be folded, and those of larger ones."""
        large = limits.pin(rows.groupBy(*renamed).count().where(F.col("count") > fold_rows).drop("count"))
        if large.isEmpty():
            return rows, None
        return (rows.join(large, match, "left_anti"), rows.join(large, match, "left_semi")) if keys else (rows.limit(0), rows)

    small, rest = split(fits)
    taken, folded = [], [small]
    while rest is not None:
        value = F.col(cost).cast("long")
        light = 2 * value <= F.col("_left")
        scan = ordered(rest, keys, order, group_rows).scan(
            _spent=running_sum(F.when(light, value), inclusive=False), _seen=running_count(light, inclusive=False)
        )
        last = F.when(light, 2 * (F.col("_spent") + value) > F.col("_left")).otherwise(value <= F.col("_left") - F.col("_spent"))
        scan = scan.with_columns(_last=last).scan(_stops=running_count(F.col("_last"), inclusive=False)).rows()
        chosen = (F.col("_stops") == 0) & (light | F.col("_last")) & F.coalesce(F.col("_seen") < F.col("_quota"), F.lit(True))
        scan = limits.pin(scan.withColumn("_taken", chosen))
        used = scan.groupBy(*renamed).agg(
            F.coalesce(F.sum(F.when(F.col("_taken"), F.col(cost))), F.lit(0)).cast("long").alias("_used"),
            F.count_if("_taken").alias("_count"),
        )
        taken.append(scan.where("_taken").select(*df.columns))
        later = scan.where("_stops > 0").join(limits.pin(used), match)
        later = later.withColumns({"_left": F.col("_left") - F.col("_used"), "_quota": F.col("_quota") - F.col("_count")})
        later = later.where((F.col(cost) <= F.col("_left")) & F.coalesce(F.col("_quota") > 0, F.lit(True)))
        small, rest = split(limits.pin(later.select(*fits.columns)))
        folded.append(small)
    out = _greedy_fold(reduce(DataFrame.unionByName, folded), keys, order, cost).select(*df.columns)
    return reduce(DataFrame.unionByName, [*taken, out])


def over(under: Column, top: Column, channels: list[str], alpha: str) -> Column:
    """``top`` put over ``under`` (structs of 0..255 integers), rounded as integers."""
    ta, ua = top[alpha], under[alpha]
    hides = (ta == 255) | (ua == 0)
    below = int_div(ua * (F.lit(255) - ta), 255)
    a = ta + below
    safe = F.when(a == 0, 1).otherwise(a)
    mixed = [
        F.when(hides, top[c])
        .otherwise(int_div(top[c] * ta + under[c] * below + int_div(a, 2), safe))
        .cast("long")
        .alias(c)
        for c in channels
    ]
    return F.struct(*mixed, F.when(hides, ta).otherwise(a).cast("long").alias(alpha))


def layer_fold(
    df: DataFrame, keys: list[str], order: list[str], channels: list[str], alpha: str, max_layers: int | None = None,
    fold_rows: int | None = None, group_rows: int | None = None,
) -> DataFrame:
    """Ordered alpha compositing per group, from a transparent start; ``layers`` counts all layers of a group.

    With ``max_layers`` only the first layers of a group are drawn and counted. An opaque layer hides all before it, so
    only what follows a group's last one is gathered. Stacks above ``fold_rows`` layers go to tasks that fold many of them side
    by side, and those too tall for a task are cut into chunks that are folded in parallel, as maps of what lies below them;
    the values of both must lie within 0..255.
    """
    drawn = df if max_layers is None else first_rows(df, keys, order, max_layers)
    fold_rows = fold_rows or limits.limit(df.sparkSession, "foldRows")
    value = F.struct(*[F.col(c).cast("long").alias(c) for c in [*channels, alpha]])
    # Read for the sizes, the short stacks and the long ones.
    rows = limits.pin(ordered(drawn, keys, order, group_rows).scan(_at=position()).rows().select(*keys, "_at", value.alias("_v")))
    names = [f"_k{i}" for i in range(len(keys))]
    match = same_keys([F.col(k) for k in keys], [F.col(n) for n in names])
    opaque = F.max(F.when(F.col(f"_v.{alpha}") == 255, F.col("_at")))
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("layers"), F.coalesce(opaque, F.lit(1)).alias("_from"))
    groups = limits.pin(groups.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], "layers", "_from"))
    seen = rows.join(groups, match).where(F.col("_at") >= F.col("_from"))
    seen = seen.select(*keys, "layers", (F.col("_at") - F.col("_from")).alias("_at"), "_v")
    tall = F.col("layers") - F.col("_from") >= fold_rows
    clear = F.struct(*[F.lit(0).cast("long").alias(c) for c in [*channels, alpha]])
    flat = F.aggregate("_stack", clear, lambda acc, x: over(acc, x["_v"], channels, alpha))
    stack = F.array_sort(F.collect_list(F.struct("_at", "_v")))
    large = groups.where(tall)
    if large.isEmpty():
        out = seen.groupBy(*keys).agg(stack.alias("_stack"), F.max("layers").alias("layers"))
        return out.select(*keys, "layers", flat.alias("_f")).select(*keys, "layers", "_f.*")
    small = (seen.join(large.select(*names), match, "left_anti") if keys else seen.where(F.lit(False))).groupBy(*keys).agg(stack.alias("_stack"), F.max("layers").alias("layers"))
    out = small.select(*keys, "layers", flat.alias("_f")).select(*keys, "layers", "_f.*")
    held = F.col("layers") - F.col("_from") + 1
    large = limits.pin(large.select(*names, "layers", held.alias("_held"), F.monotonically_increasing_id().alias("_g")))
    parts = seen.drop("layers").join(large.drop("layers"), match).select("_g", "_held", "_at", "_v.*")
    # A row per stack, from numpy in tasks; written, as readers of the result would run all of it again.
    spark = df.sparkSession
    most = max(fold_rows, min(limits.limit(spark, "groupRows"), _SIDE_ROWS))
    total, tallest = large.agg(F.sum("_held"), F.max("_held")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // _BUCKET)
    folded = limits.pin(_side_by_side(parts.where(F.col("_held") <= most), channels, alpha, buckets))
    if tallest > most:
        cut = parts.where(F.col("_held") > most).withColumns({"_chunk": int_div(F.col("_at"), fold_rows), "_at": F.col("_at") % fold_rows})
        folded = folded.unionByName(limits.pin(_table_fold(limits.pin(cut.drop("_held")), channels, alpha)))
    folded = large.join(folded, "_g").select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "layers", *channels, alpha)
    return out.unionByName(folded) if keys else folded


def _checked(frame: pd.DataFrame, columns: list[str]) -> list[np.ndarray]:
    """The columns of a chunk in order as whole numbers from 0 to 255."""
    frame = frame.sort_values("_at", kind="stable")
    found = []
    for name in columns:
        values = frame[name]
        if values.isna().any() or not values.between(0, 255).all():
            raise ValueError(f"{name} of a long stack is null or not within 0..255")
        found.append(values.to_numpy(np.int64))
    return found


def _composed(maps: np.ndarray) -> np.ndarray:
    """The maps of 0..255, one in each row, one after the other as one map; neighbours are joined in rounds."""
    while len(maps) > 1:
        odd = maps[-1:] if len(maps) % 2 else maps[:0]
        pairs = maps[: len(maps) // 2 * 2]
        maps = np.concatenate([np.take_along_axis(pairs[1::2], pairs[::2].astype(np.intp), axis=1), odd])
    return maps[0]


#: Layers of one stack that a task folds one by one, and about how many layers it gets. A step takes as long for one stack as
#: for hundreds, so taller stacks, of which a task has few, are left to maps.
_SIDE_ROWS, _BUCKET = 8_192, 100_000


def _side_by_side(parts: DataFrame, channels: list[str], alpha: str, buckets: int) -> DataFrame:
    """Folds whole stacks ``_g, _at`` and values, each bucket of them layer by layer: a step takes the next layer of all."""

    def folded(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_g", "_at"], ignore_index=True)
        number = frame.groupby("_g").cumcount().to_numpy()
        depth = frame.groupby("_g")["_at"].transform("size").to_numpy()
        # By layer, the tallest stacks first: those that have a layer are always the first ones.
        by = np.lexsort((frame["_g"], -depth, number))
        tops = _checked(frame.iloc[by].assign(_at=0), [*channels, alpha])
        stops = np.cumsum(np.bincount(number))
        state = [np.zeros(stops[0], np.int64) for _ in tops]
        for low, high in zip([0, *stops[:-1]], stops, strict=True):
            n = high - low
            ta, ua = tops[-1][low:high], state[-1][:n].copy()
            rest = ua * (255 - ta) // 255
            hides, whole = (ta == 255) | (ua == 0), ta + rest
            for held, top in zip(state[:-1], tops[:-1], strict=True):
                v = top[low:high]
                held[:n] = np.where(hides, v, (v * ta + held[:n] * rest + whole // 2) // np.maximum(whole, 1))
            state[-1][:n] = np.where(hides, ta, whole)
        return pd.DataFrame({"_g": frame["_g"].to_numpy()[by][: stops[0]]} | dict(zip([*channels, alpha], state, strict=True)))

    kinds = "_g long, " + ", ".join(f"`{c}` long" for c in [*channels, alpha])
    dealt = parts.drop("_held").withColumn("_bucket", F.pmod(F.xxhash64("_g"), F.lit(buckets)))
    return dealt.groupBy("_bucket").applyInPandas(lambda frame: folded(frame.drop(columns="_bucket")), kinds)


#: Layers whose maps are held at once.
_MAPS = 4096


def _chunk_map(size: int, maps) -> np.ndarray:
    """The map of a whole chunk, from ``maps(low, high)`` for parts of its layers."""
    return _composed(np.stack([_composed(maps(low, min(low + _MAPS, size))) for low in range(0, size, _MAPS)]))


_UNDER = np.arange(256)[None, :]


def _alpha_chunk(frame: pd.DataFrame, alpha: str) -> bytes:
    """What a chunk makes of each alpha below it."""
    (tops,) = _checked(frame, [alpha])

    def maps(low: int, high: int) -> np.ndarray:
        ta = tops[low:high, None]
        return np.where(ta == 255, 255, np.where(_UNDER == 0, ta, ta + _UNDER * (255 - ta) // 255)).astype(np.uint8)

    return _chunk_map(len(tops), maps).tobytes()


def _channel_chunk(frame: pd.DataFrame, channels: list[str], alpha: str, below: int) -> list[bytes]:
    """What a chunk on an alpha of ``below`` makes of each value of each channel below it."""
    *values, tops = _checked(frame, [*channels, alpha])
    under = np.empty(len(tops), np.int64)
    for i, ta in enumerate(tops.tolist()):
        under[i] = below
        below = ta if ta == 255 or below == 0 else ta + below * (255 - ta) // 255
    found = []
    for value in values:

        def maps(low: int, high: int, value=value) -> np.ndarray:
            v, ta, ua = value[low:high, None], tops[low:high, None], under[low:high, None]
            rest = ua * (255 - ta) // 255
            mixed = (v * ta + _UNDER * rest + (ta + rest) // 2) // np.maximum(ta + rest, 1)
            return np.where((ta == 255) | (ua == 0), v, mixed).astype(np.uint8)

        found.append(_chunk_map(len(tops), maps).tobytes())
    return found


def _table_fold(parts: DataFrame, channels: list[str], alpha: str) -> DataFrame:
    """Folds long stacks by composition: a layer maps what lies below, 0 to 255, to 0 to 255, and so do many layers.

    Alpha depends on no channel, so the alpha maps of all chunks come first and tell the alpha that each chunk lies on; with
    it known, a chunk is one map for each channel. Chunks are independent, and a group only walks its chunks' maps.
    """
    def alphas(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_g": [key[0]], "_chunk": [key[1]], "_map": [_alpha_chunk(frame, alpha)]})

    def walked(frame: pd.DataFrame) -> pd.DataFrame:
        frame, below, found = frame.sort_values("_chunk"), 0, []
        for table in frame["_map"]:
            found.append(below)
            below = table[below]
        return pd.DataFrame({"_g": frame["_g"], "_chunk": frame["_chunk"], "_below": found, "_after": below})

    def values(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        maps = _channel_chunk(frame, channels, alpha, int(frame["_below"].iloc[0]))
        return pd.DataFrame([(key[0], key[1], frame["_after"].iloc[0], *maps)], columns=["_g", "_chunk", "_after", *channels])

    def ended(frame: pd.DataFrame) -> pd.DataFrame:
        out = {"_g": frame["_g"].iloc[:1]}
        for c in channels:
            value = 0
            for table in frame.sort_values("_chunk")[c]:
                value = table[value]
            out[c] = [value]
        return pd.DataFrame(out | {alpha: frame["_after"].iloc[:1]})

    maps = parts.groupBy("_g", "_chunk").applyInPandas(alphas, "_g long, _chunk long, _map binary")
    below = limits.pin(maps.groupBy("_g").applyInPandas(walked, "_g long, _chunk long, _below long, _after long"))
    typed = ", ".join(f"`{c}` binary" for c in channels)
    tables = parts.join(below, ["_g", "_chunk"]).groupBy("_g", "_chunk").applyInPandas(values, f"_g long, _chunk long, _after long, {typed}")
    return tables.groupBy("_g").applyInPandas(ended, "_g long, " + ", ".join(f"`{c}` long" for c in [*channels, alpha]))


def blend(under, top, a) -> Column:
    """``top`` over an opaque ``under`` with alpha ``a`` (0..255)."""
    return int_div(_c(top) * _c(a) + _c(under) * (F.lit(255) - _c(a)) + 127, 255)
