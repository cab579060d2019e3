"""Paths, link following and reachability as joins per level.

Each level is one join with the edge table and is pinned in the shared folder, so plans stay short and lost
executors cost one level. Loops end when a level is empty or at the depth bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candex.functions.names import fold
from candex.plans import limits
from candex.plans.ordered import first_rows, ordered, position, running_sum, same_keys


def resolve_paths(
    entries: DataFrame, by: list[str], entry: str, parent: str, name: str, max_depth: int | None = None, separator: str = "/"
) -> DataFrame:
    """Full path and depth of every entry reachable from the roots (null parent), at any depth.

    Pointers are doubled: every round puts the path of the entry a path leads up to in front of it, so entries of depth
    d are ready after log2(d) rounds. Entries that no root leads to, also those in a cycle, are left out. With
    ``max_depth``, deeper entries are a ValueError.
    """
    path = F.col(name).cast("string")
    table = entries.select(*by, entry, F.col(parent).alias("_up"), path.alias("path"), F.lit(1).alias("depth"))
    table = limits.pin(table)
    ready = table.where(F.col("_up").isNull()).count()
    while True:
        above = table.select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(by)], F.col(entry).alias("_above"),
                             F.col("_up").alias("_next"), F.col("path").alias("_path"), F.col("depth").alias("_depth"))
        match = same_keys([F.col(k) for k in by], [F.col(f"_b{i}") for i in range(len(by))]) & (F.col("_up") == F.col("_above"))
        moved = table.where(F.col("_up").isNotNull()).join(above, match).select(
            *by, entry, F.col("_next").alias("_up"), F.concat("_path", F.lit(separator), "path").alias("path"),
            (F.col("depth") + F.col("_depth")).alias("depth"),
        )
        table = limits.pin(table.where(F.col("_up").isNull()).unionByName(moved))
        now = table.where(F.col("_up").isNull()).count()
        if now == ready:
            break
        ready = now
    out = table.where(F.col("_up").isNull()).drop("_up")
    if max_depth is not None and not out.where(F.col("depth") > max_depth).isEmpty():
        raise ValueError(f"there are entries deeper than {max_depth}")
    return out


def lookup_path(
    entries: DataFrame, by: list[str], entry: str, parent: str, name: str, is_dir: str, order: list[str], path: str
) -> DataFrame:
    """The entry at ``path`` in each tree: every folder is the first one of that name, whatever the case."""
    at = entries.where(F.col(parent).isNull()).select(*by, F.col(entry).alias("_at"))
    parts = path.split("/")
    for i, part in enumerate(parts):
        named = entries.where(fold(name) == fold(F.lit(part)))
        if i + 1 < len(parts):
            named = named.where(F.col(is_dir))
        hits = named.withColumnRenamed(parent, "_at").join(at, [*by, "_at"])
        hits = first_rows(hits, [*by, "_at"], order)
        at = hits.select(*by, F.col(entry).alias("_at"))
    return at.withColumnRenamed("_at", entry)


def follow_links(
    nodes: DataFrame, links: DataFrame, node: str, terminal: str, ordinal: str, target: str, max_depth: int | None = None,
    max_links: int | None = None, given_up: bool = False,
) -> DataFrame:
    """The terminal each node leads to: its own, or the first one found by trying its links in listed order; a path never
    meets a node twice. With ``max_depth`` at most so many links deep, with ``max_links`` only the first links of a node are
    its links. Columns ``node, found, hops``. Nodes that lead nowhere are left out; with ``given_up``, those for which the
    depth ended the search come with nulls.

    Paths are compared by their link numbers, so the smallest one is what a depth-first search meets first. A
    node is reached again from the same start only by a smaller path, and nothing beyond a start's best find
    is followed.
    """
    ends = nodes.select(F.col(node).alias("_at"), F.col(terminal).alias("_end"))
    start = nodes.select(
        F.col(node).alias("_from"),
        F.col(node).alias("_at"),
        F.array().cast("array<int>").alias("_path"),
        F.array(node).alias("_seen"),
        F.col(terminal).alias("_end"),
    )
    found = start.where(F.col("_end").isNotNull()).select("_from", "_path", "_end")
    front = start.where(F.col("_end").isNull()).drop("_end")
    reached = front.select("_from", "_at", "_path")
    edges = links.select(F.col(node).alias("_at"), F.col(ordinal).cast("int").alias("_o"), F.col(target).alias("_to"))
    edges = limits.pin(edges if max_links is None else first_rows(edges, ["_at"], ["_o"], max_links))
    depth, cut = 0, None
    while max_depth is None or depth < max_depth + given_up:
        depth += 1
        step = front.join(edges, "_at").where(~F.array_contains("_seen", F.col("_to")))
        step = step.select(
            "_from",
            F.col("_to").alias("_at"),
            F.concat("_path", F.array("_o")).alias("_path"),
            F.concat("_seen", F.array("_to")).alias("_seen"),
        )
        # One path per (start, node) and level: the smallest; and only if it beats the earlier ones.
        step = step.groupBy("_from", "_at").agg(F.min(F.struct("_path", "_seen")).alias("_p"))
        step = step.select("_from", "_at", "_p._path", "_p._seen").join(ends, "_at")
        before = reached.groupBy("_from", "_at").agg(F.min("_path").alias("_old"))
        best = found.groupBy("_from").agg(F.min("_path").alias("_best"))
        step = step.join(before, ["_from", "_at"], "left").join(best, "_from", "left")
        step = step.where(F.col("_old").isNull() | (F.col("_path") < F.col("_old")))
        step = step.where(F.col("_best").isNull() | (F.col("_path") < F.col("_best")))
        step = limits.pin(step.select("_from", "_at", "_path", "_seen", "_end"))
        if step.isEmpty():
            break
        if max_depth is not None and depth > max_depth:
            cut = step.select(F.col("_from").alias(node)).distinct()
            break
        found = found.unionByName(step.where(F.col("_end").isNotNull()).select("_from", "_path", "_end"))
        front = step.where(F.col("_end").isNull()).drop("_end")
        reached = reached.unionByName(front.select("_from", "_at", "_path"))
    first = found.groupBy("_from").agg(F.min(F.struct("_path", "_end")).alias("_f"))
    out = first.select(
        F.col("_from").alias(node), F.col("_f._end").alias("found"), F.size("_f._path").alias("hops")
    )
    return out if cut is None else out.unionByName(cut.join(out.select(node), node, "left_anti"), allowMissingColumns=True)


def _grown(tables: list[tuple[int, DataFrame]], new: DataFrame, fan: int = 8) -> list[tuple[int, DataFrame]]:
    """``tables`` with one more; ``fan`` of one size become a single written table, so few are read however many come."""
    tables = [*tables, (0, new)]
    while len(tables) >= fan and tables[-fan][0] == tables[-1][0]:
        size = tables[-1][0] + 1
        tables[-fan:] = [(size, limits.pin(reduce(DataFrame.unionByName, [t for _, t in tables[-fan:]])))]
    return tables


def _all_rows(tables: list[tuple[int, DataFrame]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t for _, t in tables])


def reachable_emits(
    roots: DataFrame, edges: DataFrame, emits: DataFrame, node: str, ordinal: str, target: str, value: str,
    max_depth: int | None = None, cap: int | None = None, group_rows: int | None = None,
) -> DataFrame:
    """What the nodes reachable from each root emit, each node once: ``root, value, emit_no`` (from 1), the
    distinct values in walk order; with ``cap`` the first of them. Levels end where nothing new is reached, with
    ``max_depth`` at that depth.

    Links and emits of a node share one ordinal; at one ordinal emits come first, then links by target. A node counts
    where it is first reached: at the smallest depth, then from the parent that is earlier in the order of its level.

    Rows have one size at any depth: a parent, an ordinal and a rank within the level instead of a path. Levels up, each
    node learns how much is emitted below it; a running sum of that over the links and emits of a node, summed up to the
    root by doubled pointers, is the place in the walk.
    """
    here = F.col(node).alias("_at")
    place = F.col(ordinal).cast("long").alias("_o")
    links = limits.pin(edges.select(F.col(node).alias("_up"), place, F.col(target).alias("_at")))
    kind = links.schema["_at"].dataType
    none = F.lit(None)
    level = limits.pin(
        roots.select(F.col(node).alias("root"), F.col(node).cast(kind).alias("_at")).distinct()
        .select("root", "_at", none.cast(kind).alias("_up"), none.cast("long").alias("_o"), F.lit(1).cast("long").alias("_upper"))
    )
    parents = limits.pin(links.select(F.col("_up").cast(kind).alias("_at")).distinct())
    levels, seen = [level], _grown([], level)
    while max_depth is None or len(levels) <= max_depth:
        # Only nodes that lead on need a place among the others of their level.
        onward = levels[-1].join(parents, "_at", "left_semi")
        if len(levels) > 1:
            onward = limits.pin(onward)
            if onward.isEmpty():
                break
        ranked = ordered(onward, ["root"], ["_upper", "_o", "_at"], group_rows).scan(_rank=position()).rows()
        step = ranked.select("root", F.col("_at").alias("_up"), "_rank").join(links, "_up")
        step = step.groupBy("root", "_at").agg(F.min(F.struct("_rank", "_o", "_up")).alias("_p"))
        step = step.select("root", "_at", "_p._up", "_p._o", F.col("_p._rank").alias("_upper"))
        step = limits.pin(step.join(_all_rows(seen).select("root", "_at"), ["root", "_at"], "left_anti"))
        if step.isEmpty():
            break
        levels.append(step)
        seen = _grown(seen, step)

    given = limits.pin(emits.select(here, place, F.col(value).alias("value")))
    own = limits.pin(given.groupBy("_at").agg(F.count(F.lit(1)).alias("_own")))
    below, sized = None, []
    for level in reversed(levels):
        sizes = level.join(own, "_at", "left")
        size = F.coalesce("_own", F.lit(0))
        if below is not None:
            inner = below.groupBy("root", F.col("_up").alias("_at")).agg(F.sum("_size").alias("_inner"))
            sizes = sizes.join(inner, ["root", "_at"], "left")
            size = size + F.coalesce("_inner", F.lit(0))
        below = limits.pin(sizes.select("root", "_at", "_up", "_o", size.alias("_size")).where(F.col("_size") > 0))
        sized = _grown(sized, below)
    nodes = _all_rows(sized)

    items = nodes.where(F.col("_up").isNotNull()).select(
        "root", F.col("_up").alias("_at"), "_o", F.col("_at").alias("_child"), none.cast(given.schema["value"].dataType).alias("value"), "_size"
    )
    items = items.unionByName(nodes.select("root", "_at").join(given, "_at").select(
        "root", "_at", "_o", none.cast(kind).alias("_child"), "value", F.lit(1).cast("long").alias("_size")
    ))
    # Emits have no child, and nulls come first.
    inside = ordered(limits.pin(items), ["root", "_at"], ["_o", "_child", "value"], group_rows)
    inside = limits.pin(inside.scan(_before=running_sum("_size", inclusive=False)).rows("_o", "_size"))
    starts = inside.where(F.col("_child").isNotNull()).select("root", F.col("_child").alias("_at"), F.col("_at").alias("_up"), "_before")
    for _ in range((len(levels) - 1).bit_length()):
        above = starts.select("root", F.col("_at").alias("_up"), F.col("_up").alias("_next"), F.col("_before").alias("_more"))
        starts = limits.pin(starts.join(above, ["root", "_up"], "left").select(
            "root", "_at", F.col("_next").alias("_up"), (F.col("_before") + F.coalesce("_more", F.lit(0))).alias("_before")
        ))
    out = inside.where(F.col("_child").isNull()).select("root", "_at", "value", F.col("_before").alias("_place"))
    out = out.join(starts.select("root", "_at", "_before"), ["root", "_at"], "left")
    # Distinct values at their first place; both this and a cap combine before the shuffle.
    out = out.groupBy("root", "value").agg(F.min(F.col("_place") + F.coalesce("_before", F.lit(0))).alias("_place"))
    if cap is None:
        return ordered(out, ["root"], ["_place"], group_rows).scan(emit_no=position()).rows("_place")
    return first_rows(out, ["root"], ["_place"], cap, "emit_no").drop("_place")
