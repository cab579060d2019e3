"""Near-duplicate vectors by NN-descent.

Vectors of one direction are one node with a number of copies. A first neighbour graph comes from cells of random
hyperplanes. In each round the neighbours of every vector, forward and reverse, are compared with each other, and a list
takes over what is nearer than its last entry. Links met anywhere, edges at or above the threshold, are never cut to the
length of a list: each cell and each comparison adds a spanning forest of its links, which joins the same components as
all of them. The list of a vector that is full of links says nothing about links beyond it, so it is enlarged: inside
its component links are counted exactly, block against block, and outside it the descent goes on with lists of what lies
in other components, until no list is full of links. The recall of the links is audited against brute force for a
bounded set of vectors, over pairs and by vector; if it is too low, lists double and rounds go on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candex.llm.components import components
from candex.plans.limits import pin

CELL = 256
_MOST_BITS = 24


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    rows = np.asarray(rows, np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _planes(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, dim)).standard_normal((dim, _MOST_BITS))


def _codes(batches: Iterator[pa.RecordBatch], seeds: list[int]) -> Iterator[pa.RecordBatch]:
    """Cells of every vector, one for each seed, with as many sign bits as its group asks for."""
    for batch in batches:
        vectors, dims, bits = batch.column(1), batch.column(2).to_numpy(), batch.column(3).to_numpy()
        codes = np.zeros((batch.num_rows, len(seeds)), np.int64)
        for dim in np.unique(dims):
            where = np.flatnonzero(dims == dim)
            rows = vectors.take(pa.array(where)).flatten().to_numpy(zero_copy_only=False).reshape(len(where), dim)
            for k, seed in enumerate(seeds):
                signs = (rows @ _planes(int(dim), seed) > 0) & (np.arange(_MOST_BITS) < bits[where, None])
                codes[where, k] = signs @ (1 << np.arange(_MOST_BITS))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(seeds), pa.int32()), pa.array(codes.ravel()))
        yield pa.record_batch([batch.column(0), lists], ["vec_id", "codes"])


def _directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of the unit vector of every row."""
    for batch in batches:
        vectors, digests = batch.column(1), [b""] * batch.num_rows
        dims = np.diff(vectors.offsets.to_numpy())
        for dim in np.unique(dims):
            where = np.flatnonzero(dims == dim)
            rows = vectors.take(pa.array(where)).flatten().to_numpy(zero_copy_only=False).reshape(len(where), dim)
            for i, row in zip(where, unit(rows) + 0.0, strict=True):  # no negative zeros
                digests[i] = blake2b(row.tobytes(), digest_size=16).digest()
        yield pa.record_batch([batch.column(0), pa.array(digests, pa.binary())], ["vec_id", "direction"])


_EDGES = "v long, u long, sim double, link boolean"


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what all links join: child and parent of each, found breadth first."""
    todo = linked.any(axis=1)
    children, parents = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while todo.any():
        front = np.array([todo.argmax()])
        todo[front] = False
        while len(front):
            reach = linked[front] & todo
            hit = np.flatnonzero(reach.any(axis=0))
            children.append(hit)
            parents.append(front[reach[:, hit].argmax(axis=0)] if len(hit) else hit)
            todo[hit] = False
            front = hit
    return np.concatenate(children), np.concatenate(parents)


def _nearest(rows: pd.DataFrame, k: int, threshold: float) -> pd.DataFrame:
    """The ``k`` nearest of other components for each vector of a cell, and a forest of the cell's links."""
    ids, comps = rows["vec_id"].to_numpy(), rows["comp"].to_numpy()
    near = min(k, len(ids) - 1)
    if near < 1:
        return pd.DataFrame({"v": [], "u": [], "sim": [], "link": []})
    x = unit(np.stack(rows["vec"].to_list()))
    sims = x @ x.T
    sims[comps[:, None] == comps] = -2
    best = np.argpartition(-sims, near - 1, axis=1)[:, :near].ravel()
    a, b = np.repeat(np.arange(len(ids)), near), best
    child, parent = _forest(sims >= threshold)
    link = np.repeat([False, True], [len(a), len(child)])
    a, b = np.concatenate([a, child]), np.concatenate([b, parent])
    found = pd.DataFrame({"v": ids[a], "u": ids[b], "sim": sims[a, b], "link": link})
    return found[found["sim"] > -2]


def _nearest_of(k: int, threshold: float):
    return lambda rows: _nearest(rows, k, threshold)


def _local_joins(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Compares the neighbours of each vector; gives what is nearer than the last entry of a neighbour's list, and a
    forest of the links."""
    for batch in batches:
        lists = batch.column(0)
        items, offsets = lists.values, lists.offsets.to_numpy()
        ids, last, comps, vectors = (items.field(i) for i in range(4))
        ids, last, comps = ids.to_numpy(), last.to_numpy(), comps.to_numpy()
        flat, ends = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
        found: list[tuple] = []
        for low, high in zip(offsets[:-1], offsets[1:], strict=True):
            if high - low > 1:
                sims = unit(flat[ends[low] : ends[high]].reshape(high - low, -1))
                sims = sims @ sims.T
                sims[comps[low:high, None] == comps[low:high]] = -2
                a, b = np.nonzero(sims > last[low:high, None])
                child, parent = _forest(sims >= threshold)
                link = np.repeat([False, True], [len(a), len(child)])
                a, b = np.concatenate([a, child]), np.concatenate([b, parent])
                found.append((ids[low + a], ids[low + b], sims[a, b], link))
        empty = [np.zeros(0, np.int64)] * 2 + [np.zeros(0), np.zeros(0, bool)]
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else empty
        yield pa.record_batch([pa.array(c) for c in columns], ["v", "u", "sim", "link"])


def _nearest_k(edges: DataFrame, node: str, k: int) -> DataFrame:
    order = W.partitionBy(node).orderBy(F.desc("sim"), "u" if node == "v" else "v")
    return edges.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def _lists(edges: DataFrame, k: int) -> DataFrame:
    """Each pair once: the ``near`` ones, which are the ``k`` nearest of ``v``, and all links of the forests."""
    edges = edges.groupBy("v", "u").agg(F.max("sim").alias("sim"), F.bool_or("link").alias("link"))
    place = F.row_number().over(W.partitionBy("v").orderBy(F.desc("sim"), "u"))
    return edges.withColumn("near", place <= k).where("near OR link")


def _descend(
    rows: DataFrame, graph: DataFrame | None, inner: DataFrame | None, seeds: list[int], k: int, rounds: int, settled: float, threshold: float
) -> DataFrame:
    """``v, u, sim, link, near``: the nearest of other components (``comp``) for ``vec_id, label, dim, vec, comp``.

    ``graph`` is an earlier result to go on from; ``inner`` has neighbours ``v, u`` inside components, which take part
    in the comparisons but never in the lists.
    """
    groups = pin(rows.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")))
    bits = F.greatest(F.ceil(F.log2(F.col("n") / (CELL / 2))), F.lit(0)).cast("int")
    coded = rows.join(groups, ["label", "dim"]).select("vec_id", "vec", "dim", F.least(bits, F.lit(_MOST_BITS)).alias("bits"))
    codes = coded.mapInArrow(partial(_codes, seeds=seeds), "vec_id long, codes array<long>")
    cells = pin(codes.select("vec_id", F.posexplode("codes").alias("tree", "code")).join(rows.select("vec_id", "label", "dim"), "vec_id"))
    keys = ["label", "dim", "tree", "code"]
    sizes = pin(cells.groupBy(keys).agg(F.count(F.lit(1)).alias("n")))
    # A cell with more vectors is dealt out by hash; the rounds bring its parts together.
    salt = F.pmod(F.xxhash64("vec_id", "tree"), F.ceil(F.col("n") / CELL)).cast("int")
    placed = cells.join(sizes, keys).select(*keys, salt.alias("salt"), "vec_id").join(rows.select("vec_id", "vec", "comp"), "vec_id")
    first = placed.groupBy(*keys, "salt").applyInPandas(_nearest_of(k, threshold), _EDGES)
    graph = pin(_lists(first if graph is None else first.unionByName(graph.drop("near")), k))
    for _ in range(rounds):
        nearest = graph.where("near")
        last = nearest.groupBy("v").agg(F.min("sim").alias("low"), F.count(F.lit(1)).alias("n"))
        last = last.select(F.col("v").alias("u"), F.when(F.col("n") >= k, F.col("low")).otherwise(-2.0).alias("last"))
        reverse = _nearest_k(nearest, "u", k).select(F.col("u").alias("v"), F.col("v").alias("u"))
        near = nearest.select("v", "u").union(reverse)
        near = (near if inner is None else near.union(inner)).distinct()
        joined = near.join(last, "u", "left").join(rows.select(F.col("vec_id").alias("u"), "comp", "vec"), "u")
        item = F.struct("u", F.coalesce("last", F.lit(-2.0)).alias("last"), "comp", "vec")
        items = joined.groupBy("v").agg(F.collect_list(item).alias("items")).select("items")
        better = items.mapInArrow(partial(_local_joins, threshold=threshold), _EDGES)
        after = pin(_lists(better.unionByName(graph.drop("near")), k))
        changed = after.where("near").join(nearest, ["v", "u"], "left_anti").count()
        graph = after
        if changed <= settled * graph.where("near").count():
            break
    return graph


def _full(graph: DataFrame, k: int, threshold: float) -> DataFrame:
    """``vec_id`` of the vectors whose lists are full of links."""
    lists = graph.where("near").groupBy(F.col("v").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("low"))
    return lists.where((F.col("n") >= k) & (F.col("low") >= threshold)).select("vec_id")


def _counts(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between the two sides of each pair of blocks."""
    out = []
    for (_, i, j), block in rows.groupby(["component", "i", "j"], sort=False):
        left = block[block["side"] == 0]
        right = left if i == j else block[block["side"] == 1]
        if not len(left) or not len(right):
            continue
        x, y = (unit(np.stack(s["vec"].to_list())) for s in (left, right))
        linked = x @ y.T >= threshold
        own = linked.diagonal() if i == j else 0  # a vector is no link of its own
        if i != j:
            out.append(pd.DataFrame({"vec_id": right["vec_id"], "n": left["copies"].to_numpy() @ linked}))
        out.append(pd.DataFrame({"vec_id": left["vec_id"], "n": linked @ right["copies"].to_numpy() - own}))
    return pd.concat(out) if out else pd.DataFrame({"vec_id": [], "n": []})


def _count_links(base: DataFrame, named: DataFrame, threshold: float) -> DataFrame:
    """``vec_id, n_links``: links of every vector within its component, copies included, in blocks of about ``CELL`` vectors."""
    sizes = pin(named.groupBy("component").agg(F.count(F.lit(1)).alias("m")))
    rows = named.join(sizes, "component").withColumn("blocks", F.ceil(F.col("m") / CELL).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.select(F.col("node").alias("vec_id"), "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = pin(
        rows.select("vec_id", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    )
    tasks = max(1, math.ceil(rows.count() / (4 * CELL)))
    task = F.pmod(F.xxhash64("component", "i", "j"), F.lit(tasks)).alias("task")
    filled = rows.join(base.select("vec_id", "vec", "copies"), "vec_id").withColumn("task", task)
    parts = filled.groupBy("task").applyInPandas(lambda f: _counts(f, threshold), "vec_id long, n long")
    return parts.groupBy("vec_id").agg(F.sum("n").alias("n_links"))


def _audit(batches: Iterator[pa.RecordBatch], sample: list, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of the sample in a batch, and how many lie within a component: ``v, true, found``. Of those that do not, ``v, u``
    is one for each component."""
    groups: dict = {}
    for row in sample:
        groups.setdefault((row["label"], row["dim"]), []).append(row)
    groups = {g: ([r["vec_id"] for r in rows], [r["component"] for r in rows], unit(np.array([r["vec"] for r in rows]))) for g, rows in groups.items()}
    for batch in batches:
        frame, out = batch.to_pandas(), []
        for key, rows in frame.groupby(["label", "dim"], sort=False):
            if key in groups:
                ids, comps, x = groups[key]
                others, theirs = rows["vec_id"].to_numpy(), rows["component"].to_numpy()
                linked = x @ unit(np.stack(rows["vec"].to_list())).T >= threshold
                linked &= np.array(ids)[:, None] != others
                within = linked & (np.array(comps)[:, None] == theirs)
                for i in np.flatnonzero(linked.any(axis=1)):
                    out.append((ids[i], None, int(linked[i].sum()), int(within[i].sum())))
                    missed = linked[i] & ~within[i]
                    _, first = np.unique(theirs[missed], return_index=True)
                    out += [(ids[i], int(u), 0, 0) for u in others[missed][first]]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.record_batch([pa.array(list(c), pa.int64()) for c in columns], ["v", "u", "true", "found"])


def usable_vectors(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """``vec_id, label, dim, vec``: one row per id, without what can have no cosine or no label."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull())
    rows = rows.where(~odd & F.exists(vector, lambda x: x != 0))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.size(vector).alias("dim"), F.col(vector).alias("vec"))
    first = rows.groupBy("vec_id").agg(F.min(F.struct("label", "dim", "vec")).alias("r"))
    return first.select("vec_id", "r.label", "r.dim", "r.vec")


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98,
    k: int = 8, trees: int = 3, rounds: int = 8, settled: float = 0.002, audited: int = 512, recall: float = 0.95, passes: int = 4,
) -> DataFrame:
    """Links vectors of one label whose cosine is at least ``threshold``.

    One row per row of ``vectors``: ``vec_id, n_links`` (others linked directly)``, component_id`` (smallest id
    reachable)``, kept``. Vectors that are null, zero, or hold null or non-finite components, and rows without label
    or id, link with nothing; so do vectors of different lengths. Rows that repeat an id are one vector, the first by
    label and components. Other columns are ignored, an empty table gives no rows.

    Rounds stop when fewer than the share ``settled`` of the lists' entries change. Lists have ``k`` entries; those full of
    links are followed by lists of what lies in other components until none is full. ``audited`` vectors, those with the
    smallest hash of the id, are compared with all others; while fewer than ``recall`` of their links, or of the links of a
    vector on average, lie within a component, lists double and cells are drawn anew, at most ``passes`` times, then a
    RuntimeError is raised. Links that only the audit finds count in the result.
    """
    base = pin(usable_vectors(vectors, vec_id, vector, label))
    # Above this threshold a vector may be no link of its copy, by rounding.
    alike = base.select("vec_id", "vec").mapInArrow(_directions, "vec_id long, direction binary") if threshold <= 1 - 1e-9 else (
        base.select("vec_id", F.col("vec_id").cast("string").cast("binary").alias("direction"))
    )
    alike = pin(alike.join(base.select("vec_id", "label", "dim"), "vec_id"))
    classes = pin(alike.groupBy("label", "dim", "direction").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")))
    members = alike.join(classes, ["label", "dim", "direction"]).select("vec_id", "node")
    base = pin(base.join(classes.select(F.col("node").alias("vec_id"), "copies"), "vec_id"))
    twins = base.where("copies > 1").select(F.col("vec_id").alias("v"), F.col("vec_id").alias("u"))
    rows = base.select("vec_id", "label", "dim", "vec", F.col("vec_id").alias("comp"))
    sample = base.select("vec_id", F.xxhash64("vec_id").alias("h")).orderBy("h", "vec_id").limit(audited).select("vec_id")
    graph, beyond, missed, drawn = None, twins, twins.limit(0), 0
    for _ in range(passes):
        seeds, drawn = list(range(drawn, drawn + trees)), drawn + trees
        graph = _descend(rows, graph, None, seeds, k, rounds, settled, threshold)
        inner = graph.where("near").select("v", "u")
        links = graph.where(F.col("sim") >= threshold).select("v", "u").union(beyond)
        named, full = components(links, "v", "u"), pin(_full(graph, k, threshold))
        while True:
            open_rows = pin(full.join(named.select(F.col("node").alias("vec_id"), F.col("component").alias("comp")), "vec_id").join(rows.drop("comp"), "vec_id"))
            several = open_rows.groupBy("label", "dim").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b")
            open_rows = pin(open_rows.join(several.select("label", "dim"), ["label", "dim"], "left_semi"))
            if open_rows.isEmpty():
                break
            seeds, drawn = list(range(drawn, drawn + trees)), drawn + trees
            outer = _descend(open_rows, None, inner, seeds, k, rounds, settled, threshold)
            more = outer.where(F.col("sim") >= threshold).select("v", "u")
            if more.isEmpty():
                break
            beyond = pin(beyond.union(more).distinct())
            named, full = components(named.select(F.col("node").alias("v"), F.col("component").alias("u")).union(more), "v", "u"), pin(_full(outer, k, threshold))
        placed = base.join(named, base["vec_id"] == named["node"], "left").select(
            "vec_id", "label", "dim", "vec", F.coalesce("component", "vec_id").alias("component")
        )
        sampled = [r.asDict() for r in placed.join(sample, "vec_id", "left_semi").collect()]  # at most ``audited``
        checked = pin(placed.mapInArrow(partial(_audit, sample=sampled, threshold=threshold), "v long, u long, true long, found long"))
        missed = missed.union(checked.where("u IS NOT NULL").select("v", "u"))
        by_vector = checked.where("u IS NULL").groupBy("v").agg(F.sum("true").alias("true"), F.sum("found").alias("found"))
        true, found, mean = by_vector.agg(F.sum("true"), F.sum("found"), F.avg(F.col("found") / F.col("true"))).first()
        if not true or (found >= recall * true and mean >= recall):
            break
        k *= 2
    else:
        raise RuntimeError(f"audited recall is {found / true:.3f} of pairs, {mean:.3f} by vector after {passes} passes")
    if not missed.isEmpty():
        named = components(named.select(F.col("node").alias("v"), F.col("component").alias("u")).union(missed), "v", "u")
    links = pin(_count_links(base, named, threshold))
    ids = vectors.select(F.col(vec_id).cast("long").alias("vec_id")).join(members, "vec_id", "left")
    out = ids.join(named, "node", "left").join(links.withColumnRenamed("vec_id", "node"), "node", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
