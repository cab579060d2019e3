"""Best-fit packing of documents into training sequences, with conflicts.

Documents are dealt by hash into shards of a bounded number of words; each shard is packed on its own. A bin carries
a bitmap of the duplicate clusters it holds and, for each number up to ``per_source``, one of the sources that
it holds so many documents of. Open bins are kept ordered by what is left in them, a list for each kind of document that
comes often: the search starts at the first in which the document fits and goes on to the next until a compatible one is
found, which is the tightest.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candex.plans.limits import pin

#: More than the bins of any shard.
_BINS = 1 << 28


class OpenBins:
    """Bins with room, ordered by what is left, apart for each kind of document that is frequent.

    A kind is a source and a cluster, of which only those that come often count. A bin stands in the list of a kind while it is
    closed to neither of the two. So a search for a kind never meets bins that its frequent source or cluster has closed,
    and those that a rare one has closed are few: at most as many as it has documents.
    """

    def __init__(self, kinds: list[tuple[int, int]]):
        self.kinds = kinds
        self.lists: list[list[tuple[int, int]]] = [[] for _ in kinds]
        self.looked = 0

    def tightest(self, kind: int, size: int, fits) -> tuple[int, int] | None:
        """The bin with the least room of at least ``size`` for which ``fits`` holds."""
        bins = self.lists[kind]
        for place in range(bisect_left(bins, (size, -1)), len(bins)):
            self.looked += 1
            if fits(bins[place][1]):
                return bins[place]
        return None

    def moved(self, b: int, before: int, after: int, closed_before: tuple[int, int], closed: tuple[int, int]) -> None:
        """Puts a bin where it belongs after its room or what it is closed to has changed."""
        for bins, (source, cluster) in zip(self.lists, self.kinds, strict=True):
            if before and not (closed_before[0] & source or closed_before[1] & cluster):
                del bins[bisect_left(bins, (before, b))]
            if after and not (closed[0] & source or closed[1] & cluster):
                insort(bins, (after, b))


def _frequent(values: list, least: float) -> set:
    return {v for v, n in Counter(values).items() if n > least and v is not None}


def best_fit(
    sizes: list[int], sources: list, clusters: list, capacity: int, per_source: int, open_bins: list | None = None
) -> tuple[list[int], list[int]]:
    """Bin and offset of each document, taken in the given order. Null sources and clusters conflict with nothing.

    ``open_bins`` takes the ``OpenBins`` of the run, for those who want to know how many bins it looked at.
    """
    bit: dict = {}
    source_bits = [0 if s is None else 1 << bit.setdefault(s, len(bit)) for s in sources]
    often = {c for c, n in Counter(clusters).items() if n > 1 and c is not None}
    at = {c: 1 << i for i, c in enumerate(sorted(often))}
    cluster_bits = [at.get(c, 0) for c in clusters]
    # Rare is what comes at most as often as the root of all documents.
    root = len(sizes) ** 0.5
    hot = _frequent(source_bits, root), _frequent(cluster_bits, root)
    kind_of = [(s if s in hot[0] else 0, c if c in hot[1] else 0) for s, c in zip(source_bits, cluster_bits, strict=True)]
    kinds = sorted(set(kind_of))
    number = {kind: i for i, kind in enumerate(kinds)}
    left = OpenBins(kinds)
    if open_bins is not None:
        open_bins.append(left)
    held, levels, bins, offsets = [], [], [], []
    for size, source, cluster, kind in zip(sizes, source_bits, cluster_bits, kind_of, strict=True):
        found = left.tightest(number[kind], size, lambda b, s=source, c=cluster: not held[b] & c and not levels[b][-1] & s)
        if found is None:
            room, b, before = capacity, len(held), 0
            held.append(0)
            levels.append([0] * per_source)
        else:
            room, b = found
            before = room
        closed_before = levels[b][-1], held[b]
        held[b] |= cluster
        for i, level in enumerate(levels[b]):
            if not level & source:
                levels[b][i] = level | source
                break
        bins.append(b)
        offsets.append(capacity - room)
        left.moved(b, before, room - size, closed_before, (levels[b][-1], held[b]))
    return bins, offsets


def _pack_shard(rows: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    rows = rows.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
    full = rows["size"] // capacity
    rest = rows.assign(piece=full, n_words=rows["size"] % capacity).query("n_words > 0")
    rest = rest.sort_values("n_words", ascending=False, kind="stable")
    plain = lambda name: [None if x is None or x is pd.NA or x != x else x for x in rest[name].tolist()]
    bins, offsets = best_fit(rest["n_words"].tolist(), plain("source"), plain("cluster"), capacity, per_source)
    rest = rest.assign(bin_id=bins, offset=offsets)
    # A piece that fills its bin is the only one there.
    filled = rows.loc[rows.index.repeat(full)]
    filled = filled.assign(piece=filled.groupby(level=0).cumcount(), n_words=capacity, offset=0)
    filled["bin_id"] = range(max(bins, default=-1) + 1, max(bins, default=-1) + 1 + len(filled))
    out = pd.concat([rest, filled])
    out["bin_id"] += out["shard"] * _BINS
    return out[["doc_id", "piece", "bin_id", "offset", "n_words"]]


def pack(
    docs: DataFrame, doc_id: str = "doc_id", size: str = "size", source: str = "source", cluster: str = "cluster",
    capacity: int = 2048, per_source: int = 2, shard_words: int = 500_000,
) -> DataFrame:
    """Places every document in a bin of ``capacity`` words: ``doc_id, piece, bin_id, offset, n_words``.

    A bin never holds two documents of one cluster nor more than ``per_source`` of one source; null sources and null
    clusters conflict with nothing. A document above the capacity is cut into pieces: those that fill a bin have
    it to themselves, the rest is packed like a document. Documents without words take no room: one row with piece
    0, no words, and null for bin and offset. Rows that repeat an id are documents of their own. An empty table gives
    no rows, other columns are ignored. The number of shards follows the words, so a shard has the same size at any scale.
    """
    spark = docs.sparkSession
    rows = pin(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"),
            F.col(source).cast("string").alias("source"), F.col(cluster).alias("cluster"),
        )
    )
    words = rows.agg(F.sum("size")).first()[0] or 0
    shards = max(1, math.ceil(words / shard_words))
    shard = F.pmod(F.xxhash64("doc_id", "cluster", "size"), F.lit(shards))
    packed = rows.where("size > 0").withColumn("shard", shard).groupBy("shard").applyInPandas(
        lambda f: _pack_shard(f, capacity, per_source), "doc_id long, piece long, bin_id long, offset long, n_words long"
    )
    none = F.lit(None).cast("long")
    blank = rows.where("size = 0").select(
        "doc_id", F.lit(0).cast("long").alias("piece"), none.alias("bin_id"), none.alias("offset"), F.lit(0).cast("long").alias("n_words")
    )
    return packed.unionByName(blank)
