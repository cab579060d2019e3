"""Near-duplicate documents: b-bit MinHash signatures and a multi-index Hamming join.

A signature has 32 slots of 16 bits. Two signatures with at most 15 differing slots have, by the pigeonhole principle,
one of the 8 chunks of 4 slots with at most one difference, so they share one of the 32 keys "chunk without one slot".
Two sets of similarity 0.8 differ in more than 15 slots with a probability of about 1 in 10 000.

Documents with the same set are one node from the start, so copies cost nothing. Pairs within a key's bucket are never
written out: every member is compared with the bucket's hub, the one that shares most keys with others. Members that
the hub's component does not take in are compared, in blocks, with all that share that hub, after an exact bound has
removed those that cannot be similar to anything: a set of which more than a fifth occurs in no other set there. Every
link is confirmed on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candex.llm.components import components
from candex.llm.frames import one_row_each
from candex.llm.words import mix, odd_constants, text_chunks, word_hashes
from candex.plans.limits import pin

SLOTS, PER_CHUNK = 32, 4
CHUNKS = SLOTS // PER_CHUNK
DISTANCE = 2 * CHUNKS - 1
_STEP = 1 << 13
BLOCK = 512


def shingle_set(words: np.ndarray, k: int, weights: np.ndarray) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``k`` words; fewer words are one run, none give an empty set."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    total = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        total += words[i : n - k + 1 + i] * weights[i]
    return np.unique(mix(total))


def signature(shingles: np.ndarray, xors: np.ndarray, factors: np.ndarray) -> np.ndarray:
    least = np.full(SLOTS, np.uint64(2**64 - 1))
    for at in range(0, len(shingles), _STEP):
        part = (shingles[at : at + _STEP, None] ^ xors) * factors
        np.minimum(least, part.min(axis=0), out=least)
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16).view(np.int64)


def _sets(texts: list, k: int) -> Iterator[np.ndarray]:
    weights = odd_constants(k, 7)
    for _, run in text_chunks(texts):
        hashes, counts = word_hashes(run)
        for part in np.split(hashes, np.cumsum(counts)[:-1]):
            yield shingle_set(part, k, weights)


def _signatures(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    xors, factors = odd_constants(SLOTS, 8), odd_constants(SLOTS, 9)
    for batch in batches:
        sizes, digests, signs = [], [], []
        for shingles in _sets(batch.column(2).to_pylist(), k):
            sizes.append(len(shingles))
            digests.append(blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
            signs.append(signature(shingles, xors, factors))
        flat = pa.array(np.concatenate(signs)) if signs else pa.array([], pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(signs) + 1) * CHUNKS, pa.int32()), flat)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists], ["doc_id", "mark", "n_shingles", "digest", "sig"])


def _whole_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = list(_sets(part.column(1).to_pylist(), k))
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.record_batch([part.column(0), lists], ["doc_id", "shingles"])


def _keys(sig: str) -> Column:
    """The 32 keys of a signature: each chunk with each slot replaced by the number of chunk and slot."""
    keys = []
    for chunk in range(CHUNKS):
        for slot in range(PER_CHUNK):
            hole = 0xFFFF << 16 * slot
            signed = lambda x: x - (1 << 64) if x >> 63 else x
            tag = (chunk * PER_CHUNK + slot + 1) << 16 * slot
            keys.append(F.col(sig)[chunk].bitwiseAND(F.lit(signed(2**64 - 1 - hole))).bitwiseOR(F.lit(signed(tag))))
    return F.array(*keys)


def _across(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between the strays and the members of each pair of blocks, one for each component a stray is linked with."""
    found = []
    for _, block in rows.groupby(["hub", "i", "j"], sort=False):
        strays, members = block[block["stray"]], block[~block["stray"]]
        if not len(strays) or not len(members):
            continue
        sets = members["shingles"].to_list()
        flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
        starts = np.cumsum(sizes) - sizes
        ids, comps = members["rep"].to_numpy(), members["comp"].to_numpy()
        for rep, comp, own in zip(strays["rep"], strays["comp"], strays["shingles"], strict=True):
            own = np.sort(own)  # the hashes ascend as unsigned numbers
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            both = np.add.reduceat(hit.astype(np.int64), starts)
            linked = (100 * both >= percent * (sizes + len(own) - both)) & (comps != comp)
            _, first = np.unique(comps[linked], return_index=True)
            found += [(rep, other) for other in ids[linked][first]]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose whole sets are similar."""
    left, right = (sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("sum"))
    return rows.where(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("a", "b")


def _component_of(rows: DataFrame, named: DataFrame, node: str, name: str) -> DataFrame:
    found = named.select(F.col("node").alias(node), F.col("component").alias(name))
    return rows.join(found, node, "left").withColumn(name, F.coalesce(name, node))


def _joined(named: DataFrame, more: DataFrame) -> DataFrame:
    """The components after further links between their members."""
    ends = _component_of(_component_of(more, named, "a", "ca"), named, "b", "cb").select("ca", "cb")
    top = pin(components(ends, "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("top")))
    new = more.select(F.col("a").alias("node")).union(more.select("b")).distinct().join(named, "node", "left_anti")
    known = named.union(new.withColumn("component", F.col("node")))
    return pin(known.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component")))


def _missed_links(spokes: DataFrame, sets: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """Links between members of a hub's buckets that the hub's component does not join.

    Strays, which are outside that component, are compared on whole sets with everything in the buckets of the same hub
    that could be similar to anything, in blocks.
    """
    family = spokes.select("hub", "rep").distinct()
    family = pin(_component_of(_component_of(family, named, "rep", "comp"), named, "hub", "hub_comp"))
    open_hubs = family.where("comp <> hub_comp").select("hub").distinct()
    family = pin(family.join(open_hubs, "hub", "left_semi").withColumn("stray", F.col("comp") != F.col("hub_comp")))
    open_sets = sets.join(family.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    own = (
        open_sets.select("doc_id", F.explode("shingles").alias("s")).groupBy("s")
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
        .groupBy("doc_id").agg(F.count(F.lit(1)).alias("own"))
    )
    lost = sets.join(own, "doc_id").where(100 * F.col("own") > (100 - percent) * F.size("shingles")).select(F.col("doc_id").alias("rep"))
    family = pin(family.join(lost, "rep", "left_anti").select("hub", "rep", "comp", "stray"))
    sizes = pin(family.groupBy("hub").agg(F.count_if("stray").alias("strays"), F.count(F.lit(1)).alias("members")).where("strays > 0"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    held = family.join(sizes, "hub").withColumns({"si": blocks("strays"), "mj": blocks("members")})
    mine = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = held.where("stray").select("hub", "rep", "comp", "stray", mine("si").alias("i"), every("mj").alias("j"))
    right = held.select("hub", "rep", "comp", F.lit(False).alias("stray"), every("si").alias("i"), mine("mj").alias("j"))
    rows = pin(left.unionByName(right))
    tasks = max(1, math.ceil(rows.count() / BLOCK))
    task = F.pmod(F.xxhash64("hub", "i", "j"), F.lit(tasks)).alias("task")
    filled = rows.join(sets.withColumnRenamed("doc_id", "rep"), "rep").withColumn("task", task)
    return filled.groupBy("task").applyInPandas(lambda f: _across(f, percent), "a long, b long")


def _mark(text: str) -> Column:
    """MD5 of a text, which tells apart rows that share an id; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Links documents whose sets of word runs have a Jaccard similarity of at least ``percent`` %.

    One row per row of ``docs``: ``doc_id, n_shingles, component_id`` (the smallest id reachable), ``kept``
    (``doc_id = component_id``). Documents with fewer than ``words`` words have the whole sequence as one run; those
    without words (null, empty, blank) are linked with nothing. Rows are linked by their texts, so rows that share an id but
    not a text, and rows with a null id, have links of their own; a null id names a component only if it has no other.
    Other columns are ignored. An empty table gives no rows. Written tables are small: signatures, the crowded keys, and
    the sets of documents in them.
    """
    return _judged(docs, doc_id, text, words, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """The rows of ``near_duplicates`` with the ``mark`` of their text and the number ``top`` of their component, which is
    null for texts without words."""
    marked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _mark(text).alias("mark"), F.col(text).alias("text"))
    schema = "doc_id long, mark binary, n_shingles long, digest binary, sig array<long>"
    signed = pin(marked.mapInArrow(partial(_signatures, k=words), schema))
    # Documents with one set are a class; its number is written, so it does not change.
    source = F.min(F.struct("mark", "doc_id"))
    classes = signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.min("sig").alias("sig"), source.alias("source"))
    classes = pin(pin(classes).withColumn("rep", F.monotonically_increasing_id()))

    keys = classes.select("rep", F.explode(_keys("sig")).alias("key"))
    sizes = pin(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    crowded = pin(keys.join(sizes, "key"))
    popular = crowded.groupBy("rep").agg(F.sum("n").alias("pop"))
    hubs = pin(
        crowded.join(popular, "rep").groupBy("key").agg(F.max_by("rep", F.struct("pop", -F.col("rep"))).alias("hub"))
    )
    spokes = pin(crowded.select("key", "rep").join(hubs, "key"))
    pairs = pin(spokes.where("rep <> hub").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct())
    nodes = classes.join(crowded.select("rep").distinct(), "rep", "left_semi")
    nodes = nodes.select("rep", F.col("source.mark").alias("their_mark"), F.col("source.doc_id").alias("their_id"))
    # Rows that repeat an id and a text come several times here, with one and the same set.
    texts = marked.join(nodes, (F.col("mark") == F.col("their_mark")) & F.col("doc_id").eqNullSafe(F.col("their_id"))).select("rep", "text")
    sets = pin(texts.mapInArrow(partial(_whole_sets, k=words), "doc_id long, shingles array<long>").dropDuplicates(["doc_id"]))
    links = pin(_confirmed(pairs, sets, percent))
    named = components(links)

    more = pin(_missed_links(spokes, sets, named, percent))
    if not more.isEmpty():
        named = _joined(named, more)
    final = named.select(F.col("node").alias("rep"), F.col("component").alias("top"))
    topped = pin(classes.join(final, "rep", "left").select("digest", "first", F.coalesce("top", "rep").alias("top")))
    names = topped.groupBy("top").agg(F.min("first").alias("component_id"))
    placed = signed.drop("sig").join(topped.select("digest", "top").join(names, "top"), "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return placed.select(
        "doc_id", "mark", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "top"
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their component, one for each, with all their columns.

    That is the row of the smallest id (null last), then of the smallest text hash; of rows that share both, one stays by a
    hash of all columns. Texts without words are no copies of each other and all stay, but for rows that share id and text.
    """
    found = _judged(docs, doc_id, text, words, percent)
    alike = found.groupBy("top", "mark", "doc_id").agg(F.count(F.lit(1)).alias("repeats"))
    best = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("mark"), F.col("repeats")))
    first = alike.where("top IS NOT NULL").groupBy("top").agg(best.alias("b")).select("b.doc_id", "b.mark", "b.repeats")
    kept = pin(first.unionByName(alike.where("top IS NULL").select("doc_id", "mark", "repeats")))
    return one_row_each(docs, kept, [(F.col(doc_id).cast("long"), "doc_id"), (_mark(text), "mark")], "repeats")
