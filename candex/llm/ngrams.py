"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, memory-mapped for scoring.

Words are 64-bit hashes; a word's number is its place among the sorted hashes. A bigram is one integer, the number of
the first word above that of the second. Counts are partitioned by value, a bucket a range, with bounds from
the unigram counts, so a frequent word is spread over as many buckets as its share asks for. Every array lies in shards
in the shared folder; a worker reads only the pages it probes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candex.llm.arrays import find_sorted, mapped, writing
from candex.llm.words import text_chunks, word_hashes
from candex.plans.limits import pin, scratch_path

#: Stands for the end of a text, and as first word of a bigram for its start.
END = np.uint64(0x5EED0E9D)
_FLUSH = 1 << 21

# From this count on a bigram has an entry of 64 bits.
_WIDE = 2**32 - 1


def _tokens(texts: list, chunk: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts: place of the first, hashes of all tokens with an end after each text, tokens of each text."""
    for at, run in text_chunks(texts, chunk):
        words, counts = word_hashes(run)
        sizes = counts + 1
        tokens = np.empty(len(words) + len(run), np.uint64)
        ends = np.cumsum(sizes) - 1
        inner = np.ones(len(tokens), bool)
        inner[ends] = False
        tokens[inner] = words
        tokens[ends] = END
        yield at, tokens.view(np.int64), sizes


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def emit():
        found, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.record_batch([pa.array(found), pa.array(n)], ["h", "n"])

    for batch in batches:
        for _, tokens, _ in _tokens(batch.column(0).to_pylist()):
            held.append(tokens)
            if sum(map(len, held)) >= _FLUSH:
                yield emit()
    if held:
        yield emit()


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _write_words(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Writes one range of the vocabulary: hashes, counts, and how many tokens of the range come before each."""
    first, rows, total = None, 0, 0
    shard = _partition()
    at = [f"{path}/{name}-{shard:06d}" for name in ("words", "counts", "below")]
    with writing(at[0]) as words, writing(at[1]) as counts, writing(at[2]) as below:
        for batch in batches:
            if batch.num_rows:
                h, n = (batch.column(i).to_numpy() for i in range(2))
                first = int(h[0]) if first is None else first
                words.write(h.tobytes())
                counts.write(n.astype(np.int64).tobytes())
                below.write((np.cumsum(n) - n + total).astype(np.int64).tobytes())
                rows += len(h)
                total += int(n.sum())
    if rows:
        yield pa.record_batch([pa.array([x], pa.int64()) for x in (shard, first, rows, total)], ["shard", "first", "rows", "total"])


@dataclass
class Vocabulary:
    """Sorted word hashes in shards; ``first`` hash, number of words and of tokens of each."""

    path: str
    shards: list[int]
    firsts: list[int]
    rows: list[int]
    totals: list[int]
    _open: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    @property
    def size(self) -> int:
        return sum(self.rows)

    @property
    def tokens(self) -> int:
        return sum(self.totals)

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum([0, *self.rows])

    def arrays(self, name: str, kind) -> list[np.ndarray]:
        if name not in self._open:
            self._open[name] = [mapped(f"{self.path}/{name}-{s:06d}", kind) for s in self.shards]
        return self._open[name]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of ascending hashes, -1 for unknown words."""
        shard, place = find_sorted(hashes, np.array(self.firsts, np.int64), self.arrays("words", np.int64))
        return np.where(place >= 0, place + self.starts[shard], -1)

    def gather(self, name: str, kind, numbers: np.ndarray) -> np.ndarray:
        """Values of ascending numbers from the arrays that lie beside the words."""
        out = np.zeros(len(numbers), kind)
        bounds = np.searchsorted(numbers, self.starts)
        for i, values in enumerate(self.arrays(name, kind)):
            low, high = bounds[i], bounds[i + 1]
            if low < high:
                out[low:high] = values[numbers[low:high] - self.starts[i]]
        return out


def count_words(docs: DataFrame, text: str, path: str) -> Vocabulary:
    """The vocabulary of all rows, counted and written in ranges of the hash."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = docs.select(text).mapInArrow(_count_tokens, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    ranged = pin(counted).repartitionByRange(partitions, "h").sortWithinPartitions("h")
    found = pin(ranged.mapInArrow(partial(_write_words, path=path), "shard long, first long, rows long, total long"))
    rows = sorted(found.collect())  # a row per shard
    return Vocabulary(path, *([r[i] for r in rows] for i in range(4)))


def _unique_sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys with their summed counts; equal keys must be neighbours."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(n, starts)


def _pairs(tokens: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words' numbers, each token's place among them, and each token's number and its forerunner's."""
    words, index = np.unique(tokens, return_inverse=True)
    numbers = vocabulary.numbers(words)
    ids = numbers[index]
    end = numbers[np.searchsorted(words, END.view(np.int64))]
    before = np.concatenate(([end], ids[:-1]))
    before[np.cumsum(sizes)[:-1]] = end
    return numbers, index, ids, before


def _count_pairs(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts of bigrams, with the bucket: the share of the tokens below them if words were independent."""
    held: list[np.ndarray] = []
    ahead = np.concatenate(([0], np.cumsum(vocabulary.totals)))
    below, starts = vocabulary.arrays("below", np.int64), vocabulary.starts

    def mass(numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers))
        order = np.argsort(numbers, kind="stable")
        bounds = np.searchsorted(numbers[order], starts)
        for i, values in enumerate(below):
            where = order[bounds[i] : bounds[i + 1]]
            out[where] = values[numbers[where] - starts[i]] + ahead[i]
        return out

    def emit():
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        u, v = keys >> 32, keys & 0xFFFFFFFF
        low, next_low = mass(u), mass(np.minimum(u + 1, vocabulary.size - 1))
        wide = np.where(u + 1 < vocabulary.size, next_low, vocabulary.tokens) - low
        share = (low + wide * (mass(v) / vocabulary.tokens)) / vocabulary.tokens
        bucket = np.minimum((share * buckets).astype(np.int64), buckets - 1)
        return pa.record_batch([pa.array(bucket.astype(np.int32)), pa.array(keys), pa.array(n)], ["bucket", "key", "n"])

    for batch in batches:
        for _, tokens, sizes in _tokens(batch.column(0).to_pylist()):
            _, _, ids, before = _pairs(tokens, sizes, vocabulary)
            held.append(before << 32 | ids)
            if sum(map(len, held)) >= _FLUSH:
                yield emit()
    if held:
        yield emit()


_STATS = ["kind", "id", "total", "n1", "n2", "n3"]


def _write_pairs(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Writes the buckets of one partition, sorted by bigram, and sums up their words.

    Rows of kind 0: word as first of bigrams, tokens, bigrams seen once, twice, more often. Kind 1: word as second
    and in how many bigrams. Kind 2: a bucket, its first bigram and rows. Kind 3: how many bigrams come 1 to 4 times.
    """
    tail_keys, tail_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    bucket, first, rows = None, None, 0
    often = np.zeros(5, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def row(kind, *columns):
        columns = [np.atleast_1d(np.asarray(c, np.int64)) for c in columns]
        columns += [np.zeros(len(columns[0]), np.int64)] * (5 - len(columns))
        return pa.record_batch([pa.array(np.full(len(columns[0]), kind, np.int32)), *map(pa.array, columns)], _STATS)

    def sums():
        nonlocal often
        keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        often += np.bincount(np.minimum(n, 5), minlength=6)[:5]
        u = keys >> 32
        starts = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
        yield row(0, u[starts], *(np.add.reduceat(x.astype(np.int64), starts) for x in (n, n == 1, n == 2, n > 2)))
        v, times = np.unique(keys & 0xFFFFFFFF, return_counts=True)
        yield row(1, v, times)

    stack, files = ExitStack(), []

    def put(keys, n):
        nonlocal first, rows
        if len(keys):
            first = int(keys[0]) if first is None else first
            files[0].write(keys.tobytes())
            files[1].write(np.minimum(n, _WIDE).astype(np.uint32).tobytes())
            # Counts that 32 bits do not hold stand beside, with their rows.
            wide = np.flatnonzero(n >= _WIDE)
            files[2].write(np.stack([rows + wide, n[wide]], axis=1).astype(np.int64).tobytes())
            held.append((keys, n))
            rows += len(keys)

    for batch in batches:
        b, keys, n = (batch.column(i).to_numpy() for i in range(3))
        cuts = np.flatnonzero(b[1:] != b[:-1]) + 1
        for part in zip(np.split(b, cuts), np.split(keys, cuts), np.split(n, cuts), strict=True):
            if not len(part[0]):
                continue
            if int(part[0][0]) != bucket:
                if bucket is not None:
                    put(tail_keys, tail_n)
                    stack.close()
                    yield row(2, bucket, first, rows)
                bucket, first, rows = int(part[0][0]), None, 0
                tail_keys, tail_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
                files = [stack.enter_context(writing(f"{path}/{name}-{bucket:06d}")) for name in ("pairs", "times", "wide")]
            # The last bigram may go on in the next batch.
            keys, n = _unique_sums(np.concatenate([tail_keys, part[1]]), np.concatenate([tail_n, part[2]]))
            put(keys[:-1], n[:-1])
            tail_keys, tail_n = keys[-1:], n[-1:]
        if sum(len(k) for k, _ in held) >= _FLUSH // 2:
            yield from sums()
    if bucket is not None:
        put(tail_keys, tail_n)
        stack.close()
        yield row(2, bucket, first, rows)
        yield from sums()
        yield row(3, *often)


def _write_stats(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, discounts: list[float]) -> Iterator[pa.RecordBatch]:
    """Writes beside each range of words: tokens that follow, what the discounts free, bigrams that end in the word."""
    shard, total = None, 0
    stack, files = ExitStack(), []
    d1, d2, d3 = discounts
    for batch in batches:
        s = batch.column(0).to_numpy()
        cuts = np.flatnonzero(s[1:] != s[:-1]) + 1
        columns = [np.split(batch.column(i).to_numpy(), cuts) for i in range(batch.num_columns)]
        for s, _, follow, n1, n2, n3, ends in zip(*columns, strict=True):
            if not len(s):
                continue
            if int(s[0]) != shard:
                stack.close()
                shard = int(s[0])
                files = [stack.enter_context(writing(f"{vocabulary.path}/{n}-{vocabulary.shards[shard]:06d}")) for n in ("follow", "freed", "ends")]
            files[0].write(follow.astype(np.int64).tobytes())
            files[1].write(((d1 * n1 + d2 * n2 + d3 * n3) / np.maximum(follow, 1)).tobytes())
            files[2].write(ends.astype(np.int64).tobytes())
            total += len(s)
    stack.close()
    yield pa.record_batch([pa.array([total], pa.int64())], ["rows"])


def modified_discounts(often: list[int]) -> list[float]:
    """Discounts for counts of 1, 2 and more from the numbers of items counted 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (float(x) for x in often)
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), float(i + 1) - 0.05) for i, d in enumerate(found)]


@dataclass
class KneserNey:
    """The model: the vocabulary, the buckets of bigrams, and the numbers of the two orders."""

    vocabulary: Vocabulary
    buckets: list[int]
    firsts: list[int]
    discounts: list[float]
    lower: list[float]
    pairs: int
    unigram_left: float

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of ascending bigrams."""
        v, at = self.vocabulary, [f"{self.vocabulary.path}/{{}}-{b:06d}" for b in self.buckets]
        if "pairs" not in v._open:
            v._open["pairs"] = [mapped(a.format("pairs"), np.int64) for a in at]
            v._open["times"] = [mapped(a.format("times"), np.uint32) for a in at]
            v._open["wide"] = [mapped(a.format("wide"), np.int64).reshape(-1, 2) for a in at]
        shard, place = find_sorted(keys, np.array(self.firsts, np.int64), v._open["pairs"])
        out = np.zeros(len(keys), np.int64)
        bounds = np.searchsorted(shard, np.arange(len(self.buckets) + 1))
        for i, times in enumerate(v._open["times"]):
            low, high = bounds[i], bounds[i + 1]
            if low < high:
                known = place[low:high] >= 0
                rows = place[low:high][known]
                counts, wide = times[rows].astype(np.int64), v._open["wide"][i]
                large = counts == _WIDE
                counts[large] = wide[np.searchsorted(wide[:, 0], rows[large]), 1]
                out[low:high][known] = counts
        return out


def _discounted(counts: np.ndarray, discounts: list[float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *discounts])[np.minimum(counts, 3)], 0)


def fit_bigrams(docs: DataFrame, text: str = "text", path: str | None = None) -> KneserNey:
    """Counts all rows of ``docs`` and writes the model below ``path`` (by default in the shared folder).

    Nothing is capped: every word and bigram is counted and kept. The number of distinct words must stay below 2^31.
    What comes to the driver are a row per shard and the counts of counts.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "ngrams")
    vocabulary = count_words(docs, text, path)
    if vocabulary.size >= 1 << 31:
        raise ValueError("more than 2^31 distinct words")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = docs.select(text).mapInArrow(partial(_count_pairs, vocabulary=vocabulary, buckets=buckets), "bucket int, key long, n long")
    written = counted.repartition(buckets, "bucket").sortWithinPartitions("bucket", "key").mapInArrow(
        partial(_write_pairs, path=path), "kind int, id long, total long, n1 long, n2 long, n3 long"
    )
    stats = pin(written)
    shards = sorted(stats.where("kind = 2").select("id", "total", "n1").collect())
    often = stats.where("kind = 3").agg(*[F.sum(c) for c in ("total", "n1", "n2", "n3")]).first()
    discounts = modified_discounts([x or 0 for x in often])
    first = lambda c: F.sum(F.when(F.col("kind") == 0, F.col(c)).otherwise(0)).alias(c)
    words = pin(
        stats.where("kind < 2").groupBy("id")
        .agg(*map(first, ("total", "n1", "n2", "n3")), F.sum(F.when(F.col("kind") == 1, F.col("total")).otherwise(0)).alias("ends"))
    )
    # Counts of counts of the lower order: in how many bigrams a word is the second.
    lower = words.agg(*[F.count_if(F.col("ends") == k) for k in (1, 2, 3, 4)], F.count_if(F.col("ends") > 2), F.sum("ends")).first()
    lower_discounts = modified_discounts(lower[:4])
    pairs = lower[5] or 0
    freed = sum(d * n for d, n in zip(lower_discounts, (lower[0], lower[1], lower[4]), strict=True))
    starts = vocabulary.starts[1:-1].tolist()
    shard = F.size(F.filter(F.array(*map(F.lit, starts)), lambda s: s <= F.col("id"))) if starts else F.lit(0)
    ranged = words.select(shard.alias("shard"), "id", "total", "n1", "n2", "n3", "ends").repartition(max(1, len(vocabulary.shards)), "shard")
    done = ranged.sortWithinPartitions("shard", "id").mapInArrow(partial(_write_stats, vocabulary=vocabulary, discounts=discounts), "rows long")
    pin(done)
    return KneserNey(
        vocabulary, [s[0] for s in shards], [s[1] for s in shards], discounts, lower_discounts, pairs, freed / pairs if pairs else 1.0
    )


def _score(batches: Iterator[pa.RecordBatch], model: KneserNey, names: list[str]) -> Iterator[pa.RecordBatch]:
    v = model.vocabulary
    total, size = v.tokens, v.size
    for batch in batches:
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for _, tokens, sizes in _tokens(batch.column(batch.num_columns - 1).to_pylist(), 4 << 20):
            numbers, index, ids, before = _pairs(tokens, sizes, v)
            known = numbers >= 0
            # Words ascend by hash, and so do their numbers.
            values = {}
            for name, kind in (("counts", np.int64), ("ends", np.int64), ("follow", np.int64), ("freed", np.float64)):
                values[name] = np.zeros(len(numbers), kind)
                values[name][known] = v.gather(name, kind, numbers[known])
            base = np.log10((values["counts"] + 0.1) / (total + 0.1 * (size + 1)))[index]
            low = model.unigram_left / (size + 1)
            if model.pairs:
                low = low + _discounted(values["ends"], model.lower) / model.pairs
            low = np.broadcast_to(low, len(numbers))[index]
            first = np.searchsorted(numbers[known], before).clip(0, max(0, known.sum() - 1))
            place = np.flatnonzero(known)[first] if known.any() else np.zeros(len(ids), np.int64)
            seen = (before >= 0) & (values["follow"][place] > 0)
            both = seen & (ids >= 0)
            keys, back = np.unique(before[both] << 32 | ids[both], return_inverse=True)
            pair = np.zeros(len(ids))
            pair[both] = _discounted(model.pair_counts(keys), model.discounts)[back]
            chance = np.where(seen, pair / np.maximum(values["follow"][place], 1) + values["freed"][place] * low, low)
            at = np.cumsum(sizes) - sizes
            for out, x in zip(columns, (np.ones(len(ids), np.int64), known[index].astype(np.int64), base, np.log10(chance)), strict=True):
                out.append(np.add.reduceat(x, at))
        n, n_known, base, score = (np.concatenate(c) if c else np.zeros(0) for c in columns)
        arrays = [pa.array(n.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(np.full(len(n), total, np.int64)), pa.array(base), pa.array(score)]
        yield pa.record_batch([*(batch.column(i) for i in range(batch.num_columns - 1)), *arrays], names)


def score_texts(docs: DataFrame, model: KneserNey, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``n_tokens, n_known, train_tokens, base_score, score`` for every row, whole texts.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end; a null text is empty and has the
    end alone. ``score`` is the log10 probability of the text, ``base_score`` that of an add-0.1 unigram model. An
    unknown word has the share that the lower order leaves to one word more than there are. A model of no rows gives
    every token the probability 1. Perplexity is ``10 ** (-score / n_tokens)``.
    """
    rows = docs.select(*keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    added = "n_tokens long, n_known long, train_tokens long, base_score double, score double"
    names = [*keep, *(x.split()[0] for x in added.split(", "))]
    return rows.mapInArrow(partial(_score, model=model, names=names), f"{schema}, {added}")


def held_out(doc_id: str = "doc_id") -> Column:
    """Every tenth document by crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 10 == 0
