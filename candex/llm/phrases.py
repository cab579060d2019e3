"""Collocations: frequent phrases of a language whose weakest cut still holds together, counted by weighted automata.

Words that are frequent enough get numbers and are kept in files sorted by hash. Texts become rows of these numbers, with
gaps where a piece ends or a word is rare: no frequent phrase crosses a gap. Phrases are counted length by length, and one
more word is only added where both shorter phrases in it are frequent, which loses none. Every task counts its part, sorts
it, and builds automata of it, one for each range of prefixes; the automata of a range are united, weights summed, and what
is frequent is written as the automaton of the range. What no longer phrase can lie in is cut from the rows of numbers.
Later passes map these files: the next length to see which places go on, and the last pass to look up the parts of every
phrase.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candex.llm.arrays import mapped, writing
from candex.llm.automata import Automaton, build, counted, summed, union
from candex.plans.limits import pin, scratch_path

#: Bytes of text taken apart at once; distinct phrases a task holds before it builds automata of them.
SECTION, HELD = 1 << 22, 1 << 20
_CACHED = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS = np.zeros(256, bool)
_ENDS[[10, 11, 12, 13, *b".,;:!?"]] = True
_OUTSIDE = _ENDS.copy()
_OUTSIDE[[9, 32]] = True


def _sections(langs: list, texts: list) -> Iterator[tuple[str, bytes]]:
    """Texts of one language after the other in sections, each ended by a line break; a long text is cut after pieces."""
    by_lang: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for lang, text in zip(langs, texts, strict=True):
        if not text:
            continue
        lang = "und" if lang is None else lang
        data = text.encode()
        while len(data) > 2 * SECTION:
            ends = np.flatnonzero(_ENDS[np.frombuffer(data, np.uint8, SECTION, SECTION)])
            if not len(ends):
                ends = np.flatnonzero(_ENDS[np.frombuffer(data, np.uint8, -1, SECTION)])[:1]
            if not len(ends):
                break
            cut = SECTION + int(ends[0]) + 1
            yield lang, data[:cut] + b"\n"
            data = data[cut:]
        held = by_lang.setdefault(lang, [])
        held.append(data)
        sizes[lang] = sizes.get(lang, 0) + len(data)
        if sizes[lang] >= SECTION:
            yield lang, b"\n".join(held) + b"\n"
            by_lang[lang], sizes[lang] = [], 0
    for lang, held in by_lang.items():
        if held:
            yield lang, b"\n".join(held) + b"\n"


def _words(section: bytes) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of a section in order, and which of them end their piece."""
    data = _LOWER[np.frombuffer(section, np.uint8)]
    inside = ~_OUTSIDE[data]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, stops = edges[::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(stops - starts)))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    ended = np.cumsum(_ENDS[data])
    last = np.append(ended[starts[1:]] > ended[starts[:-1]], True) if len(starts) else np.zeros(0, bool)
    return words.dictionary_encode(), last


def word_key(lang: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang + b"\0" + word)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts, and for each language a row without a word that has the count of all."""
    def rows(lang: str, words: list, counts: np.ndarray) -> pa.RecordBatch:
        keys = [0 if w is None else word_key(lang.encode(), w) - 2**63 for w in words]
        columns = [pa.array([lang] * len(words)), pa.array([None if w is None else w.decode() for w in words], pa.string()), pa.array(keys, pa.int64()), pa.array(counts)]
        return pa.record_batch(columns, ["lang", "word", "key", "n"])

    for batch in batches:
        for lang, section in _sections(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            coded, _ = _words(section)
            if len(coded):
                counts = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                yield rows(lang, [None, *coded.dictionary.to_pylist()], np.concatenate([[len(coded)], counts]))


_WORD_ARRAYS = {"key": np.uint64, "count": np.int64, "total": np.int64, "before": np.int64, "at": np.int64, "text": np.uint8}


def _write_words(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """One file per array of this task's words: keys, counts, counts of all words of the language, counts before, texts."""
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId()
    parts = [batch for batch in batches if batch.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    keys = (table["key"].to_numpy() ^ -(2**63)).view(np.uint64)
    counts = table["n"].to_numpy()
    texts = [lang.encode() + b"\0" + word.encode() for lang, word in zip(table["lang"].to_pylist(), table["word"].to_pylist(), strict=True)]
    arrays = {
        "key": keys, "count": counts, "total": table["total"].to_numpy(), "before": np.cumsum(counts) - counts,
        "at": np.concatenate(([0], np.cumsum([len(t) for t in texts]))), "text": np.frombuffer(b"".join(texts), np.uint8),
    }
    for name, kind in _WORD_ARRAYS.items():
        with writing(f"{path}/words-{name}-{shard:06d}") as out:
            out.write(arrays[name].astype(kind).tobytes())
    yield pa.record_batch([pa.array([x], pa.int64()) for x in (shard, len(keys), int(keys[0]) - 2**63, int(counts.sum()))], ["shard", "words", "first", "n"])


@dataclass(frozen=True)
class Phrases:
    """Where the files are: shards of words with their first numbers, first keys and the counts before them; the ranges of
    each length written so far with the number of phrases before them."""

    path: str
    shards: tuple[int, ...]
    first_ids: tuple[int, ...]
    first_keys: tuple[int, ...]
    before: tuple[int, ...]
    n: int
    ranges: int
    least: int
    lengths: tuple[tuple[tuple[int, ...], tuple[int, ...]], ...] = ()

    def array(self, name: str, i: int) -> np.ndarray:
        return _mapped_words(f"{self.path}/words-{name}-{self.shards[i]:06d}", _WORD_ARRAYS[name])

    def _of_shards(self, name: str, ids: np.ndarray) -> np.ndarray:
        shard = np.searchsorted(self.first_ids, ids, "right") - 1
        out = np.empty(len(ids), np.int64)
        for i in np.flatnonzero(np.bincount(shard, minlength=1)).tolist():
            own = np.flatnonzero(shard == i)
            out[own] = self.array(name, i)[ids[own] - self.first_ids[i]]
            if name == "before":
                out[own] += self.before[i]
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        return self._of_shards("count", ids)

    def totals(self, ids: np.ndarray) -> np.ndarray:
        return self._of_shards("total", ids)

    def texts(self, ids: np.ndarray) -> list[bytes]:
        """Language, a zero byte and the word, for each number."""
        shard = np.searchsorted(self.first_ids, ids, "right") - 1
        out = []
        for i, x in zip(shard.tolist(), ids.tolist(), strict=True):
            at = self.array("at", i)
            place = x - self.first_ids[i]
            out.append(self.array("text", i)[at[place] : at[place + 1]].tobytes())
        return out

    def find(self, lang: bytes, words: list[bytes]) -> np.ndarray:
        """The numbers of words, -1 for those that are not frequent; the texts are compared."""
        keys = np.array([word_key(lang, w) for w in words], np.uint64)
        out = np.full(len(words), -1, np.int64)
        firsts = np.array(self.first_keys, np.uint64)
        # Equal keys can only be found in shards that follow each other, as the words are sorted by key.
        shard = np.maximum(np.searchsorted(firsts, keys, "left") - 1, 0)
        for i in np.flatnonzero(np.bincount(shard, minlength=1)).tolist():
            own = np.flatnonzero(shard == i)
            for j in range(i, len(self.shards)):
                if not len(own) or j > i and self.first_keys[j] > int(keys[own].max()):
                    break
                held = self.array("key", j)
                at = np.searchsorted(held, keys[own])
                hit = np.flatnonzero((at < len(held)) & (held[np.minimum(at, len(held) - 1)] == keys[own]))
                starts, text = self.array("at", j), self.array("text", j)
                for k in hit.tolist():
                    place, word = int(at[k]), int(own[k])
                    want = lang + b"\0" + words[word]
                    while place < len(held) and held[place] == keys[word]:
                        if text[starts[place] : starts[place + 1]].tobytes() == want:
                            out[word] = self.first_ids[j] + place
                            break
                        place += 1
                own = own[out[own] < 0]
        return out

    def range_of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The range of phrases that begin with these words. A word that takes more than one range by its count has them
        cut by the second word."""
        per_range = self.ranges / self.n
        start, size = self._of_shards("before", first), self.counts(first)
        low, high = np.floor(start * per_range), np.floor((start + size - 1) * per_range)
        within = np.floor(self._of_shards("before", second) / self.n * (high - low + 1))
        return np.minimum(low + within, self.ranges - 1).astype(np.int64)

    def automaton(self, length: int, which: int) -> Automaton:
        return _mapped_automaton(f"{self.path}/phrases-{length}-{which:08d}")

    def places(self, rows: np.ndarray) -> np.ndarray:
        """The place of each phrase among all frequent ones of its length; -1 where it is none."""
        length = rows.shape[1]
        ranges, before = self.lengths[length - 2]
        out = np.full(len(rows), -1, np.int64)
        if not len(rows) or not ranges:
            return out
        which = self.range_of(rows[:, 0], rows[:, 1])
        order = np.argsort(which.astype(np.uint16) if self.ranges < 1 << 16 else which, kind="stable")
        which = which[order]
        for i, r in enumerate(ranges):
            own = order[np.searchsorted(which, r, "left") : np.searchsorted(which, r, "right")]
            if len(own):
                place = self.automaton(length, r).places(rows[own])
                out[own] = np.where(place < 0, -1, place + before[i])
        return out

    def weights(self, length: int, places: np.ndarray) -> np.ndarray:
        ranges, before = self.lengths[length - 2]
        which = np.searchsorted(before, places, "right") - 1
        out = np.empty(len(places), np.int64)
        for i in np.flatnonzero(np.bincount(which, minlength=1)).tolist():
            own = np.flatnonzero(which == i)
            out[own] = self.automaton(length, ranges[i]).weights[places[own] - before[i]]
        return out


@lru_cache(maxsize=4096)
def _mapped_words(path: str, kind) -> np.ndarray:
    return np.asarray(mapped(path, kind))


@lru_cache(maxsize=4096)
def _mapped_automaton(path: str) -> Automaton:
    return Automaton.of(mapped(path, np.uint8))


def number_words(docs: DataFrame, least: int, range_words: int, lang: str, text: str) -> Phrases:
    """Counts all words and writes those that come at least ``least`` times in their language."""
    spark = docs.sparkSession
    path = scratch_path(spark, "phrases")
    texts = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    counted = texts.mapInArrow(_count_words, "lang string, word string, key long, n long").groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))
    counted = pin(counted.where(F.col("word").isNull() | (F.col("n") >= least)))
    totals = counted.where("word IS NULL").select("lang", F.col("n").alias("total"))
    words = counted.where("word IS NOT NULL").join(totals, "lang")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_words = words.repartitionByRange(partitions, "key").sortWithinPartitions("key", "lang", "word")
    found = pin(sorted_words.mapInArrow(partial(_write_words, path=path), "shard long, words long, first long, n long"))
    shards = sorted(found.collect())  # a row per file
    running = lambda values: tuple(int(x) for x in np.cumsum([0, *values])[:-1])
    n = sum(s.n for s in shards)
    return Phrases(
        path, tuple(s.shard for s in shards), running(s.words for s in shards), tuple(s.first + 2**63 for s in shards),
        running(s.n for s in shards), n, max(partitions, math.ceil(n / range_words)), least,
    )


def _number_texts(batches: Iterator[pa.RecordBatch], phrases: Phrases) -> Iterator[pa.RecordBatch]:
    """Rows of word numbers, -1 after the last word of a piece and for words that are not frequent."""
    known: dict[str, dict[bytes, int]] = {}
    for batch in batches:
        for lang, section in _sections(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            coded, last = _words(section)
            ids = known.setdefault(lang, {})
            words = coded.dictionary.to_pylist()
            new = [w for w in words if w not in ids]
            if new:
                if len(ids) > _CACHED:
                    ids.clear()
                    new = words
                ids.update(zip(new, phrases.find(lang.encode(), new).tolist(), strict=True))
            numbers = np.array([ids[w] for w in words], np.int64)[coded.indices.to_numpy()] if words else np.zeros(0, np.int64)
            with_gaps = np.full(len(numbers) + int(last.sum()), -1, np.int64)
            with_gaps[np.arange(len(numbers)) + np.cumsum(last) - last] = numbers
            # One gap is as good as many.
            keep = (with_gaps >= 0) | np.append(True, with_gaps[:-1] >= 0)
            with_gaps = with_gaps[keep] if len(with_gaps) else with_gaps
            if len(with_gaps):
                yield pa.record_batch([pa.array([with_gaps.astype(np.int32)], pa.list_(pa.int32()))], ["ids"])


def _candidates(ids: np.ndarray, length: int, phrases: Phrases) -> np.ndarray:
    """Where phrases of ``length`` words begin both of whose shorter ones are frequent."""
    whole = np.ones(max(0, len(ids) - length + 1), bool)
    for step in range(length):
        whole &= ids[step : step + len(whole)] >= 0
    at = np.flatnonzero(whole)
    if length == 2 or not len(at):
        return at
    needed = np.zeros(len(ids) + 1, bool)
    needed[at] = needed[at + 1] = True
    needed = np.flatnonzero(needed)
    shorter = np.lib.stride_tricks.sliding_window_view(ids, length - 1)[needed]
    frequent = np.zeros(len(ids) + 1, bool)
    if length == 3:
        # All places are still to be looked at, each distinct pair of words once.
        pairs, which = np.unique(shorter[:, 0].astype(np.int64) << 32 | shorter[:, 1], return_inverse=True)
        frequent[needed] = (phrases.places(np.column_stack([pairs >> 32, pairs & 0xFFFFFFFF])) >= 0)[which]
    else:
        frequent[needed] = phrases.places(shorter) >= 0
    return at[frequent[at] & frequent[at + 1]]


def _covered(ids: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The numbers that the phrases beginning ``at`` cover, with a gap wherever others were."""
    cover = np.zeros(len(ids) + 1, np.int32)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + length, -1)
    inside = np.cumsum(cover[:-1]) > 0
    return np.where(inside, ids, -1)[inside | np.append(True, inside[:-1])]


def _shard_automata(batches: Iterator[pa.RecordBatch], length: int, phrases: Phrases) -> Iterator[pa.RecordBatch]:
    """A task's phrases, sorted and counted, as automata, one for each range of prefixes; and, in rows of their own, the
    numbers that are left for longer phrases."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    names = ["range", "automaton", "ids"]
    kinds = (pa.int64(), pa.binary(), pa.list_(pa.int32()))

    def flush() -> Iterator[pa.RecordBatch]:
        rows, counts = summed(np.concatenate([r for r, _ in held]), np.concatenate([c for _, c in held]))
        held.clear()
        which = phrases.range_of(rows[:, 0], rows[:, 1])
        starts = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
        for start, end in zip(starts, [*starts[1:], len(rows)], strict=True):
            made = build(rows[start:end].astype(np.int64), counts[start:end]).to_bytes()
            yield pa.record_batch([pa.array([x], k) for x, k in zip((which[start], made, None), kinds, strict=True)], names)

    for batch in batches:
        lists = batch.column(0)
        for low in range(0, len(lists), 4):
            # Rows follow each other without phrases in common: each ends with a gap.
            ids = lists.slice(low, 4).flatten().to_numpy(zero_copy_only=False)
            at = _candidates(ids, length, phrases)
            if not len(at):
                continue
            if length > 2:
                left = _covered(ids, at, length).astype(np.int32)
                yield pa.record_batch([pa.array([x], k) for x, k in zip((None, None, left), kinds, strict=True)], names)
            held.append(counted(np.lib.stride_tricks.sliding_window_view(ids, length)[at]))
            if sum(len(c) for _, c in held) > HELD:
                held[:] = [summed(np.concatenate([r for r, _ in held]), np.concatenate([c for _, c in held]))]
                if len(held[0][1]) > HELD // 2:
                    yield from flush()
    if held:
        yield from flush()


def _unite(key: tuple, table: pa.Table, length: int, phrases: Phrases) -> pa.Table:
    """The automaton of a range, written; its number of phrases."""
    which = key[0].as_py()
    rows, counts = union([Automaton.of(np.frombuffer(a, np.uint8)) for a in table["automaton"].to_pylist()])
    frequent = counts >= phrases.least
    n = int(frequent.sum())
    if n:
        with writing(f"{phrases.path}/phrases-{length}-{which:08d}") as out:
            out.write(build(rows[frequent], counts[frequent]).to_bytes())
    return pa.table({"range": pa.array([which], pa.int64()), "n": pa.array([n], pa.int64())})


def count_length(texts: DataFrame, length: int, phrases: Phrases) -> tuple[Phrases, DataFrame]:
    """``phrases`` with the frequent ones of ``length`` words, and what of the texts longer ones can lie in."""
    parts = texts.mapInArrow(partial(_shard_automata, length=length, phrases=phrases), "range long, automaton binary, ids array<int>")
    if length > 2:
        parts = pin(parts)
        texts = parts.where("ids IS NOT NULL").select("ids")
    united = parts.where("automaton IS NOT NULL").select("range", "automaton").groupBy("range")
    found = pin(united.applyInArrow(lambda key, table: _unite(key, table, length, phrases), "range long, n long"))
    ranges = sorted((r["range"], r.n) for r in found.where("n > 0").collect())  # a row per range
    before = np.cumsum([0, *(n for _, n in ranges)])[:-1]
    mine = (tuple(r for r, _ in ranges), tuple(int(b) for b in before))
    return Phrases(**{**vars(phrases), "lengths": (*phrases.lengths, mine)}), texts


_FOUND = "lang string, phrase string, length int, place long, a long, l long, r long, n long, score long, inside array<long>"


def _judge(batches: Iterator[pa.RecordBatch], length: int, phrases: Phrases) -> Iterator[pa.RecordBatch]:
    """All phrases of each range with the parts of their weakest cut, and the places of the phrases one word shorter that
    lie in them and are no more frequent."""
    names = [part.split()[0] for part in _FOUND.split(", ")]
    ranges, before = phrases.lengths[length - 2]
    for batch in batches:
        for i in batch.column(0).to_pylist():
            made = phrases.automaton(length, ranges[i])
            for low in range(0, len(made.weights), 1 << 14):
                high = min(low + (1 << 14), len(made.weights))
                rows, a = made.rows(low, high), np.array(made.weights[low:high])
                inside: list[list[int]] = [[] for _ in range(len(a))]

                def part(columns: np.ndarray, inside=inside, a=a) -> np.ndarray:
                    if columns.shape[1] == 1:
                        return phrases.counts(columns[:, 0])
                    places = phrases.places(columns)
                    counts = phrases.weights(columns.shape[1], places)
                    if columns.shape[1] == length - 1:
                        for j in np.flatnonzero(counts == a).tolist():
                            inside[j].append(int(places[j]))
                    return counts

                n = phrases.totals(rows[:, 0])
                best = [None] * len(a)
                for k in range(1, length):
                    left, right = part(rows[:, :k]), part(rows[:, k:])
                    for j, cut in enumerate(zip(a.tolist(), n.tolist(), left.tolist(), right.tolist(), strict=True)):
                        score = 1000 * cut[0] * cut[1] // (cut[2] * cut[3])
                        if best[j] is None or score < best[j][0]:
                            best[j] = (score, cut[2], cut[3])
                distinct, which = np.unique(rows, return_inverse=True)
                texts = [t.partition(b"\0")[::2] for t in phrases.texts(distinct)]
                which = which.reshape(rows.shape)
                langs = [texts[x][0].decode() for x in which[:, 0]]
                spelled = [b" ".join(texts[x][1] for x in row).decode() for row in which]
                columns = [
                    pa.array(langs, pa.string()), pa.array(spelled, pa.string()), pa.array([length] * len(a), pa.int32()), pa.array(np.arange(low, high) + before[i]),
                    pa.array(a), *(pa.array([b[x] for b in best], pa.int64()) for x in (1, 2)), pa.array(n), pa.array([b[0] for b in best], pa.int64()),
                    pa.array(inside, pa.list_(pa.int64())),
                ]
                yield pa.record_batch(columns, names)


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 100, longest: int = 5, top: int = 2000, range_words: int = 8_000_000
) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are cut into pieces at ``.,;:!?`` and line breaks, pieces into words at spaces and tabs, A-Z lower-cased. Phrases of
    2 to ``longest`` words that come at least ``least`` times are scored by their weakest cut, ``floor(1000*a*n/(l*r))`` with
    ``a``, ``l`` and ``r`` the counts of the phrase and its parts and ``n`` the words of the language; of equal cuts the first
    counts. A phrase inside a longer one of the same count is left out. The first ``top`` of a language stay by score and
    count, falling, then phrase. A null language is ``und``, a null text is empty; rows that repeat count each. Other
    columns are ignored; a table without frequent phrases gives no rows. At most 2^31 frequent words can be numbered.
    """
    spark = docs.sparkSession
    schema = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    phrases = number_words(docs, least, range_words, lang, text)
    if phrases.first_ids and phrases.first_ids[-1] >= 2**31:
        raise ValueError("more than 2^31 frequent words")
    if not phrases.shards:
        return spark.createDataFrame([], schema)
    texts = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    texts = pin(texts.mapInArrow(partial(_number_texts, phrases=phrases), "ids array<int>"))
    for length in range(2, longest + 1):
        phrases, texts = count_length(texts, length, phrases)
        if not phrases.lengths[-1][0]:
            break
    found = None
    for length, (ranges, _) in enumerate(phrases.lengths, start=2):
        if not ranges:
            break
        each = spark.range(0, len(ranges), 1, min(len(ranges), int(spark.conf.get("spark.sql.shuffle.partitions"))))
        judged = each.mapInArrow(partial(_judge, length=length, phrases=phrases), _FOUND)
        found = judged if found is None else found.unionByName(judged)
    if found is None:
        return spark.createDataFrame([], schema)
    found = pin(found)
    gone = found.select((F.col("length") - 1).alias("length"), F.explode("inside").alias("place")).distinct()
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First the best of each share of a language, so that no task sorts a whole language.
    share = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*best)
    kept = found.drop("inside").join(gone, ["length", "place"], "left_anti").withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
