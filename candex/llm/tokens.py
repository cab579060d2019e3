"""Token ids as compressed binary files, and back.

Documents are sorted by id into ranges; each range is one file: runs of blocks, then an index of its documents. A run is
a header (ids, ids of a block, kinds of ids, bytes and CRC-32 of the directory), a directory (each kind and its share, each
block's bytes and the CRC-32 of its ids as little-endian unsigned 32-bit integers), and the codes of its blocks. A block
starts with empty models, so it can be read with the directory alone, and damage to a code stays in its block. The index
at the end holds document ids, a null mark each, and token counts. All numbers are little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candex.llm.arrays import mapped, writing
from candex.llm.rangecoder import decode_blocks, encode_blocks, shares_of
from candex.plans.limits import pin, scratch_path

MAGIC = b"TOKIDS03"
BLOCK, LANES = 512, 8192
_HEAD, _END = struct.Struct("<IIIII"), struct.Struct("<QQ8s")
_CACHED, _TOGETHER, _AT_ONCE = 1_000_000, 100, 1 << 18
_LETTERS, _MARKS = "abcdefghijklmnopqrstuvwxyz", ".,;:!?%#*&$"
_LATIN = _LETTERS + "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"


def public_vocabulary() -> str:
    """Path of the default tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The runs of a pool at some places, one after the other."""
    sizes = sizes[places]
    before = np.cumsum(sizes) - sizes
    return pool[np.repeat(starts[places] - before, sizes) + np.arange(int(sizes.sum()))]


class WordTokens:
    """Ids of texts by a tokenizer that drops white space and never joins words across it.

    For such a tokenizer the ids of a text are those of its words one after the other, so every distinct word of a
    batch is encoded once, by the tokenizer; results are kept for a bounded number of words. Where a trial shows that the
    vocabulary takes punctuation after letters for itself and does not tell A-Z from a-z, words of letters share their ids
    with the same letters in other case or before other punctuation. Where it marks the ends of words, many words of
    letters are encoded as one text and told apart by these marks; if their number is not that of the words, one by one.
    Words of small Latin letters skip the tokenizer's normalizer and splitting, where a trial with all pairs of these letters
    shows that both leave them as they are.
    """

    def __init__(self, vocabulary: str, end: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.end = Tokenizer.from_file(vocabulary), end
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closes = np.zeros(1 << 16, bool)
        if suffix:
            self.closes[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        added = any(t.content.isalpha() or not t.content.strip(_MARKS) for t in self.tokenizer.get_added_tokens_decoder().values())
        big, small, both, marks = (self._ids(w) for w in (_LETTERS.upper(), _LETTERS, _LETTERS + _MARKS, _MARKS))
        self.folds, self.cuts, self.joins = big == small and not added, both == small + marks and not added, bool(suffix) and not added
        # The same model behind a split at white space.
        lean = Tokenizer(self.tokenizer.model)
        lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        trial = " ".join(a + b for a in _LATIN for b in _LATIN)
        self.lean = lean if self.joins and lean.encode(trial, add_special_tokens=False).ids == self._ids(trial) else self.tokenizer
        self._clear()

    def _clear(self):
        self.parts = {"": 0}
        self.pool, self.starts, self.sizes = np.zeros(0, np.uint16), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _ids(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _keep(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Adds ids to the pool; gives their places."""
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, flat])
        return np.arange(len(self.sizes) - len(sizes), len(self.sizes))

    def _pick(self, places: np.ndarray) -> np.ndarray:
        return _gathered(self.pool, self.starts, self.sizes, places)

    def _learn(self, names: pa.Array, parts: list[str]) -> np.ndarray:
        """Encodes new parts, given in both forms; gives their places."""
        latin = pc.match_substring_regex(names, f"^[{_LATIN}]+$").to_numpy(zero_copy_only=False) & self.joins
        other = pc.utf8_is_alpha(names).to_numpy(zero_copy_only=False) & self.joins & ~latin
        alone, known, flats, sizes = np.flatnonzero(~latin & ~other).tolist(), [], [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
        for tokenizer, at in ((self.lean, np.flatnonzero(latin).tolist()), (self.tokenizer, np.flatnonzero(other).tolist())):
            groups = [at[i : i + _TOGETHER] for i in range(0, len(at), _TOGETHER)]
            coded = tokenizer.encode_batch_fast([" ".join([parts[i] for i in g]) for g in groups], add_special_tokens=False)
            for group, ids in zip(groups, coded, strict=True):
                flat = np.array(ids.ids, np.uint16)
                ends = np.flatnonzero(self.closes[flat]) + 1
                if len(ends) == len(group) and ends[-1] == len(flat):
                    known += group
                    flats.append(flat)
                    sizes.append(np.diff(ends, prepend=0))
                else:
                    alone += group
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([parts[i] for i in alone], add_special_tokens=False)]
        sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
        flats.append(np.fromiter((x for word in ids for x in word), np.uint16, int(sizes[-1].sum())))
        places = np.empty(len(parts), np.int64)
        places[known + alone] = self._keep(np.concatenate(flats), np.concatenate(sizes))
        self.parts.update(zip(parts, places.tolist(), strict=True))
        return places

    def _places(self, names: pa.Array) -> np.ndarray:
        if len(self.parts) > _CACHED:
            self._clear()
        get, parts = self.parts.get, names.to_numpy(zero_copy_only=False).tolist()
        places = np.fromiter([get(p, -1) for p in parts], np.int64, len(parts))
        new = np.flatnonzero(places < 0)
        if len(new):
            places[new] = self._learn(names.take(pa.array(new)), [parts[i] for i in new.tolist()])
        return places

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many each has."""
        heads = pc.utf8_rtrim(words, _MARKS) if self.cuts else words
        letters = pc.utf8_is_alpha(heads)
        cut = pc.and_(letters, pc.not_equal(pc.binary_length(heads), pc.binary_length(words)))
        if self.folds:
            heads = pc.if_else(pc.string_is_ascii(heads), pc.ascii_lower(heads), heads)
        tails = pc.replace_substring_regex(words.filter(cut), f"(?s)^.*[^{_MARKS}]", "")
        parts = pa.concat_arrays([pc.if_else(letters, heads, words), tails]).dictionary_encode()
        found = self._places(parts.dictionary)[parts.indices.to_numpy()]
        places = np.zeros((len(words), 2), np.int64)  # the first part is empty
        places[:, 0] = found[: len(words)]
        places[cut.to_numpy(zero_copy_only=False), 1] = found[len(words) :]
        return self._pick(places.ravel()), self.sizes[places].sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end id after each text, and the number of ids of each text."""
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        pool, lengths = self._words(coded.dictionary)
        sizes = lengths[at]
        total = np.concatenate(([0], np.cumsum(sizes)))
        ends = total[words.offsets.to_numpy() - words.offsets[0].as_py()]
        counts = np.diff(ends) + 1
        out = np.empty(int(total[-1]) + len(counts), np.uint16)
        last = np.cumsum(counts) - 1
        inner = np.ones(len(out), bool)
        inner[last] = False
        starts = np.cumsum(lengths) - lengths
        flat = [_gathered(pool, starts, lengths, at[i : i + _AT_ONCE]) for i in range(0, len(at), _AT_ONCE)]
        out[inner] = np.concatenate(flat) if flat else 0
        out[last] = self.end
        return out, counts


@lru_cache(maxsize=1)
def word_tokens(vocabulary: str, end: int) -> WordTokens:
    """One for all tasks of a worker, which then share the words it knows."""
    return WordTokens(vocabulary, end)


def _runs(texts: pa.Array, size: int = 16 << 20) -> Iterator[pa.Array]:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def _coded(ids: np.ndarray) -> Iterator[bytes]:
    """A run of ids as the bytes of its header, its directory and its blocks."""
    shares = shares_of(ids)
    kinds = np.flatnonzero(shares)
    blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    codes = encode_blocks(blocks, shares)
    wide = ids.astype("<u4")
    sums = [zlib.crc32(wide[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    numbers = np.concatenate([kinds, shares[kinds], [len(c) for c in codes], sums]).astype("<u4")
    directory = zlib.compress(numbers.tobytes(), 1)
    facts = len(ids), BLOCK, len(kinds), len(directory)
    yield _HEAD.pack(*facts, _check(facts, directory))
    yield directory
    yield from codes


def _check(facts: tuple[int, ...], directory: bytes) -> int:
    return zlib.crc32(directory, zlib.crc32(np.array(facts, "<u4")))


def _write_file(batches: Iterator[pa.RecordBatch], path: str, vocabulary: str, end: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId()
    words = word_tokens(vocabulary, end)
    held, waiting, size, tokens = [], 0, len(MAGIC), 0
    index: list[tuple[np.ndarray, ...]] = []
    with writing(f"{path}/ids-{shard:06d}") as out:
        out.write(MAGIC)

        def flush(all_of_it: bool) -> None:
            nonlocal held, waiting, size
            ids = np.concatenate(held) if held else np.zeros(0, np.uint16)
            step = BLOCK * LANES
            while len(ids) >= step or all_of_it and len(ids):
                part, ids = ids[:step], ids[step:]
                for piece in _coded(part):
                    out.write(piece)
                    size += len(piece)
            held, waiting = [ids], len(ids)

        for batch in batches:
            counts = [np.zeros(0, np.int64)]
            for run in _runs(batch.column(1)):
                ids, n = words.encode(run)
                counts.append(n)
                held.append(ids)
                waiting += len(ids)
                if waiting >= BLOCK * LANES:
                    flush(False)
            n = np.concatenate(counts)
            index.append((pc.fill_null(batch.column(0), 0).to_numpy(), pc.is_null(batch.column(0)).to_numpy(zero_copy_only=False), n))
            tokens += int(n.sum())
        flush(True)
        rows = sum(len(n) for _, _, n in index)
        for k, kind in enumerate(("<i8", "u1", "<i8")):
            for part in index:
                out.write(part[k].astype(kind).tobytes())
        out.write(_END.pack(size, rows, MAGIC))
    if rows:
        yield pa.record_batch([pa.array([x], pa.int64()) for x in (shard, rows, tokens, size + 17 * rows + _END.size)], ["shard", "rows", "tokens", "bytes"])


@dataclass(frozen=True)
class TokenFiles:
    """Where the files are, their shards in order, and the ids in each."""

    path: str
    shards: list[int]
    tokens: list[int]
    bytes: int


def write_tokens(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, vocabulary: str | None = None, end: int = 2
) -> TokenFiles:
    """Encodes every whole text, appends ``end``, and writes the ids in files of ascending ``doc_id`` (null first).

    A null text is empty: its only id is ``end``. Rows with one id follow each other in the order of a hash of their texts, so
    an id that many rows share, or null, is spread over files as well. The vocabulary must have fewer than 65536 ids and be of the kind ``WordTokens`` asks for. An empty table gives no files.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    ranged = rows.repartitionByRange(partitions, "doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text")
    written = ranged.select("doc_id", "text").mapInArrow(
        partial(_write_file, path=path, vocabulary=vocabulary or public_vocabulary(), end=end), "shard long, rows long, tokens long, bytes long"
    )
    found = sorted(pin(written).collect())  # a row per file
    return TokenFiles(path, [r.shard for r in found], [r.tokens for r in found], sum(r.bytes for r in found))


def read_frames(data: np.ndarray) -> Iterator[np.ndarray]:
    """The ids of a file in order, in runs of blocks; a block that does not match its checksum raises ValueError."""
    stop, at = _END.unpack(data[-_END.size :].tobytes())[0], len(MAGIC)
    while at < stop:
        *facts, check = _HEAD.unpack(data[at : at + _HEAD.size].tobytes())
        n, block, kinds, size = facts
        at += _HEAD.size
        directory = data[at : at + size].tobytes()
        if _check(tuple(facts), directory) != check:
            raise ValueError("a directory of token ids is damaged")
        at += size
        numbers = np.frombuffer(zlib.decompress(directory), "<u4")
        shares = np.zeros(1 << 16, np.uint32)
        shares[numbers[:kinds]] = numbers[kinds : 2 * kinds]
        sizes, sums = np.split(numbers[2 * kinds :].astype(np.int64), 2)
        ends = (at + np.cumsum(sizes)).tolist()
        codes = [data[a:b].tobytes() for a, b in zip([at, *ends], ends, strict=False)]
        at = ends[-1]
        ids = np.concatenate(decode_blocks(codes, [min(block, n - i) for i in range(0, n, block)], shares))
        wide = ids.astype("<u4")
        for i, wanted in zip(range(0, n, block), sums.tolist(), strict=True):
            if zlib.crc32(wide[i : i + block]) != wanted:
                raise ValueError("a block of token ids is damaged")
        yield ids


def _read_files(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = np.asarray(mapped(f"{path}/ids-{shard:06d}", np.uint8))
            index, rows, magic = _END.unpack(data[-_END.size :].tobytes())
            if magic != MAGIC or data[: len(MAGIC)].tobytes() != MAGIC:
                raise ValueError(f"{shard} is no file of token ids")
            doc = data[index : index + 8 * rows].view("<i8")
            null = data[index + 8 * rows : index + 9 * rows].astype(bool)
            counts = data[index + 9 * rows : index + 17 * rows].view("<i8")
            left, at = np.zeros(0, np.uint16), 0
            for ids in read_frames(data):
                ids = np.concatenate([left, ids])
                ends = np.cumsum(counts[at:])
                n = int(np.searchsorted(ends, len(ids), "right"))
                for low in range(0, n, 1000):
                    high = min(n, low + 1000)
                    first = int(ends[low - 1]) if low else 0
                    part = ids[first : int(ends[high - 1])].astype("<u4")
                    offsets = np.concatenate(([first], ends[low:high])) - first
                    binary = pa.Array.from_buffers(pa.large_binary(), high - low, [None, pa.py_buffer(offsets * 4), pa.py_buffer(part)])
                    where = slice(at + low, at + high)
                    starts = start + first + offsets[:-1]
                    columns = [pa.array(doc[where], mask=null[where]), pa.array(starts), pa.array(counts[where]), binary.cast(pa.binary())]
                    yield pa.record_batch(columns, ["doc_id", "start", "n_tokens", "ids"])
                done = int(ends[n - 1]) if n else 0
                left, start, at = ids[done:], start + done, at + n


def read_tokens(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document: its first place among all ids, and its ids as 32-bit integers."""
    starts = np.cumsum([0, *files.tokens])[:-1].tolist()
    shards = spark.createDataFrame(list(zip(files.shards, starts, strict=True)), "shard long, start long")
    dealt = shards.repartitionByRange(max(1, len(files.shards)), "shard")
    return dealt.mapInArrow(partial(_read_files, path=files.path), "doc_id long, start long, n_tokens long, ids binary")
