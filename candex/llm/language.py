"""Language of a text by unigram piece models summed over all segmentations.

The pieces are those of a fixed public vocabulary. Each language has a probability for every piece; the likelihood of a
word is the sum over all ways to cut it into pieces, computed by a forward pass over its characters for all words of
a batch at once. The probabilities are fitted by expectation maximisation on word counts of a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candex.plans.limits import pin

LONGEST = 16
UNKNOWN = 1e-7
_CACHED = 250_000
_BATCH = 1 << 14
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TINY, _LIFT = 1e-120, 1e120
#: Longer words are learned in consecutive parts: sums over segmentations of a part need no scaling.
_PART = 23


def public_vocabulary() -> str:
    """Path of the default vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> list[str]:
    """The text pieces of a sentencepiece model in the order of their ids, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i))
    return [p for p in pieces if len(p) <= LONGEST]


class Lattice:
    """All pieces at all places of words, found by hashes of code points."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        hashes = np.zeros(self.n, np.uint64)
        sizes = np.array([len(p) for p in pieces])
        for size in np.unique(sizes):
            where = np.flatnonzero(sizes == size)
            chars = np.array([pieces[i] for i in where], dtype=f"U{size}").view(np.uint32).reshape(len(where), size)
            for place in range(size):
                hashes[where] = (hashes[where] + chars[:, place] + np.uint64(1)) * _BASE
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order.astype(np.int32)
        self.likely = np.zeros(1 << 20, bool)
        self.likely[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def batches(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of words of like length: their places, lengths, and ids[word, end, length of the piece - 1].

        Every word starts with the word mark. A character that is no piece is the unknown piece, id ``n``; id
        ``n + 1`` means that there is no piece.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            width = int(sizes[order[at]])
            width = width if width <= 12 else 1 << (width - 1).bit_length()
            room = max(1, _BATCH * 12 // width)
            end = min(at + room, int(np.searchsorted(sizes[order], width, "right")))
            where = order[at:end]
            at = end
            chars = np.array(["▁" + words[i] for i in where], dtype=f"U{width}").view(np.uint32).reshape(len(where), width)
            codes = chars.astype(np.uint64) + np.uint64(1)
            yield where, sizes[where], self._ids(codes, sizes[where])

    def _ids(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        rows, width = codes.shape
        reach = min(LONGEST, width)
        ids = np.full((rows, width + 1, reach), self.n + 1, np.int32)
        inside = np.arange(width) < sizes[:, None]
        ids[:, 1:, 0] = np.where(inside, self.n, self.n + 1)
        rolled = np.zeros((rows, width), np.uint64)
        for length in range(1, reach + 1):
            starts = width - length + 1
            rolled = (rolled[:, :starts] + codes[:, length - 1 : length - 1 + starts]) * _BASE
            r, s = np.nonzero(self.likely[(rolled >> np.uint64(44)).astype(np.int64)] & inside[:, length - 1 :])
            keys = rolled[r, s]
            place = np.minimum(np.searchsorted(self.hashes, keys), self.n - 1)
            hit = self.hashes[place] == keys
            ids[r[hit], s[hit] + length, length - 1] = self.ids[place[hit]]
        return ids


def forward(ids: np.ndarray, sizes: np.ndarray, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all segmentations. prob[piece, language]; returns log likelihoods and the sums at each end, scaled."""
    rows, ends, reach = ids.shape
    sums = np.zeros((rows, ends, prob.shape[1]))
    sums[:, 0] = 1
    lifted = np.zeros((rows, prob.shape[1]))
    out = np.zeros((rows, prob.shape[1]))
    for end in range(1, ends):
        for length in range(1, min(reach, end) + 1):
            used = ids[:, end, length - 1]
            sums[:, end] += sums[:, end - length] * prob[used]
        done = sizes == end
        if done.any():
            out[done] = np.log(sums[done, end]) - lifted[done]
        if ends > 24:
            low = (sums[:, end] < _TINY) & (sizes > end)[:, None]
            if low.any():
                near = sums[:, max(0, end - reach + 1) : end + 1]
                near *= np.where(low, _LIFT, 1)[:, None]
                lifted += low * np.log(_LIFT)
    return out, sums


def expected_counts(ids: np.ndarray, sizes: np.ndarray, prob: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, by forward and backward sums over one language's words of at most 24 characters."""
    rows, ends, reach = ids.shape
    _, ahead = forward(ids, sizes, prob[:, None])
    ahead = ahead[:, :, 0]
    back = np.zeros((rows, ends))
    back[np.arange(rows), sizes] = 1
    counts = np.zeros(len(prob))
    scale = weights / ahead[np.arange(rows), sizes]
    for end in range(ends - 1, 0, -1):
        for length in range(1, min(reach, end) + 1):
            used = ids[:, end, length - 1]
            through = prob[used] * back[:, end]
            counts += np.bincount(used, ahead[:, end - length] * through * scale, len(prob))
            back[:, end - length] += through
    return counts


@dataclass
class LanguageModel:
    """Piece probabilities, one column a language; the languages in code point order."""

    pieces: list[str]
    languages: list[str]
    prob: np.ndarray
    _cache: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return {"pieces": self.pieces, "languages": self.languages, "prob": self.prob, "_cache": {}}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word in each language; results are kept for a bounded number of words."""
        c = self._cache
        if not c or len(c["at"]) > _CACHED:
            c |= {"at": {}, "rows": np.zeros((0, len(self.languages))), "lattice": c.get("lattice") or Lattice(self.pieces)}
        known, new = c["at"], []
        places = np.zeros(len(words), np.int64)
        for i, word in enumerate(words):
            place = known.get(word)
            if place is None:
                place = known[word] = len(known)
                new.append(word)
            places[i] = place
        if new:
            rows = np.zeros((len(new), len(self.languages)))
            for where, sizes, ids in c["lattice"].batches(new):
                rows[where], _ = forward(ids, sizes, self.prob)
            c["rows"] = np.concatenate([c["rows"], rows])
        return c["rows"][places]


def _word_lists(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[str]]]:
    """Runs of texts of about 4 MB: place of the first, words of each text, index of each word, the distinct words."""
    texts = pc.fill_null(texts, "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (4 << 20), "right")))
        words = pc.utf8_split_whitespace(pc.utf8_lower(texts.slice(at, end - at)))
        coded = words.flatten().dictionary_encode()
        yield at, np.diff(words.offsets.to_numpy()), coded.indices.to_numpy(), coded.dictionary.to_pylist()
        at = end


def _predict(batches: Iterator[pa.RecordBatch], model: LanguageModel, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.large_string())
        found, scores = [], []
        for at, counts, index, words in _word_lists(texts):
            total = np.zeros((len(counts), len(model.languages)))
            if model.languages and len(index):
                rows = model.word_scores(words)
                if "" in words:
                    rows[words.index("")] = 0
                owner = np.repeat(np.arange(len(counts)), counts)
                for k in range(len(model.languages)):
                    total[:, k] = np.bincount(owner, rows[index, k], len(counts))
            letters = [any(map(str.isalpha, t or "")) for t in texts.slice(at, len(counts)).to_pylist()]
            for row, has in zip(total, letters, strict=True):
                if has and model.languages:
                    share = np.exp(row - row.max())
                    found.append(model.languages[int(row.argmax())])
                    scores.append(float(share.max() / share.sum()))
                else:
                    found.append("und")
                    scores.append(0.0)
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.record_batch([*columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names)


def predict_language(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score`` for every row, from the whole text alone.

    ``score`` is the posterior probability of the language with equal priors. A text that is null, empty or without
    a letter gives ``und`` and 0; so does every text if the model knows no language. Ties go to the first language in
    code point order. Words of any length are scored whole.
    """
    rows = docs.select(*keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    names = [*keep, "lang_pred", "score"]
    return rows.mapInArrow(partial(_predict, model=model, names=names), f"{schema}, lang_pred string, score double")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_string())
        for at, counts, index, words in _word_lists(texts):
            langs = batch.column(0).slice(at, len(counts)).dictionary_encode()
            owner = np.repeat(langs.indices.to_numpy(zero_copy_only=False), counts)
            pairs, n = np.unique(owner.astype(np.int64) * len(words) + index, return_counts=True)
            if len(pairs):
                lang = langs.dictionary.take(pa.array(pairs // len(words)))
                yield pa.record_batch([lang, pa.array(words, pa.string()).take(pa.array(pairs % len(words))), pa.array(n)], ["lang", "word", "n"])


def _expect(frames: Iterator[pd.DataFrame], model: LanguageModel) -> Iterator[pd.DataFrame]:
    lattice, totals = Lattice(model.pieces), np.zeros_like(model.prob)
    for frame in frames:
        for k, lang in enumerate(model.languages):
            rows = frame[frame["lang"] == lang]
            words, n = rows["word"].tolist(), rows["n"].to_numpy(float)
            for where, sizes, ids in lattice.batches(words):
                totals[:, k] += expected_counts(ids, sizes, model.prob[:, k], n[where])
    piece, k = np.nonzero(totals > 1e-9)
    yield pd.DataFrame({"lang": [model.languages[i] for i in k], "piece": piece, "n": totals[piece, k]})


def smallest_hashes(hashes: DataFrame, n: int) -> DataFrame:
    """The ``n`` smallest of the different hashes ``h`` of each ``lang``.

    Hashes are counted by their first 20 bits; what lies behind the range that holds the last wanted one goes before
    anything is ranked. So a task ranks counts of 2^20 ranges and ``n`` hashes with those of one range more, however many there are.
    """
    hashes = hashes.withColumn("part", F.shiftright("h", 44))
    ranges = hashes.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("lang").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    wanted = ranges.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < n)
    # By language and range: no task gets all hashes of a language.
    near = hashes.join(wanted.select("lang", "part"), ["lang", "part"], "left_semi")
    place = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    return near.withColumn("place", place).where(F.col("place") <= n).select("lang", "h")


def fit_languages(
    docs: DataFrame, trained_on: Column | None = None, text: str = "text", lang: str = "lang",
    vocabulary: str | None = None, sample_docs: int = 6000, rounds: int = 2, smooth: float = 0.05,
) -> LanguageModel:
    """Fits piece probabilities on at most ``sample_docs`` different texts of each language with ``trained_on``.

    The sample of a language is the texts whose hash is smallest, each once however often it is copied, so it is the
    same in every run and no language is missing for being rare; rows without text or label are left out. Words are
    counted in Spark, those of more than 23 characters in consecutive parts, and each round of expectation maximisation is a pass over these counts; only the tables of pieces,
    languages x vocabulary, come to the driver. No labelled rows: a model that knows no language.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = (rows if trained_on is None else rows.where(trained_on)).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    chosen = pin(smallest_hashes(pin(rows.select("lang", "h").distinct()), sample_docs))
    pieces = read_pieces(vocabulary or public_vocabulary())
    if chosen.isEmpty():
        return LanguageModel(pieces, [], np.zeros((len(pieces) + 2, 0)))
    # Rows with one hash and label have one text.
    texts = rows.join(chosen, ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "text")
    counted = texts.mapInArrow(_count_words, "lang string, word string, n long").where("word <> ''")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.char_length("word") - 1) / _PART)), lambda i: F.substring(F.col("word"), i * _PART + 1, F.lit(_PART)))
    counted = pin(counted.select("lang", F.explode(parts).alias("word"), "n").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    languages = sorted(r[0] for r in counted.select("lang").distinct().collect())
    # Merges of a vocabulary come in the order of their frequency.
    first = 1 / np.arange(10, len(pieces) + 10)
    prob = np.repeat(np.append(first / first.sum(), [UNKNOWN, 0])[:, None], len(languages), axis=1)
    model = LanguageModel(pieces, languages, prob)
    for _ in range(rounds):
        parts = counted.mapInPandas(partial(_expect, model=model), "lang string, piece long, n double")
        got = parts.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros_like(prob)
        counts[got["piece"], got["lang"].map(languages.index)] = got["n"]
        counts = counts[:-2] + smooth
        unknown = np.full((1, len(languages)), UNKNOWN)
        model = LanguageModel(pieces, languages, np.vstack([counts / counts.sum(axis=0), unknown, 0 * unknown]))
    return model


def bucket(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % n
