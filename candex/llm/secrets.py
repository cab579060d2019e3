"""Secrets in texts: patterns of assignments and keys, and strings that a tokenizer finds hard to shorten.

A vocabulary made from text writes words and names in few tokens of several characters each, but a random string in many
tokens of one or two. So runs of key characters are encoded, and those with few characters per token are reported, unless
they are something known that only looks random: digests of the usual lengths, UUIDs, numbers, or names made of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of the base kinds, in the order in which spans of one start are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run is taken whole or not at all, so its least length can stand in the pattern.
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
_DIGEST_SIZES = {32, 40, 56, 64, 96, 128}
_HEXADECIMAL = re.compile(r"[0-9a-fA-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_NUMBER = re.compile(r"[0-9+/_=-]*")
#: A name: words and short numbers between separators, or several words of which each but the first has a capital in front.
_SEPARATOR = re.compile(r"[+/_=-]+")
_WORD = re.compile(r"[A-Z]+|[A-Z]?[a-z]+(?:[A-Z][a-z]{2,})*[A-Z]?|[0-9]{1,8}|[A-Za-z]{2,}[0-9]{1,4}")
_ONE_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
#: A run is encoded in parts of so many characters, which costs at most one token a part.
_PART = 4096


def public_ranks() -> str:
    """Path of the default vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(vocabulary: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("candex", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def known(run: str) -> bool:
    """Whether a run is a digest of a usual length, a UUID, a number, or a name made of several words or numbers."""
    if _HEXADECIMAL.fullmatch(run) and len(run) in _DIGEST_SIZES or _UUID.fullmatch(run) or _NUMBER.fullmatch(run):
        return True
    if _ONE_WORD.fullmatch(run):
        return False
    return all(not part or _WORD.fullmatch(part) for part in _SEPARATOR.split(run))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``start, end, kind`` of the base patterns, leftmost and without overlaps within a kind."""
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return spans


def _apart(runs: list[tuple[int, int]], spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The ascending runs that no span meets."""
    if not spans or not runs:
        return runs
    starts = np.array(sorted(s for s, _, _ in spans))
    ends = np.array(sorted(e for _, e, _ in spans))
    at = np.array(runs)
    # Spans that have begun before a run ends, but for those that have ended before it begins.
    meets = np.searchsorted(starts, at[:, 1], "left") - np.searchsorted(ends, at[:, 0], "right")
    return [run for run, m in zip(runs, meets, strict=True) if not m]


def scan_texts(texts: list[str | None], vocabulary: str, shortest: int, ratio: float) -> Iterator[list[tuple[int, int, str]]]:
    """All spans of each text, by start and then kind."""
    encoding = _encoding(vocabulary)
    finder = re.compile(RUN.pattern[:-1] + f"{{{shortest},}}")
    hard: dict[str, bool] = {}
    for text in texts:
        if not text:
            yield []
            continue
        spans = base_spans(text)
        runs = _apart([m.span() for m in finder.finditer(text)], spans)
        for start, end in runs:
            run = text[start:end]
            verdict = hard.get(run)
            if verdict is None:
                verdict = not known(run)
                if verdict:
                    parts = [run[i : i + _PART] for i in range(0, len(run), _PART)]
                    verdict = len(run) < ratio * sum(map(len, encoding.encode_ordinary_batch(parts, num_threads=1)))
                if len(run) <= 256:
                    hard[run] = verdict
            if verdict:
                spans.append((start, end, "random"))
        if len(hard) > 100_000:
            hard.clear()
        yield sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def _scan(batches: Iterator[pa.RecordBatch], vocabulary: str, shortest: int, ratio: float) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = list(scan_texts(part.column(part.num_columns - 1).to_pylist(), vocabulary, shortest, ratio))
            flat = [{"kind": k, "start": s, "end": e} for spans in found for s, e, k in spans]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in found])))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, span))
            yield pa.record_batch([part.column(0), lists], ["row", "spans"])


def find_secrets(
    docs: DataFrame, keep: list[str], text: str = "text", shortest: int = 20, ratio: float = 2.0, vocabulary: str | None = None
) -> DataFrame:
    """The columns ``keep`` and ``spans``: ``kind, start, end`` of every find in the whole text, by start, then kind.

    Places are code points, the end is exclusive. Kinds are ``assign`` (a password, secret, token or key given a value of
    at least 6 characters), ``access`` (an access key of at least 20), ``hex`` (at least 24 hexadecimal digits) and
    ``random``: a run of at least ``shortest`` key characters with fewer than ``ratio`` characters per token that meets no
    span of another kind and is no digest, UUID, number or name made of several words. A null text is empty and has no spans.
    Rows that repeat are rows of their own. ``keep`` can hold columns of any name but ``spans``, which is a ValueError.
    """
    if any(name.lower() == "spans" for name in keep):
        raise ValueError("a column named spans cannot be kept")
    # The kept columns travel as one, so their names cannot clash with others.
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("spans", T.ArrayType(_SPAN))])
    job = partial(_scan, vocabulary=vocabulary or public_ranks(), shortest=shortest, ratio=ratio)
    found = rows.mapInArrow(job, schema)
    return found.select("row.*", "spans")


def listed(spans: str, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans of these kinds, joined by commas."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
