"""Words of many texts at once: 64-bit hashes by numpy, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20

_random = np.random.default_rng(20240229)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _random.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = _random.integers(0, 2**64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over the whole word (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts in order, A-Z lower-cased, and each text's count."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    word = ~_SPACE[data]
    before = np.concatenate(([False], word[:-1]))
    starts = np.flatnonzero(word & ~before)
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    sizes = np.flatnonzero(~word & before) - starts
    offsets = np.cumsum(sizes) - sizes
    place = np.arange(offsets[-1] + sizes[-1]) - np.repeat(offsets, sizes)
    power = np.concatenate(([np.uint64(1)], np.full(int(sizes.max()), _BASE))).cumprod(dtype=np.uint64)
    return mix(np.add.reduceat(_BYTE[data[word]] * power[place], offsets) + sizes.astype(np.uint64)), counts


def text_chunks(texts: list, size: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """The texts as UTF-8, null as empty, in runs of about ``size`` bytes, with the place of each run's first text."""
    at, run, total = 0, [], 0
    for i, text in enumerate(texts):
        run.append(text.encode() if text else b"")
        total += len(run[-1])
        if total >= size:
            yield at, run
            at, run, total = i + 1, [], 0
    if run:
        yield at, run
