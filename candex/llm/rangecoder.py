"""Range coder for token ids with adaptive context mixing, for many blocks in step.

A block starts with empty models. The ids last seen after the last two ids and after the last id are predictions of order
2 and 1 of the next id; the one of order 2 is taken if it held before. Order 0 adapts as well: a block counts its ids by
class, and what is expected before any has come is how often each id comes in the run of blocks, which the run carries as
a table. The next id is mixed from all: with one probability it is the prediction, else it is drawn from order 0. That
probability adapts; it mixes two adaptive ones, one chosen by how sure order 2 is and by whether both orders agree, one by
how sure order 1 is and by what came of the last two predictions, with a weight that follows whichever did better. Blocks
are independent, so numpy runs all of them at once, one id of each per step.

A class is a run of ids with about 1/64 of the table, so ids that are more frequent have one each. Counts are kept as sums in
two levels of 64-bit words: a byte for each branch says how many ids have come in it and in those before it, with what the
table counts for. Ids of a class have the shares of the table.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

TOTAL_BITS = 12
TOTAL = 1 << TOTAL_BITS
_SLOTS, _CHANCES = 64, 8 + 16
_FULL, _WORD, _UNIT = np.uint64(1 << 48), np.uint64(16), np.uint64(TOTAL_BITS)
_SURE, _SAME = np.uint32(3), np.uint32(4)
#: What a probability of ``TOTAL`` moves to after a miss and after a hit, so that neither is ever impossible.
_GOALS = np.array([31, TOTAL - 17], np.int32)
_STEPS = np.array([-1, 1], np.int32)
#: The table counts as so many ids of the block. When table and block are so many together, the block's are halved.
_PRIOR, _MOST = 128, 255
#: The bits of a class below each level.
_LEVELS = 3, 0
_BYTE, _LAST, _HALF = np.uint64(8), np.uint64(255), np.uint64(0x7F7F7F7F7F7F7F7F)
#: The sum of eight bytes is the first byte of a product. What an id of a branch adds to a word.
_ONES, _TOP = np.uint64(0x0101010101010101), np.uint64(56)
_ADDED = np.array([0x0101010101010101 << 8 * i & 2**64 - 1 for i in range(8)], np.uint64)


def even_shares() -> np.ndarray:
    """Shares for ids of which nothing is known."""
    return np.ones(1 << 16, np.uint32)


def shares_of(ids: np.ndarray) -> np.ndarray:
    """The share of each id below 65536 of a power of two, by how often it comes; at least 1 for each that comes."""
    counts = np.bincount(ids, minlength=1 << 16)
    kinds = np.count_nonzero(counts)
    total = 1 << (16 if kinds <= 4096 else 18)
    shares = counts * (total - kinds) // max(1, len(ids)) + (counts > 0)
    shares[np.argmax(counts)] += total - shares.sum()
    return shares.astype(np.uint32)


class _Lanes:
    """The models of a number of blocks, all after the same number of ids. Predictions are kept as id * 4 + certainty."""

    def __init__(self, lanes: int, table: _Table | None = None):
        self.n = lanes
        self.slot = np.arange(lanes) * _SLOTS
        self.first2 = np.arange(lanes) * _CHANCES
        self.first1 = self.first2 + 8
        self.after2, self.after1 = np.zeros(lanes * _SLOTS, np.uint32), np.zeros(lanes * _SLOTS, np.uint32)
        self.key, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.chances = np.full(lanes * _CHANCES, TOTAL // 8, np.int32)
        self.weight = np.full(lanes, 8, np.int32)
        self.past = np.zeros(lanes, np.int64)
        self.priors = (_table(even_shares().tobytes()) if table is None else table).priors
        for level, prior in enumerate(self.priors):
            setattr(self, f"word{level}", np.arange(lanes) * len(prior))
            setattr(self, f"sums{level}", np.tile(prior, lanes))
        self.counted = _PRIOR

    def shrink(self) -> None:
        """Leaves out the last block, which has ended."""
        n = self.n - 1
        for name, value in vars(self).items():
            if isinstance(value, np.ndarray) and value.ndim == 1:
                setattr(self, name, value[: len(value) // self.n * n])
        self.n = n

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """The predictions, and the probability of each out of ``TOTAL``."""
        self.at2 = ((self.key + self.before) >> 9 & _SLOTS - 1) + self.slot
        self.at1 = (self.key >> 9 & _SLOTS - 1) + self.slot
        self.two, self.one = self.after2.take(self.at2), self.after1.take(self.at1)
        self.c2, self.c1 = self.two & _SURE, self.one & _SURE
        self.at = np.empty((2, self.n), np.int64)
        np.add(self.first2, self.c2 + ((self.one ^ self.two) < _SAME) * _SAME, out=self.at[0])
        np.add(self.first1, self.c1 + self.past, out=self.at[1])
        self.rows = self.chances.take(self.at)
        mixed = self.rows[0] - self.rows[1]
        mixed *= self.weight
        mixed >>= 4
        mixed += self.rows[1]
        return np.where(self.c2 > 0, self.two, self.one) >> np.uint32(2), mixed.astype(np.uint64)

    def levels(self) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """Of each level the words, where those of each block begin, and the bits of a class below."""
        return [(getattr(self, f"sums{level}"), getattr(self, f"word{level}"), bits) for level, bits in enumerate(_LEVELS)]

    def branches(self, c: np.ndarray, of: np.ndarray | None = None) -> list[tuple[np.ndarray, ...]]:
        """On each level the place of the word of a class of each block, or each ``of`` some, the word, and the branch."""
        found = []
        for sums, first, bits in self.levels():
            at = c >> bits + 3
            at += first if of is None else first.take(of)
            branch = c >> bits
            branch &= 7
            found.append((at, sums.take(at), branch))
        return found

    def find(self, place: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
        """The class at a place of order 0, which is below ``counted``, and its branches."""
        c, found = np.zeros(self.n, np.int64), []
        for sums, first, _ in self.levels():
            at = first + c
            word = sums.take(at)
            lower = word << _BYTE
            branch = (lower.view(np.uint8) <= (place * _ONES).view(np.uint8)).view(np.uint64)
            branch *= _ONES
            branch >>= _TOP
            branch -= np.uint64(1)
            found.append((at, word, branch.view(np.int64)))
            c <<= 3
            c += found[-1][2]
            lower >>= branch << np.uint64(3)
            lower &= _LAST
            place = place - lower
        return c, found

    def count(self, branches: list[tuple[np.ndarray, ...]]) -> None:
        """Adds an id of each block to order 0."""
        self.counted += 1
        for (sums, _, _), prior, (at, word, branch) in zip(self.levels(), self.priors, branches, strict=True):
            word += _ADDED.take(branch)
            sums[at] = word
            if self.counted == _MOST:
                rows = sums.reshape(-1, len(prior))
                rows -= prior
                rows >>= np.uint64(1)
                rows &= _HALF
                rows += prior
        if self.counted == _MOST:
            self.counted = _PRIOR + (_MOST - _PRIOR >> 1)

    def learn(self, x: np.ndarray, hit: np.ndarray) -> None:
        """A prediction that held is surer by one, up to 3; one that failed is replaced."""
        hit = hit.view(np.uint8)
        better = (self.rows[0] > self.rows[1]).view(np.uint8) ^ hit ^ np.uint8(1)
        self.weight += _STEPS.take(better)
        np.maximum(self.weight, 1, out=self.weight)
        np.minimum(self.weight, 15, out=self.weight)
        self.rows += (_GOALS.take(hit) - self.rows) >> 4
        self.chances[self.at] = self.rows
        self.past >>= 1
        self.past &= 4
        self.past += hit << np.uint8(3)
        x4 = x.astype(np.uint32) << np.uint32(2)
        for old, c, table, at in ((self.two, self.c2, self.after2, self.at2), (self.one, self.c1, self.after1, self.at1)):
            held = (old ^ x4) < _SAME
            c += np.uint32(1)
            np.minimum(c, _SURE, out=c)
            c *= held
            c += x4
            table[at] = c
        self.before = self.key >> 1
        self.key = x * np.int64(40503)


class _Words:
    """Code words of all blocks, each in a column of its own, as they are written."""

    def __init__(self, lanes: int, ids: int):
        self.n = lanes
        self.data = np.zeros((2 * ids + 8) * lanes, np.uint16)
        self.ends = np.arange(lanes)

    def put(self, lanes: np.ndarray, low: np.ndarray) -> None:
        at = self.ends.take(lanes)
        self.data[at] = low >> np.uint64(48)
        self.ends[lanes] = at + self.n

    def carry(self, lanes: np.ndarray) -> None:
        """Adds one to the words written so far."""
        at = self.ends.take(lanes) - self.n
        while len(at):
            raised = self.data.take(at) + np.uint16(1)
            self.data[at] = raised
            at = at[raised == 0] - self.n

    def codes(self) -> list[bytes]:
        sizes = (self.ends // self.n).tolist()
        rows = np.ascontiguousarray(self.data.reshape(-1, self.n)[: max(sizes)].T).astype("<u2", copy=False)
        return [row[:size].tobytes() for row, size in zip(rows, sizes, strict=True)]


class _Table:
    """Shares of ids: where each begins, and the same of the classes of ids."""

    def __init__(self, shares: np.ndarray):
        self.shares = shares.astype(np.uint64)
        ends = np.cumsum(self.shares)
        self.begins, self.total = ends - self.shares, int(ends[-1])
        middle = (self.begins + (self.shares >> np.uint64(1))).view(np.int64)
        self.classes = np.minimum((middle << 6) // self.total, 63)
        first = np.searchsorted(self.classes, np.arange(65))
        edges = np.append(self.begins, np.uint64(self.total)).take(first)
        # A class without ids is never coded, but a damaged block can come to one.
        self.class_begins, self.class_shares = edges[:-1], np.maximum(np.diff(edges), np.uint64(1))
        self.inner = self.begins - self.class_begins.take(self.classes)
        parts = _parts(np.diff(edges).view(np.int64)).reshape(8, 8)
        self.priors = [np.cumsum(x, axis=-1).astype(np.uint8).view(np.uint64).ravel() for x in (parts.sum(axis=1), parts)]


def _parts(shares: np.ndarray) -> np.ndarray:
    """``_PRIOR`` dealt by the shares of classes, at least 1 to each that has any."""
    exact = shares * (_PRIOR / shares.sum())
    parts = np.maximum(exact.astype(np.int64), shares > 0)
    while (left := _PRIOR - int(parts.sum())) != 0:
        parts[np.argmax(exact - parts) if left > 0 else np.argmax(np.where(parts > 1, parts - exact, -_PRIOR))] += 1 if left > 0 else -1
    return parts


def _places(branches: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Where classes begin in order 0, and how much of it they have, of ``counted`` in all."""
    before = np.uint64(0)
    for _, word, branch in branches:
        bits = (branch << 3).view(np.uint64)
        lower = word << _BYTE
        lower >>= bits
        lower &= _LAST
        before = before + lower
    return before, (word >> bits & _LAST) - lower


@lru_cache(maxsize=2)
def _table(shares: bytes) -> _Table:
    return _Table(np.frombuffer(shares, np.uint32))


def encode_blocks(blocks: list[np.ndarray], shares: np.ndarray | None = None) -> list[bytes]:
    """Codes blocks of ids below 65536. All but the last must have one length, the last can be shorter.

    ``shares`` must have one for each id that comes. An id takes at most 8 bits for the prediction and 21 from order 0, fewer
    than the 48 of the narrowest interval, and so at most two words.
    """
    table = _table((even_shares() if shares is None else shares).tobytes())
    n = len(blocks)
    length = len(blocks[0])
    ids = np.zeros((n, length), np.uint16)
    for i, block in enumerate(blocks):
        ids[i, : len(block)] = block
    ids = np.ascontiguousarray(ids.T)
    lanes, words = _Lanes(n, table), _Words(n, length)
    low, width = np.zeros(n, np.uint64), np.full(n, 2**64 - 1, np.uint64)
    for step in range(length):
        if step == len(blocks[-1]):
            lanes.shrink()
            shown = low
            low, width = low[:-1], width[:-1]
            ids = ids[:, :-1]
        x = ids[step]
        guess, chance = lanes.predict()
        hit = guess == x
        chance *= width >> _UNIT
        width -= chance
        place = x.astype(np.int64)
        c = table.classes.take(place)
        branches = lanes.branches(c)
        move, size = _places(branches)
        unit = width // np.uint64(lanes.counted)
        move *= unit
        move += chance
        unit *= size
        unit //= table.class_shares.take(c)
        move += table.inner.take(place) * unit
        unit *= table.shares.take(place)
        width = np.where(hit, chance, unit)
        move *= ~hit
        low += move
        over = np.flatnonzero(low < move)
        if len(over):
            words.carry(over)
        lanes.count(branches)
        lanes.learn(x, hit)
        at = np.flatnonzero(width < _FULL)
        while len(at):
            l, w = low.take(at), width.take(at)
            words.put(at, l)
            w <<= _WORD
            low[at], width[at] = l << _WORD, w
            at = at[w < _FULL]
    if len(blocks[-1]) < length:
        low = shown
    for _ in range(4):
        words.put(np.arange(n), low)
        low = low << _WORD
    return words.codes()


def decode_blocks(data: list[bytes], lengths: list[int], shares: np.ndarray | None = None) -> list[np.ndarray]:
    """The ids of coded blocks, of which all but the last have one length."""
    table = _table((even_shares() if shares is None else shares).tobytes())
    drawn = np.repeat(np.arange(1 << 16, dtype=np.uint16), table.shares.view(np.int64))
    n, length = len(data), lengths[0]
    flat = np.frombuffer(b"".join(data) + bytes(8), "<u2")
    at = np.cumsum([0, *(len(d) // 2 for d in data[:-1])])
    left = np.zeros(n, np.uint64)  # how far the code lies into its interval
    for _ in range(4):
        left = left << _WORD | flat[np.minimum(at, len(flat) - 1)]
        at = at + 1
    out = np.zeros((length, n), np.uint16)
    lanes, width = _Lanes(n, table), np.full(n, 2**64 - 1, np.uint64)
    for step in range(length):
        if step == lengths[-1]:
            lanes.shrink()
            left, width, at = left[:-1], width[:-1], at[:-1]
        guess, chance = lanes.predict()
        chance *= width >> _UNIT
        hit = left < chance
        width -= chance
        rest = left - chance
        width //= np.uint64(lanes.counted)
        c, branches = lanes.find(np.minimum(rest // width, np.uint64(lanes.counted - 1)))
        move, size = _places(branches)
        rest -= move * width
        width *= np.maximum(size, np.uint64(1))
        inside = table.class_shares.take(c)
        width //= inside
        # In a damaged block the place can lie behind the class or the table; the checksum tells.
        inside -= np.uint64(1)
        x = drawn.take((table.class_begins.take(c) + np.minimum(rest // width, inside)).view(np.int64), mode="clip")
        drawn_at = x.astype(np.int64)
        rest -= table.inner.take(drawn_at) * width
        width *= table.shares.take(drawn_at)
        left = np.where(hit, left, rest)
        width = np.where(hit, chance, width)
        x = np.where(hit, guess, x)
        out[step, : lanes.n] = x
        met = np.flatnonzero(hit)
        for old, new in zip(branches, lanes.branches(table.classes.take(x.take(met)), met), strict=True):
            for values, right in zip(old, new, strict=True):
                values[met] = right
        lanes.count(branches)
        lanes.learn(x, hit)
        low = np.flatnonzero(width < _FULL)
        while len(low):
            places, w = at.take(low), width.take(low)
            w <<= _WORD
            left[low] = left.take(low) << _WORD | flat.take(places, mode="clip")
            width[low], at[low] = w, places + 1
            low = low[w < _FULL]
    out = np.ascontiguousarray(out.T)
    return [out[i, :m] for i, m in enumerate(lengths)]
