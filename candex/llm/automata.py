"""Weighted acyclic automata over sequences of numbers, all of one length.

States are shared: two states with the same arcs are one. Every arc carries how many sequences lie before it in its state,
and these outputs add up along a path to the sequence's place in sorted order, where its weight is. So an automaton is a
transducer from sequences to weights, and the weights do not hinder sharing. It is a few flat arrays, which can be sent
between tasks or mapped from a file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_HEAD = struct.Struct("<QQQQ")


@dataclass(frozen=True)
class Automaton:
    """Arcs sorted by state and label, as ``state << 32 | label``; state 0 is the end, ``root`` the start."""

    length: int
    root: int
    keys: np.ndarray
    targets: np.ndarray
    before: np.ndarray
    weights: np.ndarray

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.length, self.root, len(self.keys), len(self.weights))
        return head + b"".join(
            a.astype(kind).tobytes() for a, kind in zip((self.keys, self.before, self.weights, self.targets), ("<u8", "<i8", "<i8", "<u4"), strict=True)
        )

    @staticmethod
    def of(data: np.ndarray) -> Automaton:
        """The automaton in an array of bytes, which may be mapped from a file."""
        length, root, arcs, sequences = _HEAD.unpack(data[: _HEAD.size].tobytes())
        at, parts = _HEAD.size, []
        for kind, n in (("<u8", arcs), ("<i8", arcs), ("<i8", sequences), ("<u4", arcs)):
            size = n * np.dtype(kind).itemsize
            parts.append(np.asarray(data[at : at + size]).view(kind))
            at += size
        keys, before, weights, targets = parts
        return Automaton(length, root, keys, targets, before, weights)

    def places(self, rows: np.ndarray) -> np.ndarray:
        """The place of each row of labels in sorted order; -1 where the automaton does not hold it."""
        place = np.zeros(len(rows), np.int64)
        alive = np.arange(len(rows))
        state = np.full(len(rows), self.root, np.uint64)
        for step in range(self.length):
            key = state << np.uint64(32) | rows[alive, step].astype(np.uint64)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            at = at[hit]
            place[alive[~hit]] = -1
            alive = alive[hit]
            place[alive] += self.before[at]
            state = self.targets[at].astype(np.uint64)
        return place

    def rows(self, low: int, high: int) -> np.ndarray:
        """The sequences at the places ``low`` to ``high``, in order."""
        rest = np.arange(low, high)
        state = np.full(len(rest), self.root, np.uint64)
        firsts = np.searchsorted(self.keys, np.arange(self.root + 2, dtype=np.uint64) << np.uint64(32))
        out = np.empty((len(rest), self.length), np.int64)
        for step in range(self.length):
            # The last arc of the state with no more sequences before it than are left: one search in all states at once.
            first, last = firsts[state.astype(np.int64)], firsts[state.astype(np.int64) + 1] - 1
            while (first < last).any():
                middle = (first + last + 1) >> 1
                right = self.before[middle] <= rest
                first, last = np.where(right, middle, first), np.where(right, last, middle - 1)
            out[:, step] = (self.keys[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            rest = rest - self.before[first]
            state = self.targets[first].astype(np.uint64)
        return out


class Builder:
    """Builds an automaton from ascending sequences, block after block.

    The states of a block are frozen at once: from the longest prefixes to the shortest, each state is looked up by its arcs
    among those frozen before. Only the arcs of the root wait for the next block.
    """

    def __init__(self, length: int):
        self.length = length
        self.frozen: dict[bytes, int] = {}
        self.arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.degrees: list[np.ndarray] = []
        self.sizes = np.ones(1, np.int64)
        self.top: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        self.weights: list[np.ndarray] = []

    def _freeze(self, labels: np.ndarray, targets: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The state of each run of arcs."""
        ends = np.append(starts[1:], len(labels))
        flat = np.column_stack([labels, targets]).tobytes()
        out, fresh, frozen, n = [], [], self.frozen, len(self.frozen)
        for i, (start, end) in enumerate(zip((starts * 16).tolist(), (ends * 16).tolist(), strict=True)):
            key = flat[start:end]
            state = frozen.get(key)
            if state is None:
                n += 1
                state = frozen[key] = n
                fresh.append(i)
            out.append(state)
        if fresh:
            sizes = (ends - starts)[fresh]
            firsts = np.cumsum(sizes) - sizes
            arcs = np.repeat(starts[fresh] - firsts, sizes) + np.arange(sizes.sum())
            before = np.cumsum(counts[arcs]) - counts[arcs]
            self.arcs.append((labels[arcs], targets[arcs], before - np.repeat(before[firsts], sizes)))
            self.degrees.append(sizes)
            self.sizes = np.concatenate([self.sizes, np.add.reduceat(counts[arcs], firsts)])
        return np.array(out, np.int64)

    def add(self, rows: np.ndarray, weights: np.ndarray) -> None:
        """Takes sequences above all before; those that share their first label must come in one block."""
        if not len(rows):
            return
        self.weights.append(np.asarray(weights, np.int64))
        targets = np.zeros(len(rows), np.int64)
        for step in range(self.length - 1, 0, -1):
            fresh = np.append(True, (rows[1:, :step] != rows[:-1, :step]).any(axis=1))
            starts = np.flatnonzero(fresh)
            counts = self.sizes[targets]
            targets = self._freeze(rows[:, step], targets, counts, starts)
            rows = rows[starts]
        counts = self.sizes[targets]
        self.top = [np.concatenate(pair) for pair in zip(self.top, (rows[:, 0], targets, counts), strict=True)]

    def build(self) -> Automaton:
        labels, targets, counts = self.top
        root = len(self.sizes)
        arcs = [*self.arcs, (labels, targets, np.cumsum(counts) - counts)]
        state = np.repeat(np.arange(1, root + 1, dtype=np.uint64), np.concatenate([*self.degrees, [len(labels)]]).astype(np.int64))
        labels, targets, before = (np.concatenate([a[i] for a in arcs]) for i in range(3))
        weights = np.concatenate(self.weights) if self.weights else np.zeros(0, np.int64)
        return Automaton(self.length, root, state << np.uint64(32) | labels.astype(np.uint64), targets, before, weights)


def blocks(rows: np.ndarray, size: int = 1 << 18) -> Iterator[slice]:
    """Slices of sorted rows of about ``size``, cut where the first label changes."""
    cuts = np.append(np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1, len(rows))
    at = 0
    while at < len(rows):
        stop = cuts[min(np.searchsorted(cuts, at + size), len(cuts) - 1)]
        yield slice(at, int(stop))
        at = int(stop)


def build(rows: np.ndarray, weights: np.ndarray) -> Automaton:
    """The automaton of sorted, distinct rows."""
    builder = Builder(rows.shape[1])
    for part in blocks(rows):
        builder.add(rows[part], weights[part])
    return builder.build()


def _packed(rows: np.ndarray) -> list[np.ndarray]:
    """The columns of rows, two of them in each number, the first columns last as ``lexsort`` wants them."""
    wide = rows.astype(np.uint64)
    if wide.shape[1] % 2:
        wide = np.column_stack([np.zeros(len(wide), np.uint64), wide])
    return [wide[:, j] << np.uint64(32) | wide[:, j + 1] for j in range(wide.shape[1] - 2, -1, -2)]


def counted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in order, with how often each comes."""
    if rows.shape[1] > 2 or not len(rows):
        return summed(rows, np.ones(len(rows), np.int64))
    keys, counts = np.unique(_packed(rows)[0], return_counts=True)
    columns = [keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)][2 - rows.shape[1] :]
    return np.column_stack(columns).astype(rows.dtype), counts


def summed(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in order, with the sums of their weights. Labels are below 2^32."""
    if not len(rows):
        return rows, weights
    keys = _packed(rows)
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(rows), bool)
    new[1:] = False
    for key in keys:
        ahead = key[order]
        new[1:] |= ahead[1:] != ahead[:-1]
    starts = np.flatnonzero(new)
    return rows[order[starts]], np.add.reduceat(weights[order], starts)


def union(automata: list[Automaton]) -> tuple[np.ndarray, np.ndarray]:
    """The sequences of all automata in order, with the sums of their weights."""
    return summed(np.concatenate([a.rows(0, len(a.weights)) for a in automata]), np.concatenate([a.weights for a in automata]))
