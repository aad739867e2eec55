"""Suffix sorting by induction, with disk-backed queues.

Suffixes whose symbol is smaller than the next are S, the others L; an S suffix after an L one is a seed. From sorted
seeds all L suffixes follow in one ascending sweep and then all S suffixes in one descending sweep: the suffix before a
popped one goes into the queue of its first symbol, and as suffixes are popped in order, every queue is filled in order.
So the priority queue is one append-only run for each symbol, and what exceeds the memory limit goes to a file and is
read back in sequence. The seeds are sorted by naming the stretches between them (by one more pair of sweeps) and
sorting the string of names in the same way; when nearly all names differ, ranks are doubled instead. Only the first
``depth`` symbols have to be in order, which bounds the doubling.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Queue entries (8 bytes each) that stay in memory.
IN_MEMORY = 4_000_000
#: Queue entries that are taken at a time, about.
BLOCK = 1_000_000
#: Symbols at most for which the sweeps beat doubling, as a share of the string.
NARROW = 64


class Queues:
    """A monotone priority queue: an append-only run of positions for each symbol, partly in a file."""

    def __init__(self, folder: str | None, in_memory: int):
        self.file = tempfile.TemporaryFile(dir=folder)
        self.in_memory, self.held = in_memory, 0
        self.runs: dict[int, list] = {}

    def push(self, positions: np.ndarray, symbols: np.ndarray) -> None:
        if not len(positions):
            return
        order = np.argsort(symbols, kind="stable")
        ranked = symbols[order]
        cuts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])).tolist()
        parts = positions[order]
        for lo, hi in zip(cuts, cuts[1:] + [len(parts)]):
            self.runs.setdefault(int(ranked[lo]), []).append(parts[lo:hi])
        self.held += len(parts)
        if self.held > self.in_memory:
            self._spill()

    def _spill(self) -> None:
        at = self.file.seek(0, 2)
        for run in self.runs.values():
            for k, part in enumerate(run):
                if isinstance(part, np.ndarray):
                    self.file.write(part.tobytes())
                    run[k] = (at, len(part))
                    at += part.nbytes
        self.held = 0

    def _read(self, part) -> np.ndarray:
        if isinstance(part, np.ndarray):
            return part
        self.file.seek(part[0])
        return np.frombuffer(self.file.read(8 * part[1]), np.int64)

    def forward(self, symbol: int) -> Iterator[np.ndarray]:
        """The run in order, in blocks of neighbouring parts, with what is pushed meanwhile."""
        k = 0
        while k < len(run := self.runs.get(symbol, ())):
            parts, held = [], 0
            while k < len(run) and held < BLOCK:
                parts.append(self._read(run[k]))
                held += len(parts[-1])
                k += 1
            yield np.concatenate(parts)

    def backward(self, symbol: int) -> Iterator[np.ndarray]:
        run = self.runs.get(symbol, [])
        k = len(run)
        while k:
            parts, held = [], 0
            while k and held < BLOCK:
                k -= 1
                parts.append(self._read(run[k])[::-1])
                held += len(parts[-1])
            yield np.concatenate(parts)

    def close(self) -> None:
        self.file.close()


def _types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is S; the last symbol is the smallest and stands once."""
    up = np.empty(len(s), bool)
    up[-1] = True
    change = np.flatnonzero(s[1:] != s[:-1])  # the last place of each run of equal symbols
    rises = s[change] < s[change + 1]
    up[:-1] = np.repeat(rises, np.diff(np.concatenate([[-1], change])))
    return up


def _sweep(s: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, folder: str | None, in_memory: int) -> np.ndarray:
    """All suffixes in the order that the order of the seeds induces."""
    large, small, start = (Queues(folder, in_memory) for _ in range(3))
    try:
        start.push(seeds, s[seeds])
        symbols = np.unique(s).tolist()

        def induce(block, queue, wanted):
            before = block[block > 0] - 1
            before = before[is_s[before] == wanted]
            queue.push(before, s[before])

        for c in symbols:
            for block in large.forward(c):
                induce(block, large, False)
            for block in start.forward(c):
                induce(block, large, False)
        small.push(np.array([len(s) - 1]), s[-1:])
        for c in reversed(symbols):
            for block in small.forward(c):
                induce(block, small, True)
            for block in large.backward(c):
                induce(block, small, True)
        return np.concatenate([b for c in symbols for b in (*large.forward(c), *small.backward(c))])
    finally:
        for q in (large, small, start):
            q.close()


def _names(s: np.ndarray, is_seed: np.ndarray, seeds: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Numbers for the stretches from seed to seed, in text order, that rise with the stretches."""
    ends = np.full(len(s), len(s) - 1)
    ends[seeds[:-1]] = seeds[1:]
    ranked = order[is_seed[order]]
    a, b = ranked[:-1], ranked[1:]
    length = ends[a] - a
    same = (length == ends[b] - b) & (a != len(s) - 1) & (b != len(s) - 1)
    pairs, k = np.flatnonzero(same), 0
    while len(pairs):
        differ = s[a[pairs] + k] != s[b[pairs] + k]
        same[pairs[differ]] = False
        pairs = pairs[~differ & (length[pairs] > k)]
        k += 1
    named = np.empty(len(s), np.int64)
    named[ranked] = np.concatenate([[0], np.cumsum(~same)])
    return named[seeds]


def _doubled(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols, by doubling the ranks of known prefixes."""
    rank, known = s.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while known < depth:
        after = np.full(len(rank), -1, np.int64)
        after[:-known] = rank[known:] if known < len(rank) else after[:-known]
        key = rank * (int(after.max()) + 2) + after + 1
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if rank[order[-1]] == len(rank) - 1:
            break
        known *= 2
    return order


def suffix_order(s: np.ndarray, depth: int, folder: str | None = None, in_memory: int = IN_MEMORY) -> np.ndarray:
    """The suffixes of ``s`` by their first ``depth`` symbols; ``s`` ends with a symbol smaller than all others."""
    if len(s) < 64 or len(np.unique(s)) > len(s) // NARROW:
        return _doubled(s, depth)
    is_s = _types(s)
    is_seed = np.zeros(len(s), bool)
    is_seed[1:] = is_s[1:] & ~is_s[:-1]
    seeds = np.flatnonzero(is_seed)
    names = _names(s, is_seed, seeds, _sweep(s, is_s, seeds, folder, in_memory))
    # seeds are at least two places apart
    ranked = seeds[suffix_order(names, depth // 2 + 1, folder, in_memory)]
    return _sweep(s, is_s, ranked, folder, in_memory)
