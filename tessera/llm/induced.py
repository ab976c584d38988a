"""External induced sorting of the suffixes of one shard, with common prefixes, for ``substrings``.

Suffixes are induced from the sorted LMS suffixes, first those of type L upwards, then those of type S downwards. The
queue between is one first-in-first-out run for each symbol: pushes come in order, so a run needs no sorting, and the
least symbol's run is the queue's head. Runs beyond a budget of memory go to a file of the task's own, which is removed
when the task ends. The reduced string of LMS names is sorted first, by recursion on pairs of names (its alphabet is too
large for a run for each symbol).
"""

from __future__ import annotations

import tempfile

import numpy as np


class RunQueue:
    """A monotone priority queue of suffix positions by symbol; arrays pushed to a symbol are popped in their order."""

    def __init__(self, symbols: int, budget: int = 32_000_000):
        self.runs: list[list] = [[] for _ in range(symbols)]
        self.budget, self.held, self.file = budget, 0, None

    def push(self, symbol: int, positions: np.ndarray) -> None:
        self.runs[symbol].append(positions)
        self.held += len(positions)
        if self.held > self.budget:
            self.spill()

    def push_all(self, symbols: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(symbols, kind="stable")
        symbols, positions = symbols[order], positions[order]
        cuts = np.flatnonzero(np.diff(symbols)) + 1
        for s, p in zip(symbols[np.concatenate([[0], cuts])] if len(symbols) else (), np.split(positions, cuts), strict=False):
            self.push(int(s), p)

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for run in self.runs:
            for i, x in enumerate(run):
                if isinstance(x, np.ndarray):
                    self.file.seek(0, 2)
                    at = self.file.tell()
                    self.file.write(x.astype(np.int64).tobytes())
                    run[i] = (at, len(x))
        self.held = 0

    def pop(self, symbol: int) -> np.ndarray:
        parts = []
        for x in self.runs[symbol]:
            if isinstance(x, tuple):
                self.file.seek(x[0])
                parts.append(np.frombuffer(self.file.read(8 * x[1]), np.int64))
            else:
                self.held -= len(x)
                parts.append(x)
        self.runs[symbol] = []
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``names``, told apart by their first ``depth`` names at least."""
    rank, step = names.astype(np.int64), 1
    n = len(rank)
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank, step = fresh, 2 * step
        if step >= depth or rank.max() == n - 1:
            return np.argsort(rank, kind="stable")


def _induce(text: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array from the LMS positions in order."""
    n = len(text)
    queue, out_l = RunQueue(symbols), [[] for _ in range(symbols)]
    seed_runs = RunQueue(symbols)
    seed_runs.push_all(text[seeds], seeds)
    for c in range(symbols):
        now = queue.pop(c)
        while len(now):
            out_l[c].append(now)
            before = now[now > 0] - 1
            before = before[~is_s[before]]
            same = text[before] == c
            queue.push_all(text[before[~same]], before[~same])
            now = before[same]
        own = seed_runs.pop(c)
        before = own[own > 0] - 1
        before = before[~is_s[before]]
        queue.push_all(text[before], before)
    down, out_s = RunQueue(symbols), [[] for _ in range(symbols)]
    for c in range(symbols - 1, -1, -1):
        now = down.pop(c)
        while len(now):
            out_s[c].append(now)
            before = now[now > 0] - 1
            before = before[is_s[before]]
            same = text[before] == c
            down.push_all(text[before[~same]], before[~same])
            now = before[same]
        for part in reversed(out_l[c]):
            rev = part[::-1]
            before = rev[rev > 0] - 1
            before = before[is_s[before]]
            down.push_all(text[before], before)
    for q in (queue, seed_runs, down):
        q.close()
    parts = []
    for c in range(symbols):
        parts += out_l[c]
        parts += [p[::-1] for p in reversed(out_s[c])]
    found = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return np.concatenate([[n - 1], found[found != n - 1]])


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (symbols from 1, closed here by a least symbol 0) in the order of their first ``depth`` symbols."""
    t = np.concatenate([text, [0]]).astype(np.int64)
    n, symbols = len(t), int(t.max()) + 1
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()))
    step = np.sign(np.diff(t))
    # the type of a suffix is told by the next change of symbol
    at = np.where(step != 0, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    is_s = np.ones(n, bool)
    is_s[:-1] = step[np.minimum(nxt, n - 2)] > 0
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(lms) > 1:
        first = _induce(t, is_s, lms, symbols)
        order = first[np.isin(first, lms, assume_unique=True)] if len(lms) * 4 < n else first[_member(lms, n)[first]]
        length = np.zeros(n, np.int64)
        length[lms[:-1]] = np.diff(lms) + 1
        length[lms[-1]] = 1
        h = _prefix_hash(t)
        same = (length[order[1:]] == length[order[:-1]]) & (_hash_of(h, order[1:], length[order[1:]]) == _hash_of(h, order[:-1], length[order[:-1]]))
        name = np.empty(n, np.int64)
        name[order] = np.concatenate([[0], np.cumsum(~same)])
        lms = lms[_doubling(name[lms], depth)]
    return _induce(t, is_s, lms, symbols)


def _member(some: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[some] = True
    return out


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    if len(_powers[0]) < n:
        x = np.full(max(n, 1 << 16), _BASE, np.uint64)
        x[0] = 1
        _powers[0] = np.multiply.accumulate(x)
    return _powers[0]


def _prefix_hash(t: np.ndarray) -> np.ndarray:
    """Sums of the symbols times falling powers, so that a stretch's hash follows from two of them."""
    p = powers(len(t) + 1)
    mixed = (t.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * p[: len(t)])])


def _hash_of(h: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of each stretch; multiplying by a power brings all to the same exponent."""
    p = powers(len(h) + 1)
    return (h[at + length] - h[at]) * p[len(h) - 1 - at]


def repeated(parts: list[bytes], starts: list[int], width: int) -> list[np.ndarray]:
    """For each part, which of its first ``starts[i]`` positions begin a string of ``width`` bytes that begins at another
    such position of any part as well."""
    lengths = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    text = np.frombuffer(b"".join(p + b"\0" for p in parts), np.uint8).astype(np.int64) + 2
    ends = np.cumsum(lengths)
    text[ends - 1] = 1
    begin = ends - lengths
    asked = np.zeros(len(text) + 1, bool)
    for b, k in zip(begin, starts, strict=True):
        asked[b : b + k] = True
    sa = suffix_array(text, width)
    sa = sa[asked[sa]]
    h = _prefix_hash(text)
    wide = np.full(len(sa), width)
    value = _hash_of(h, sa, wide) if len(sa) else np.zeros(0, np.uint64)
    raw = text.astype(np.int16).tobytes()
    equal = value[1:] == value[:-1]
    for i in np.flatnonzero(equal):  # what the hashes say is read once more
        a, b = int(sa[i]), int(sa[i + 1])
        equal[i] = raw[2 * a : 2 * (a + width)] == raw[2 * b : 2 * (b + width)]
    hit = np.zeros(len(sa), bool)
    hit[1:] |= equal
    hit[:-1] |= equal
    out = np.zeros(len(text) + 1, bool)
    out[sa[hit]] = True
    return [out[b : b + k] for b, k in zip(begin, starts, strict=True)]


def repeated_by_hash(parts: list[bytes], starts: list[int], width: int) -> list[np.ndarray]:
    """As ``repeated``, for a shard too large to sort in memory: windows are told by a hash, 8 bytes for each, and those
    whose hashes meet are compared as bytes."""
    longest = max(map(len, parts), default=0)
    p = powers(longest + 2)
    values, total = [], np.concatenate([[0], np.cumsum(starts)])
    for part, k in zip(parts, starts, strict=True):
        h = _prefix_hash(np.frombuffer(part, np.uint8))
        at = np.arange(k)
        values.append((h[at + width] - h[at]) * p[longest - at])
    value = np.concatenate(values) if values else np.zeros(0, np.uint64)
    order = np.argsort(value, kind="stable")
    meets = np.flatnonzero(value[order[1:]] == value[order[:-1]])
    hit = np.zeros(len(value), bool)
    owner = np.searchsorted(total, order, side="right") - 1
    for i in meets.tolist():
        (a, b), (x, y) = (owner[i], owner[i + 1]), (order[i], order[i + 1])
        u, v = int(x - total[a]), int(y - total[b])
        if parts[a][u : u + width] == parts[b][v : v + width]:
            hit[x] = hit[y] = True
    return [hit[total[i] : total[i + 1]] for i in range(len(parts))]
