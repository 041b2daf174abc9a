"""Suffix order by induced sorting, with bucket queues that go to disk.

Suffixes are grouped in queues by first symbol. The leftmost-S (LMS) suffixes are ordered first; L suffixes
are then induced from the smallest up and S suffixes from the largest down: taking a suffix off its queue
sends the one before it, as a (position, symbol) tuple, to the queue of its own first symbol, where tuples wait in order of arrival.
All of a queue's tuples move as arrays. LMS suffixes are ordered by one induction over their substrings, which names them, and a recursion
over the names, bounded by the depth asked for. Queues and order beyond ``memory`` items live in files.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

#: Items that queues keep in memory together before they spill.
MEMORY = 1 << 24


class BucketQueues:
    """First-in first-out arrays by symbol; the largest go to files once all hold more than ``memory`` items."""

    def __init__(self, symbols: int, memory: int, folder: str | None = None):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(symbols)]
        self.sizes = [0] * symbols
        self.held = 0
        self.spilled: dict[int, int] = {}
        self.memory, self.folder, self.own = memory, folder, None

    def _file(self, symbol: int) -> str:
        if self.own is None:
            self.own = tempfile.mkdtemp(prefix="queues-", dir=self.folder)
        return os.path.join(self.own, f"{symbol}.i64")

    def push(self, symbol: int, items: np.ndarray) -> None:
        if len(items):
            self.parts[symbol].append(items)
            self.sizes[symbol] += len(items)
            self.held += len(items)
            if self.held > self.memory:
                self._spill()

    def _spill(self) -> None:
        for symbol in np.argsort(-np.array(self.sizes), kind="stable").tolist():
            if self.held <= self.memory // 2 or not self.sizes[symbol]:
                break
            with open(self._file(symbol), "ab") as f:
                for part in self.parts[symbol]:
                    f.write(part.astype(np.int64).tobytes())
            self.spilled[symbol] = self.spilled.get(symbol, 0) + self.sizes[symbol]
            self.held -= self.sizes[symbol]
            self.parts[symbol], self.sizes[symbol] = [], 0

    def take(self, symbol: int):
        """All that waits for a symbol, in order of arrival, as arrays of at most ``memory`` items."""
        n = self.spilled.pop(symbol, 0)
        if n:
            with open(self._file(symbol), "rb") as f:
                while raw := f.read(8 * max(1, self.memory // 4)):
                    yield np.frombuffer(raw, np.int64)
            os.remove(self._file(symbol))
        parts, self.parts[symbol] = self.parts[symbol], []
        self.held -= self.sizes[symbol]
        self.sizes[symbol] = 0
        if parts:
            yield np.concatenate(parts) if len(parts) > 1 else parts[0]

    def close(self) -> None:
        if self.own:
            shutil.rmtree(self.own, ignore_errors=True)


def s_types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next (S); the last suffix is S."""
    n = len(text)
    out = np.ones(n, bool)
    if n > 1:
        differ = np.flatnonzero(text[:-1] != text[1:])
        smaller = text[:-1][differ] < text[1:][differ]
        nxt = np.searchsorted(differ, np.arange(n - 1))
        out[:-1] = np.append(smaller, True)[nxt]
    return out


def _send(queues: BucketQueues, before: np.ndarray, symbols: np.ndarray) -> None:
    """Deal positions to their symbols' queues, keeping their order."""
    if not len(before):
        return
    by = np.argsort(symbols, kind="stable")
    cuts = np.flatnonzero(np.diff(symbols[by])) + 1
    firsts = symbols[by][np.concatenate([[0], cuts])]
    for symbol, part in zip(firsts.tolist(), np.split(before[by], cuts)):
        queues.push(symbol, part)


def induce(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray, symbols: int, memory: int = MEMORY, folder: str | None = None):
    """Arrays of suffix positions in ascending order, given the LMS suffixes in order (by symbol first).

    ``text`` is over 0..symbols-1 and ends with its only smallest symbol or an LMS-typed end.
    """
    lower, upper, ordered = (BucketQueues(symbols, memory, folder) for _ in range(3))
    final = BucketQueues(symbols, memory, folder)
    try:
        _send(ordered, lms, text[lms].astype(np.int64))
        large = BucketQueues(symbols, memory, folder)  # L suffixes by symbol, in order
        for c in range(symbols):
            while True:  # a run of one symbol feeds its own queue
                moved = list(lower.take(c))
                if not moved:
                    break
                for items in moved:
                    large.push(c, items)
                    prev = items[items > 0] - 1
                    prev = prev[~is_s[prev]]
                    _send(lower, prev, text[prev].astype(np.int64))
            for items in ordered.take(c):
                prev = items[items > 0] - 1
                prev = prev[~is_s[prev]]
                _send(lower, prev, text[prev].astype(np.int64))
        tail = len(text) - 1
        for c in range(symbols - 1, -1, -1):
            small: list[np.ndarray] = []
            first = np.array([tail], lms.dtype) if c == text[tail] and is_s[tail] else None
            while True:
                moved = list(upper.take(c))
                if not moved:
                    break
                for items in moved:
                    small.append(items)
                    prev = items[items > 0] - 1
                    prev = prev[is_s[prev]]
                    _send(upper, prev, text[prev].astype(np.int64))
            if first is not None:
                small.append(first)
            ls = list(large.take(c))
            for items in reversed(ls):
                back = items[::-1]
                prev = back[back > 0] - 1
                prev = prev[is_s[prev]]
                _send(upper, prev, text[prev].astype(np.int64))
            if first is not None:
                prev = first[first > 0] - 1
                prev = prev[is_s[prev]]
                _send(upper, prev, text[prev].astype(np.int64))
            for items in ls:
                final.push(c, items)
            for items in reversed(small):
                final.push(c, items[::-1])
        large.close()
        for c in range(symbols):
            yield from final.take(c)
    finally:
        for q in (lower, upper, ordered, final):
            q.close()


def _name(text: np.ndarray, lms_sorted: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings, by position order, and how many differ; ``lms_sorted`` orders the substrings."""
    size = np.append(np.diff(lms) + 1, 1)
    where = np.searchsorted(lms, lms_sorted)
    length = size[where]
    same = np.zeros(len(lms_sorted), bool)
    same[1:] = length[1:] == length[:-1]
    active = np.flatnonzero(same)
    j = 0
    while len(active):
        equal = text[lms_sorted[active] + j] == text[lms_sorted[active - 1] + j]
        same[active[~equal]] = False
        active = active[equal]
        j += 1
        active = active[length[active] > j]
    rank = np.cumsum(~same) - 1
    names = np.empty(len(lms), np.int64)
    names[where] = rank
    return names, int(rank[-1]) + 1


def _order_names(names: np.ndarray, count: int, depth: int) -> np.ndarray:
    """Order of the suffixes of the name string to ``depth`` names, by doubling; ties stay by position."""
    rank, n, k = names, len(names), 1
    order = np.argsort(rank, kind="stable")
    while count < n and k < depth:
        nxt = np.zeros(n, np.int64)
        nxt[: n - k] = rank[k:] + 1
        key = rank * (count + 1) + nxt
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        rank, count, k = new, int(new[order[-1]]) + 1, 2 * k
    return order


def suffix_order(text: np.ndarray, symbols: int, depth: int = 1 << 62, memory: int = MEMORY, folder: str | None = None):
    """Yield arrays of all positions of ``text`` in suffix order, right to ``depth`` symbols at least.

    The last symbol must be smaller than all others or the text one symbol long. A reduced string of names over few symbols
    recurses; over many it is ordered by doubling.
    """
    n = len(text)
    if n <= 2:
        yield np.array(sorted(range(n), key=lambda i: tuple(text[i:])), np.int64)
        return
    is_s = s_types(text)
    lms = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32 if n < 1 << 31 else np.int64)
    if len(lms) > 1:
        rough = lms[np.argsort(text[lms], kind="stable")]
        marked = np.zeros(n, bool)
        marked[lms] = True
        substrings = np.concatenate([items[marked[items]] for items in induce(text, is_s, rough, symbols, memory, folder)])
        names, count = _name(text, substrings, lms)
        if count < len(names):
            if count <= 1 << 10 and names[-1] == 0 and (names == 0).sum() == 1:
                order = np.concatenate(list(suffix_order(names, count, depth // 2 + 1, memory, folder)))
            else:
                order = _order_names(names, count, depth // 2 + 1)
            lms = lms[order]
        else:
            lms = substrings
    yield from induce(text, is_s, lms, symbols, memory, folder)
