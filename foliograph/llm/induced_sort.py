"""External induced sorting of suffixes with common-prefix values.

Suffixes that are smaller than both neighbours (LMS) are sorted first, by naming
the pieces between them and naming pairs of names recursively. All others are
induced: a scan in sorted order names each suffix's predecessor, which joins the
queue of its first byte. Queue entries are (suffix, value), where the value is
the length that the suffix shares with the entry before it: 1 plus the least
value passed since the last entry of that queue. Queues work in batches and
move to disk when they outgrow their memory. The text and its side arrays, some
30 bytes a byte, are in memory: the caller bounds the text.

Values are capped (``depth``): order and value beyond the cap don't matter here.
The disk files have no name (they vanish with the task, even when it is killed).
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes of queue entries held in memory.
MEMORY = 64 << 20
_INF = np.int32(1 << 30)


class Queues:
    """First-in-first-out queues of (suffix, value) by byte; the held part goes to disk when it is too large."""

    def __init__(self, keys: int, memory: int = MEMORY):
        self.memory, self.held, self.file = memory, 0, None
        self.chunks: list[list] = [[] for _ in range(keys)]

    def push(self, key: int, suffixes: np.ndarray, values: np.ndarray) -> None:
        self.chunks[key].append((suffixes, values))
        self.held += 12 * len(suffixes)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for chunks in self.chunks:
            for i, c in enumerate(chunks):
                if isinstance(c[0], np.ndarray):
                    at = self.file.seek(0, 2)
                    c[0].tofile(self.file)
                    c[1].tofile(self.file)
                    chunks[i] = (at, len(c[0]))
        self.held = 0

    def take(self, key: int):
        """All entries of a queue, in order; the queue is empty then."""
        chunks, self.chunks[key] = self.chunks[key], []
        got = []
        for a, b in chunks:
            if isinstance(a, np.ndarray):
                self.held -= 12 * len(a)
                got.append((a, b))
            else:
                self.file.seek(a)
                s = np.fromfile(self.file, np.int64, b)
                got.append((s, np.fromfile(self.file, np.int32, b)))
        if not got:
            return None
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


def suffix_types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smaller than the next suffix, length of the run of one byte from here); the last is smaller."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])  # place before a change
    nxt = np.full(n, n - 1, np.int64)
    nxt[differs] = differs
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]  # last place of the run
    s = np.ones(n, bool)
    inner = nxt < n - 1
    s[inner] = text[nxt[inner]] < text[nxt[inner] + 1]
    return s, (nxt - np.arange(n) + 1).astype(np.int32)


def _refined(rank: np.ndarray, rows: np.ndarray, key: np.ndarray) -> None:
    """Splits groups of equal rank among ``rows`` by ``key`` (below 2^32); a rank is the place of its group's first."""
    both = (rank[rows].astype(np.uint64) << np.uint64(32)) | key.astype(np.uint64)
    order = np.argsort(both)
    both = both[order]
    r = rank[rows[order]]
    at = np.arange(len(r))
    group = np.maximum.accumulate(np.where(np.r_[True, r[1:] != r[:-1]], at, 0))
    same = np.maximum.accumulate(np.where(np.r_[True, both[1:] != both[:-1]], at, 0))
    rank[rows[order]] = r + (same - group).astype(rank.dtype)


def _shared(rank: np.ndarray) -> np.ndarray:
    """Rows whose rank isn't theirs alone."""
    return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)


def sorted_lms(text: np.ndarray, s: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """LMS suffixes in order of their first ``depth`` values at least, and what each shares with the one before it, capped."""
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    m = len(lms)
    if m < 2:
        return lms, np.zeros(m, np.int32)
    end = np.r_[lms[1:], len(text) - 1]  # a piece ends with the next one's first byte
    size = end - lms + 1
    typed = np.append(text.astype(np.uint32) * np.uint32(2) + s, np.zeros(8, np.uint32))
    rank = np.zeros(m, np.int32)
    rows, at = np.arange(m), 0
    while len(rows) and at < depth + 8:
        key = np.zeros(len(rows), np.uint32)
        for j in range(3):
            p = lms[rows] + at + j
            key = (key << np.uint32(10)) | np.where(at + j < size[rows], typed[np.minimum(p, len(typed) - 1)], np.uint32(0))
        _refined(rank, rows, key)
        at += 3
        rows = _shared(rank)
        rows = rows[size[rows] > at]
    levels, step = [rank.copy()], 1  # ranks by 1, 2, 4, ... pieces
    while True:  # names of pairs: twice as many pieces each time
        rows = _shared(rank)
        ahead = rows + step
        covered = np.where(ahead < m, lms[np.minimum(ahead, m - 1)], len(text)) - lms[rows]
        rows = rows[covered < depth]
        if not len(rows) or step >= m:
            break
        ahead = rows + step
        before = levels[-1]
        _refined(rank, rows, np.where(ahead < m, before[np.minimum(ahead, m - 1)] + 1, 0))
        levels.append(rank.copy())
        step *= 2
    order = np.argsort(rank)
    return lms[order], _lms_prefixes(text, lms, order, levels, depth)


def _lms_prefixes(text: np.ndarray, lms: np.ndarray, order: np.ndarray, levels: list[np.ndarray], depth: int) -> np.ndarray:
    """Shared lengths of neighbours: whole pieces from the ranks of 2^k pieces, then values one by one."""
    m = len(lms)
    out = np.full(m, depth, np.int32)
    out[0] = 0
    left = np.flatnonzero(np.r_[False, levels[-1][order[1:]] != levels[-1][order[:-1]]])
    a, b = order[left - 1], order[left]
    start = lms[b]
    for k in range(len(levels) - 2, -1, -1):
        same = (a + (1 << k) < m) & (b + (1 << k) < m) & (levels[k][np.minimum(a, m - 1)] == levels[k][np.minimum(b, m - 1)])
        a, b = a + same * (1 << k), b + same * (1 << k)
    done = (lms[b] - start).astype(np.int32)
    out[left] = np.minimum(done, depth)
    x, y = lms[a], lms[b]
    padded = np.append(text, np.zeros(16, text.dtype))
    go = done < depth
    left, x, y = left[go], x[go], y[go]
    while len(left):
        equal = padded[np.minimum(x, len(text))[:, None] + np.arange(8)] == padded[np.minimum(y, len(text))[:, None] + np.arange(8)]
        run = np.where(equal.all(1), 8, equal.argmin(1)).astype(np.int32)
        out[left] += run
        go = (run == 8) & (out[left] < depth) & (np.maximum(x, y) < len(text))
        left, x, y = left[go], x[go] + 8, y[go] + 8
    return np.minimum(out, depth)


class _Scan:
    """Induces predecessors while entries pass in order."""

    def __init__(self, text: np.ndarray, s: np.ndarray, queues: Queues, smaller: bool, depth: int, keys: int):
        self.text, self.s, self.queues, self.smaller, self.depth = text.astype(np.uint16), s, queues, smaller, depth  # short keys sort by radix
        self.since = np.full(keys, _INF, np.int32)  # least value passed since the last push
        self.used = np.zeros(keys, bool)

    def feed(self, suffixes: np.ndarray, values: np.ndarray) -> None:
        n = len(suffixes)
        before = suffixes - 1
        push = np.flatnonzero(before >= 0)
        push = push[self.s[before[push]] == self.smaller]
        key = self.text[before[push]]
        order = np.argsort(key, kind="stable")
        push, key = push[order], key[order]
        if len(push):
            first = np.r_[True, key[1:] != key[:-1]]
            head = np.minimum.accumulate(values)
            between = np.minimum.reduceat(np.append(values, _INF), push + 1)
            least = np.empty(len(push), np.int32)
            least[1:] = between[:-1]
            f = np.flatnonzero(first)
            least[f] = np.minimum(self.since[key[f]], head[push[f]])
            value = np.minimum(least + 1, self.depth).astype(np.int32)
            fresh = f[~self.used[key[f]]]
            value[fresh] = 0
            ends = np.r_[f[1:], len(push)]
            tail = np.append(np.minimum.accumulate(values[::-1])[::-1], _INF)
            self.since = np.minimum(self.since, head[-1])
            self.since[key[f]] = tail[push[ends - 1] + 1]
            self.used[key[f]] = True
            for a, b in zip(f.tolist(), ends.tolist(), strict=True):
                self.queues.push(int(key[a]), before[push[a:b]], value[a:b])
        elif n:
            self.since = np.minimum(self.since, values.min())


def repeated_starts(text: np.ndarray, depth: int, memory: int = MEMORY) -> np.ndarray:
    """For each place, whether its first ``depth`` values stand at another place too.

    ``text``: integers from 1; 0 separates pieces. Places with fewer than
    ``depth`` values before the next 0 may be marked as well: leave them out.
    """
    text = np.append(text, 0).astype(np.int32)
    n = len(text)
    marks = np.zeros(n, bool)
    if n < 2:
        return marks[:-1]
    keys = int(text.max()) + 1
    s, run = suffix_types(text)
    order, values = sorted_lms(text, s, depth)
    heads = text[order]
    bounds = np.searchsorted(heads, np.arange(keys + 1))

    # larger suffixes, by an ascending scan over them and the LMS suffixes
    queues = Queues(keys, memory)
    scan = _Scan(text, s, queues, False, depth, keys)
    larger = Queues(keys, memory)
    for c in range(keys):
        last = None
        while (got := queues.take(c)) is not None:
            scan.feed(*got)
            larger.push(c, *got)
            last = got[0][-1]
        a, b = bounds[c], bounds[c + 1]
        if b > a:
            v = values[a:b].copy()
            v[0] = min(depth, run[last], run[order[a]]) if last is not None else 0
            scan.feed(order[a:b], v)

    # smaller suffixes, by a descending scan over them and the larger ones
    queues = Queues(keys, memory)
    scan = _Scan(text, s, queues, True, depth, keys)
    for c in range(keys - 1, -1, -1):
        last = None
        while (got := queues.take(c)) is not None:
            scan.feed(*got)
            hit = got[1] >= depth
            marks[got[0][hit]] = True
            prev = np.append(-1 if last is None else last, got[0][:-1])
            marks[prev[hit & (prev >= 0)]] = True
            last = got[0][-1]
        if (got := larger.take(c)) is not None:
            suffixes, v = got
            hit = v >= depth
            marks[suffixes[hit]] = True
            marks[suffixes[:-1][hit[1:]]] = True
            back = np.append(v[1:], min(depth, run[last], run[suffixes[-1]]) if last is not None else 0).astype(np.int32)
            if last is not None and back[-1] >= depth:
                marks[[last, suffixes[-1]]] = True
            scan.feed(suffixes[::-1], back[::-1])
    return marks[:-1]
