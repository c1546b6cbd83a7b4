"""Suffixes in order, with common-prefix values, by external induced sorting.

For a text of bytes the suffixes that start a rising stretch (S*) are ranked first: their substrings get names, and the much
shorter text of names is ranked by prefix doubling, to a bounded depth. All other suffixes follow by induction: a pass over
the first characters upwards gives the L suffixes, a pass downwards the S suffixes. What is induced waits in priority queues
of tuples (position, common prefix with the tuple before it). The key of a tuple is (first character, rank of the suffix one
further on); the pass meets these ranks in rising order, so a queue for each character, first in first out, is an exact
priority queue. Queues beyond QUEUE tuples go to disk, and a bucket is read back in blocks.

A tuple's common prefix is one more than the least common prefix between the suffixes that induced it and the tuple before it;
the least over a range comes from a sparse table over a block, and what is left open at a block's end is carried on.
Values are capped at DEPTH, which also bounds the order: suffixes that share DEPTH characters may come in any order.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

DEPTH = 120
#: Tuples a queue holds in memory, and tuples a block that is worked on at once.
QUEUE, BLOCK = 1 << 17, 1 << 18
_NONE = np.int16(32000)


class DiskQueue:
    """First in, first out; (position, common prefix). Beyond ``limit`` tuples in memory it appends to a file."""

    def __init__(self, folder: str, name: str, limit: int = QUEUE):
        self.path, self.limit, self.parts, self.held, self.stored = os.path.join(folder, name), limit, [], 0, 0

    def push(self, at: np.ndarray, lcp: np.ndarray) -> None:
        if not len(at):
            return
        self.parts.append((at, lcp))
        self.held += len(at)
        if self.held > self.limit:
            with open(self.path + ".at", "ab") as a, open(self.path + ".lcp", "ab") as b:
                for at, lcp in self.parts:
                    a.write(at.astype(np.int64).tobytes())
                    b.write(lcp.astype(np.int16).tobytes())
            self.stored, self.held, self.parts = self.stored + self.held, 0, []

    def __len__(self) -> int:
        return self.stored + self.held

    def blocks(self, first: int, last: int, backwards: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Tuples ``first`` to ``last`` in blocks of BLOCK at most."""
        if last <= first:
            return
        memory = None
        if last > self.stored and self.parts:
            if len(self.parts) > 1:
                self.parts = [tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))]
            memory = self.parts[0]
        cuts = sorted({first, last, *(c for c in [*range(first, last, BLOCK), self.stored] if first < c < last)})
        pairs = list(zip(cuts[:-1], cuts[1:], strict=True))
        for a, b in reversed(pairs) if backwards else pairs:
            if b <= self.stored:
                yield np.fromfile(self.path + ".at", np.int64, b - a, offset=8 * a), np.fromfile(self.path + ".lcp", np.int16, b - a, offset=2 * a)
            else:
                yield tuple(x[a - self.stored : b - self.stored] for x in memory)


def _range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of values[first..last], both included, for each pair."""
    table = [values]
    width = last - first + 1
    for k in range(int(width.max()).bit_length() - 1 if len(width) else 0):
        step = 1 << k
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
    level = np.frexp(width.astype(np.float64))[1] - 1
    out = np.empty(len(first), values.dtype)
    for k in np.unique(level):
        own = level == k
        out[own] = np.minimum(table[k][first[own]], table[k][last[own] - (1 << int(k)) + 1])
    return out


class _Inducer:
    """Takes the sorted suffixes block by block and queues what they induce."""

    def __init__(self, text: np.ndarray, takes: np.ndarray, queues: list[DiskQueue]):
        self.text, self.takes, self.queues = text, takes, queues
        self.open = np.full(256, _NONE, np.int16)  # least common prefix since the last tuple of each queue; _NONE: nothing queued yet
        self.any = np.zeros(256, bool)

    def feed(self, at: np.ndarray, lcp: np.ndarray) -> None:
        """``lcp[k]``: with the suffix before it in the stream; ``takes[p]``: is p to be queued here when p + 1 is met?"""
        if not len(at):
            return
        lcp = lcp.astype(np.int16)
        keep = np.flatnonzero((at > 0) & self.takes[at - 1])
        self_min = lcp.min()
        if not len(keep):
            self.open = np.minimum(self.open, self_min)
            return
        char = self.text[at[keep] - 1]
        order = np.argsort(char, kind="stable")
        char, index = char[order], keep[order]
        heads = np.flatnonzero(np.r_[True, char[1:] != char[:-1]])
        before = np.r_[-1, index[:-1]]
        before[heads] = -1
        value = _range_min(lcp, before + 1, index)
        carried = self.open[char[heads]]
        value[heads] = np.where(self.any[char[heads]], np.minimum(value[heads], carried), -1)
        value = np.minimum(value + 1, DEPTH).astype(np.int16)
        ends = np.r_[heads[1:], len(char)]
        rest = np.r_[np.minimum.accumulate(lcp[::-1])[::-1], _NONE]  # least from k on
        self.open = np.minimum(self.open, self_min)
        for a, b in zip(heads, ends, strict=True):
            c = char[a]
            self.queues[c].push(at[index[a:b]] - 1, value[a:b])
            self.open[c], self.any[c] = rest[index[b - 1] + 1], True


def types(text: np.ndarray) -> np.ndarray:
    """Is the suffix smaller than the one after it (S)? The last one counts as S."""
    n = len(text)
    out = np.ones(n, bool)
    differs = np.flatnonzero(text[:-1] != text[1:])
    if len(differs):
        nearest = np.searchsorted(differs, np.arange(n))
        inside = nearest < len(differs)
        at = differs[nearest[inside]]
        out[inside] = text[at] < text[at + 1]
    return out


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight characters from each position as a number; ``text`` is padded."""
    view = np.lib.stride_tricks.sliding_window_view(text, 8)
    return np.ascontiguousarray(view[at]).view(">u8").ravel().astype(np.uint64)


def _dense(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(order), bool)
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def star_names(padded: np.ndarray, star: np.ndarray, n: int) -> np.ndarray:
    """Rank of each S* substring (up to and with the next S* character). Of two of which one begins the other, the longer is smaller."""
    length = np.diff(np.r_[star, n - 1]) + 1
    rank, alive, k = np.zeros(len(star), np.int64), np.arange(len(star)), 0
    while len(alive):
        left = np.clip(length[alive] - 8 * k, 0, 8).astype(np.uint64)
        word = _words(padded, np.minimum(star[alive] + 8 * k, len(padded) - 8))
        with np.errstate(over="ignore"):
            fill = np.where(left == 8, np.uint64(0), np.uint64(2**64 - 1) >> (left * np.uint64(8) % np.uint64(64)))
        word |= np.where(left == 0, np.uint64(2**64 - 1), fill)
        order = np.lexsort((-length[alive], word, rank[alive]))
        sub = _dense(order, rank[alive], word)
        size = np.bincount(sub)
        # ranks stay comparable: a group's members keep its first rank plus how many of it are smaller
        before = np.cumsum(np.r_[0, size[:-1]])[sub]
        group = rank[alive]
        first = np.full(int(group.max()) + 1, len(alive) + 1, np.int64)
        np.minimum.at(first, group, before)
        rank[alive] = group + before - first[group]
        k += 1
        longest = np.zeros(len(size), np.int64)
        np.maximum.at(longest, sub, length[alive])
        alive = alive[(size[sub] > 1) & (longest[sub] > 8 * k)]  # those that have ended stay while others of their group go on
    order = np.lexsort((-length, rank))
    return _dense(order, rank, length)


def star_order(padded: np.ndarray, star: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """S* positions in the order of their suffixes (to DEPTH characters), and common prefixes of neighbours."""
    rank = star_names(padded, star, n)
    step, m = 1, len(star)
    while 2 * step <= 2 * DEPTH and int(rank.max(initial=0)) < m - 1:  # a name has two characters at least
        after = np.zeros(m, np.int64)
        after[:-step] = rank[step:] + 1 if step < m else 0
        key = rank * (m + 1) + after
        order = np.argsort(key, kind="stable")
        rank, step = _dense(order, key), 2 * step
    order = np.argsort(rank, kind="stable")
    ordered = star[order]
    return ordered, np.r_[np.int16(0), common(padded, ordered[:-1], ordered[1:])]


def common(padded: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefixes of pairs of suffixes, capped at DEPTH; word by word, for the pairs that still agree."""
    out, alive = np.zeros(len(a), np.int16), np.arange(len(a))
    for k in range(0, DEPTH, 8):
        if not len(alive):
            break
        x = _words(padded, a[alive] + k) ^ _words(padded, b[alive] + k)
        same = x == 0
        lead = 64 - np.frexp(x[~same].astype(np.float64))[1]  # may be one too low where the number rounds up to a power of two
        lead = np.where((x[~same] >> (np.uint64(63) - np.clip(lead, 0, 63).astype(np.uint64))) & np.uint64(1), lead, lead + 1)
        out[alive[~same]] = k + lead // 8
        alive = alive[same]
        out[alive] = k + 8
    return np.minimum(out, DEPTH)


def sorted_suffixes(text: np.ndarray, queue: int = QUEUE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, common prefix with the suffix before) of all suffixes in falling order, bucket by bucket.

    Suffixes come from the largest down; the common prefix of the first of a block is with the last of the block before.
    """
    n = len(text)
    if not n:
        return
    padded = np.concatenate([text, np.zeros(DEPTH + 16, np.uint8)])
    rising = types(text)
    star = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    if n - 1 not in star[-1:]:
        star = np.r_[star, n - 1]  # the last suffix starts the induction
    ordered, star_lcp = star_order(padded, star, n)
    bounds = np.searchsorted(text[ordered], np.arange(257))
    with tempfile.TemporaryDirectory() as folder:
        falling = [DiskQueue(folder, f"l{c}", queue) for c in range(256)]
        lower = _Inducer(text, ~rising, falling)
        present = np.unique(text).astype(int)
        for c in present:
            done, last = 0, None
            while done < len(falling[c]):  # a round for each further character c in a row
                upto = len(falling[c])
                for at, lcp in falling[c].blocks(done, upto):
                    lower.feed(at, np.r_[0 if last is None else lcp[0], lcp[1:]])
                    last = at[-1:]
                done = upto
            a, b = bounds[c], bounds[c + 1]
            if b > a:
                first = 0 if last is None else int(common(padded, last, ordered[a : a + 1])[0])
                lower.feed(ordered[a:b], np.r_[np.int16(first), star_lcp[a + 1 : b]])
        climbing = [DiskQueue(folder, f"s{c}", queue) for c in range(256)]
        upper = _Inducer(text, rising, climbing)
        # the last suffix has no suffix after it that could induce it; it is the first S suffix of its bucket
        for c in present[::-1]:
            done, last = 0, None
            while done < len(climbing[c]):
                upto = len(climbing[c])
                for at, lcp in climbing[c].blocks(done, upto):
                    lcp = np.r_[0 if last is None else lcp[0], lcp[1:]].astype(np.int16)
                    upper.feed(at, lcp)
                    yield at, lcp
                    last = at[-1:]
                done = upto
            if text[n - 1] == c:
                at = np.array([n - 1])
                lcp = np.array([0 if last is None else int(common(padded, last, at)[0])], np.int16)
                upper.feed(at, lcp)
                yield at, lcp
                last = at
            waiting = None  # going down, a tuple's common prefix is the one that the tuple above it had below itself
            for at, lcp in falling[c].blocks(0, len(falling[c]), backwards=True):
                at, lcp = at[::-1], lcp[::-1]
                first = (0 if last is None else int(common(padded, last, at[:1])[0])) if waiting is None else waiting
                down = np.r_[np.int16(first), lcp[:-1]]
                upper.feed(at, down)
                yield at, down
                waiting, last = lcp[-1], at[-1:]
