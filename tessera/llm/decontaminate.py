"""Benchmark decontamination by greedy string tiling.

A benchmark item and a document share a seed where they share SEED words in a row. Seeds are found by a rolling Karp-Rabin
hash over word numbers of the benchmark's own vocabulary, checked word by word. For every item that shares a seed with a
document the pair is tiled: the longest match that overlaps no earlier tile is marked, again and again, down to SEED words.
The item's words under tiles, over all its words, are its coverage. Tiles may come in any order, so a passage whose sentences
were moved about is caught as well.

The benchmark travels to the documents. Its size is checked first: beyond BLOCK_BYTES it is dealt into blocks by hash, and the
documents are read once for each block, so what is broadcast stays bounded. Documents are never shuffled.

Defined results: a null or wordless text or item matches nothing; an item with fewer than SEED words must occur whole;
repeated rows are judged each on its own; of matches of one length the first in the item and then in the document goes first;
a very long text is read whole, its matches are held as runs; empty tables give an empty result; other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import documents

SEED, COVERAGE, BLOCK_BYTES = 6, 0.6, 32 << 20
#: Pairs of matching places that are looked at together.
CHUNK = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
#: ASCII characters that part words besides white space.
_PART = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_PART).split()


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``width`` numbers, from one running sum."""
    if len(ids) < width:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(ids) - width + 1, np.uint64)
        for k in range(width):  # Horner, a column at a time
            h = h * BASE + (ids[k : k + len(h)].astype(np.uint64) + np.uint64(1))
        return h ^ (h >> np.uint64(29))


class BenchmarkIndex:
    """Vocabulary, word numbers and seeds of some benchmark items."""

    def __init__(self, items: list[tuple[int, str | None]], seed: int = SEED):
        self.seed, self.ids = seed, [i for i, _ in items]
        texts = [words_of(t) for _, t in items]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for t in texts for w in t), 1)}
        self.numbers = [np.array([self.vocabulary[w] for w in t], np.int64) for t in texts]
        self.flat = np.concatenate([np.zeros(0, np.int64), *self.numbers])
        self.first = np.cumsum([0, *map(len, self.numbers)])
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in sorted({min(seed, len(n)) for n in self.numbers if len(n)}):
            own = [(k, rolling(n, width)) for k, n in enumerate(self.numbers) if len(n) and min(seed, len(n)) == width]
            hashes = np.concatenate([h for _, h in own])
            item = np.concatenate([np.full(len(h), k) for k, h in own])
            place = np.concatenate([np.arange(len(h)) for _, h in own])
            order = np.lexsort((place, item, hashes))
            self.by_width[width] = hashes[order], item[order], place[order]

    def seeds(self, numbers: np.ndarray) -> dict[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
        """Item -> (width, places in the document, places in the item, words) of its maximal matches of at least ``width`` words.

        Matching places are looked up CHUNK pairs at a time and joined to runs along diagonals at once, so what is held is the
        matches and not the pairs: a word that both sides repeat has a pair for each two places, but a match for each diagonal.
        """
        found: dict[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = {}
        known = numbers > 0
        for width, (hashes, item, place) in self.by_width.items():
            if len(numbers) < width:
                continue
            sums = np.concatenate([[0], np.cumsum(known)])
            at = np.flatnonzero(sums[width:] - sums[:-width] == width)  # windows of benchmark words alone
            if not len(at):
                continue
            own = rolling(numbers, width)[at]
            low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            hit = high > low
            at, low, n = at[hit], low[hit], (high - low)[hit]
            runs = np.zeros((4, 0), np.int64)  # item, diagonal, first place in the document, place after the last
            ends = np.cumsum(n)
            start = 0
            while start < len(at):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK, "right")))
                runs = joined_runs(np.concatenate([runs, self._pairs(numbers, width, item, place, at[start:stop], low[start:stop], n[start:stop])], axis=1))
                start = stop
            for a, b in zip(np.flatnonzero(np.r_[True, runs[0, 1:] != runs[0, :-1]][: runs.shape[1]]), np.r_[np.flatnonzero(runs[0, 1:] != runs[0, :-1]) + 1, runs.shape[1]], strict=False):
                p = runs[2, a:b]
                found.setdefault(int(runs[0, a]), []).append((width, p, p - runs[1, a:b], runs[3, a:b] - p + width - 1))
        return found

    def _pairs(self, numbers, width, item, place, at, low, n) -> np.ndarray:
        """Matching places as runs of one; those whose hashes agree by chance are left out."""
        row = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        p, it, q = np.repeat(at, n), item[row], place[row]
        same = np.ones(len(p), bool)
        for k in range(width):
            same &= numbers[p + k] == self.flat[self.first[it] + q + k]
        return np.stack([it, p - q, p, p + 1])[:, same]


def joined_runs(runs: np.ndarray) -> np.ndarray:
    """Runs (item, diagonal, first, after the last) sorted, those that follow each other made one."""
    runs = runs[:, np.lexsort((runs[2], runs[1], runs[0]))]
    if not runs.shape[1]:
        return runs
    new = np.r_[True, (runs[0, 1:] != runs[0, :-1]) | (runs[1, 1:] != runs[1, :-1]) | (runs[2, 1:] != runs[3, :-1])]
    first = np.flatnonzero(new)
    return np.concatenate([runs[:3, first], runs[3:, np.r_[first[1:], runs.shape[1]] - 1]])


def tile(width: int, doc_at: np.ndarray, item_at: np.ndarray, length: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy string tiling of maximal matches: (place in the document, place in the item, words).

    The longest goes first (ties: the first in the item, then in the document); what an earlier tile covers is cut off, and
    the rest returns to the queue if it has ``width`` words. It ends when no ``width`` words of the item in a row are free.
    """
    queue = list(zip((-length).tolist(), item_at.tolist(), doc_at.tolist(), strict=True))
    heapq.heapify(queue)
    doc_used, item_used, tiles = set(), set(), []
    size = int((item_at + length).max(initial=0))
    while queue:
        n, b, a = heapq.heappop(queue)
        n = -n
        free = [a + k not in doc_used and b + k not in item_used for k in range(n)]
        if all(free):
            tiles.append((a, b, n))
            doc_used.update(range(a, a + n))
            item_used.update(range(b, b + n))
            longest = run = 0
            for k in range(size):
                run = 0 if k in item_used else run + 1
                longest = max(longest, run)
            if longest < width:
                break
            continue
        k = 0
        while k < n:  # the stretches that are still free
            if not free[k]:
                k += 1
                continue
            end = k
            while end < n and free[end]:
                end += 1
            if end - k >= width:
                heapq.heappush(queue, (-(end - k), b + k, a + k))
            k = end
    return tiles


def coverages(index: BenchmarkIndex, words: list[bytes]) -> list[tuple[int, float, int]]:
    """(item's place in the index, coverage, tiles) for every item that shares a seed with the text."""
    get = index.vocabulary.get
    numbers = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
    out = []
    for k, matches in index.seeds(numbers).items():
        for width, p, q, n in matches:
            tiles = tile(width, p, q, n)
            out.append((k, sum(n for *_, n in tiles) / len(index.numbers[k]), len(tiles)))
    return out


FOUND = "doc_id long, item_id long, coverage double, n_tiles int"


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[list[tuple[int, str | None]]]:
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles) for each document and item whose coverage reaches the threshold."""
    context = docs.sparkSession.sparkContext
    rows = documents(docs)

    def scan(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = index.value
            for batch in batches:
                found = [(doc, own.ids[k], c, n) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, c, n in coverages(own, words_of(text)) if c >= coverage]
                if found:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], ["doc_id", "item_id", "coverage", "n_tiles"])

        return run

    return reduce(DataFrame.union, [rows.mapInArrow(scan(context.broadcast(BenchmarkIndex(block, seed))), FOUND) for block in _blocks(benchmark, block_bytes)])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that no benchmark item is contained in."""
    context, at, schema = docs.sparkSession.sparkContext, docs.columns.index("text"), docs.schema

    def scan(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = index.value
            for batch in batches:
                yield batch.filter(pa.array([all(c < coverage for _, c, _ in coverages(own, words_of(t))) for t in batch.column(at).to_pylist()], pa.bool_()))

        return run

    for block in _blocks(benchmark, block_bytes):
        docs = docs.mapInArrow(scan(context.broadcast(BenchmarkIndex(block, seed))), schema)
    return docs
