"""Exact removal of repeated byte strings over a corpus, by sharded suffix sorting.

A byte goes if a string of MATCH bytes that covers it also starts earlier (in a document with a smaller id, or earlier in the
same one). The corpus is sharded so that equal strings meet, and each shard's suffixes are sorted by external induced sorting
(``suffix_array``):

1. Anchors. In every window of MATCH bytes the GRAM-byte string with the least hash (the rightmost of several) is an anchor.
   Equal windows have their anchor at the same place, so equal windows meet under their anchor's hash. The context of an
   anchor is what windows with this anchor can cover: MATCH - GRAM bytes before it and MATCH bytes from it on.
2. Shards. Anchors are dealt by hash, as packed arrays. Occurrences with one and the same context repeat all their windows:
   all but the first are settled, and most of them before the shuffle, so a passage that a third of the documents share
   sends a row for each task. What is left to compare are the first occurrences of different contexts under one hash.
3. Suffixes. Those contexts are fetched and dealt by the anchor's hash; a shard's contexts make one text whose suffixes are
   sorted with their common prefixes. Suffixes that share MATCH bytes lie together; all but the earliest of them repeat.
4. Repeated windows return to their documents, whose bytes are marked and cut.

A line that very many documents share among other words is one anchor with as many contexts. Anchors are counted by class of
their hash (HOT_CLASSES of them) on a sixteenth of the documents; those of a class that is far too full are hot, and what they
stand for is dealt by the windows' own hashes and not by the anchor's. In each task and in each shard only the earliest of equal
windows goes on. So a hot anchor is spread evenly, and the result does not depend on which anchors are hot.

Equal means here: equal in two 64-bit hashes, of the anchor's string and of the context or window. Texts that differ pass for
equal with a probability of 2^-64 for each two contexts under one anchor: for 10^12 of them below 10^-7 unless anchors are hot, and
for 10^8 contexts under each of ten hot anchors below 0.003. What goes to suffix sorting is compared byte by byte.

Texts move once (by document; both uses read the same exchange). Whole-text suffix sorting would cost more than ten times the
input in positions alone; see the README.

Defined results: a null text is empty; rows that repeat a doc_id are one document, and each gets its result (if their texts
differ, what repeats in one counts in each); a very long text is read in slabs, but held once; a null doc_id comes after all others, ordered by the text's hash; an empty
table gives an empty result; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import suffix_array
from tessera.llm.common import documents, settle

MATCH, GRAM = 100, 36
BEFORE = MATCH - GRAM
#: Bytes that are hashed at once, and shards a shuffle partition gets.
SLAB, SHARDS_EACH = 1 << 20, 4
#: Bytes of documents for each shuffle partition, classes of anchor hashes, a document in so many is counted, and how many contexts a class has at least to be hot.
PART_BYTES, HOT_CLASSES, HOT_SAMPLE, HOT = 64 << 20, 1 << 16, 16, 256
#: Document keys from here on stand for null ids.
NULL_KEY = 1 << 62
_BASE = 0xD6E8FEB86659FD93
_table = np.random.default_rng(100).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 2**64)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def hot_class(h: np.ndarray) -> np.ndarray:
    """Anchors have the least hashes of their surroundings, so the class is taken from a hash of the hash."""
    return (mix(h) >> np.uint64(64 - HOT_CLASSES.bit_length() + 1)).astype(np.int64)


class Anchors:
    """Anchors of the windows that start in some stretches of texts, with the hashes of their grams and contexts."""

    def __init__(self, data: np.ndarray, first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray, hot: np.ndarray | None = None):
        """``data`` holds the stretches side by side; windows start in [first, last); the texts reach over [low, high).

        Anchors of ``hot`` classes are left out; the windows that have them are in ``window``: (stretch, start, anchor's hash, own hash).
        """
        n = len(data)
        up, down = powers(n + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_table[data] * up[:n], dtype=np.uint64)])
            grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
        place = np.uint64(2**28 - 1) - np.arange(len(grams), dtype=np.uint64)
        least = (grams & ~np.uint64(2**28 - 1)) | place
        step = 1
        while step < BEFORE:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        least = np.minimum(least[:-1], least[1:])  # windows of BEFORE + 1 grams; BEFORE is a power of two
        count = np.maximum(last - first, 0)
        starts = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        at = (np.uint64(2**28 - 1) - (least[starts] & np.uint64(2**28 - 1))).astype(np.int64)
        new = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
        stretch = np.repeat(np.arange(len(first)), count)
        self.window = None
        if hot is not None and len(at):
            mine = hot[hot_class(grams[at])]
            with np.errstate(over="ignore"):
                own = mix((sums[starts[mine] + MATCH] - sums[starts[mine]]) * down[starts[mine]])
            self.window = stretch[mine], starts[mine], grams[at[mine]], own
            new &= ~mine
        self.at, self.stretch = at[new], stretch[new]
        lo, hi = np.maximum(self.at - BEFORE, low[self.stretch]), np.minimum(self.at + MATCH, high[self.stretch])
        self.hash = grams[self.at]
        with np.errstate(over="ignore"):
            context = (sums[hi] - sums[lo]) * down[lo]
            self.context = mix(context + (self.at - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (hi - self.at).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


assert BEFORE & (BEFORE - 1) == 0


def slabs(offsets: np.ndarray, size: int = SLAB) -> Iterator[list[tuple[int, int, int]]]:
    """Stretches (text, first window, after the last window) whose bytes make about ``size``; a long text makes several."""
    out, held = [], 0
    for k, n in enumerate(np.diff(offsets)):
        for start in range(0, max(int(n) - MATCH + 1, 0), size):
            stop = min(start + size, int(n) - MATCH + 1)
            if out and held + stop - start > size:
                yield out
                out, held = [], 0
            out.append((k, start, stop))
            held += stop - start + MATCH
    if out:
        yield out


def batch_anchors(data: np.ndarray, offsets: np.ndarray, size: int = SLAB, hot: np.ndarray | None = None) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(text, position in it, gram hash, context hash) of all anchors of a batch of texts, each once, and (text, start, gram hash, own hash) of the windows of hot ones."""
    found, windows = [], []
    for group in slabs(offsets, size):
        lo = np.array([offsets[k] + max(0, a - BEFORE) for k, a, _ in group])
        hi = np.array([min(offsets[k + 1], offsets[k] + b + BEFORE + MATCH) for k, _, b in group])
        # side by side in a buffer of their own, so that powers and places stay small
        where = np.r_[0, np.cumsum(hi - lo)]
        own = np.concatenate([data[a:b] for a, b in zip(lo, hi, strict=True)])
        shift = where[:-1] - lo
        first = np.array([offsets[k] + a for k, a, _ in group]) + shift
        last = np.array([offsets[k] + b for k, _, b in group]) + shift
        a = Anchors(own, first, last, where[:-1], where[1:], hot)
        texts = np.array([k for k, *_ in group])
        if a.window is not None and len(a.window[0]):
            w = a.window
            windows.append((texts[w[0]], w[1] - shift[w[0]] - offsets[texts[w[0]]], w[2], w[3]))
        text = texts[a.stretch]
        found.append((text, a.at - shift[a.stretch] - offsets[text], a.hash, a.context))
    nothing = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    windows = tuple(np.concatenate(x) for x in zip(*windows, strict=True)) if windows else nothing
    if not found:
        return nothing, windows
    text, at, h, c = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((at, text))
    new = np.ones(len(order), bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (at[order][1:] != at[order][:-1])
    return tuple(x[order][new] for x in (text, at, h, c)), windows


# --- packed arrays that travel as binary columns --------------------------------------------------------------------------


def compress(blob: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(blob)


def decompress(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def packed(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n, out, at = len(blob) // sum(np.dtype(k).itemsize for k in kinds), [], 0
    for k in kinds:
        out.append(np.frombuffer(blob, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


PLACES = ("<i8", "<u4")  # document key, position
ANCHORS = (*PLACES, "<u8", "<u8")
ROWS = "kind int, bucket int, blob binary"
SETTLED, ANCHOR, OPEN, RANGE, HOT_WINDOW = 0, 1, 2, 3, 4
#: How marks are packed, and how many a task holds.
MARKS, MARKS_HELD = {SETTLED: PLACES, RANGE: (*PLACES, "<u4")}, 1 << 22


def rows_of(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds, buckets, blobs = zip(*out, strict=True) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], ["kind", "bucket", "blob"])


def parted(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The arrays' parts in each bucket that has something."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)] if len(bucket) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[a]), [x[order[a:b]] for x in arrays]


def dealt(kind: int, bucket: np.ndarray, squeeze: bool, *arrays: np.ndarray) -> list[tuple[int, int, bytes]]:
    """A row for each bucket that has something."""
    return [(kind, b, compress(packed(*own)) if squeeze else packed(*own)) for b, own in parted(bucket, *arrays)]


def doc_bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int64)


def settle_contexts(key: np.ndarray, at: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first occurrences of each context under each hash, and of the later ones."""
    order = np.lexsort((at, key, c, h))
    h, c, key, at = h[order], c[order], key[order], at[order]
    same = np.zeros(len(order), bool)
    same[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    twice = same.copy()
    twice[1:] &= (key[1:] == key[:-1]) & (at[1:] == at[:-1])  # one occurrence, met twice
    return order[~same], order[same & ~twice]


def batch_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column side by side, and where each value starts."""
    column = column.fill_null(b"") if column.null_count else column
    n = len(column)
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def key_array(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    rows = documents(docs, "binary")
    stand_in = F.lit(NULL_KEY).bitwiseOR(F.xxhash64("text").bitwiseAND(F.lit(NULL_KEY - 1)))
    return rows.select(F.coalesce("doc_id", stand_in).alias("key"), "text")


def repeated_windows(key: np.ndarray, at: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows ``later`` (indices, in any order) as covered stretches."""
    order = later[np.lexsort((at[later], key[later]))]
    own, first, last = ranges(key[order], at[order].astype(np.int64))
    return own, first.astype("<u4"), last.astype("<u4")


def hot_classes(rows: DataFrame) -> np.ndarray | None:
    """Which classes of anchors have far more contexts than others; None if none has. At most HOT_CLASSES counts come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (_, _, h, c), _ = batch_anchors(*batch_bytes(batch.column(0)))
            order = np.lexsort((c, h))
            new = np.r_[True, (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])][: len(order)]
            own, n = np.unique(hot_class(h[order][new]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], ["class", "n"])

    sample = rows.where(F.pmod(F.xxhash64("key"), F.lit(HOT_SAMPLE)) == 0).select("text")
    counts = {r["class"]: r["n"] for r in sample.mapInArrow(run, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect()}
    hot = [k for k, n in counts.items() if n > max(HOT, 4 * sum(counts.values()) // HOT_CLASSES)]
    if not hot:
        return None
    out = np.zeros(HOT_CLASSES, bool)
    out[hot] = True
    return out


def find_anchors(rows: DataFrame, shards: int, buckets: int, hot: np.ndarray | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, (data, offsets) = key_array(batch.column(0)), batch_bytes(batch.column(1))
            (text, at, h, c), (w_text, w_at, w_h, w) = batch_anchors(data, offsets, hot=hot)
            key, at = keys[text], at.astype(np.uint32)
            first, later = settle_contexts(key, at, h, c)
            out = dealt(ANCHOR, (h[first] % np.uint64(shards)).astype(np.int64), False, key[first], at[first], h[first], c[first])
            out += dealt(SETTLED, doc_bucket(key[later], buckets), True, key[later], at[later])
            if len(w):
                key, at = keys[w_text], w_at.astype(np.uint32)
                first, later = settle_contexts(key, at, w_h, w)
                out += dealt(HOT_WINDOW, (w[first] % np.uint64(shards)).astype(np.int64), False, key[first], at[first], w_h[first], w[first])
                own, *covered = repeated_windows(key, at, later)
                out += dealt(RANGE, doc_bucket(own, buckets), True, own, *covered)
            yield rows_of(out)

    return rows.mapInArrow(run, ROWS)


def meet(anchors: DataFrame, buckets: int) -> DataFrame:
    """Per hash: later occurrences of a context are settled; first ones of different contexts are open, to be compared. Later ones of a hot anchor's windows are covered.

    A task makes one row for each kind and bucket of documents (more only beyond MARKS_HELD marks), whatever it has read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {ANCHOR: [], HOT_WINDOW: []}
        marks: dict[tuple[int, int], list[list[np.ndarray]]] = {}
        size = 0

        def mark(kind: int, key: np.ndarray, *arrays: np.ndarray) -> None:
            for bucket, own in parted(doc_bucket(key, buckets), key, *arrays):
                marks.setdefault((kind, bucket), []).append(own)

        def gathered() -> pa.RecordBatch:
            out = [(kind, bucket, compress(packed(*(np.concatenate(x) for x in zip(*own, strict=True))))) for (kind, bucket), own in marks.items()]
            marks.clear()
            return rows_of(out)

        for batch in batches:
            for kind, bucket, blob in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if kind in parts:
                    parts[kind].append(unpacked(blob, *ANCHORS))
                    continue
                marks.setdefault((kind, bucket), []).append(unpacked(decompress(blob), *MARKS[kind]))
                size += len(marks[kind, bucket][-1][0])
                if size > MARKS_HELD:
                    yield gathered()
                    size = 0
        if parts[HOT_WINDOW]:
            key, at, h, w = (np.concatenate(x) for x in zip(*parts.pop(HOT_WINDOW), strict=True))
            mark(RANGE, *repeated_windows(key, at, settle_contexts(key, at, h, w)[1]))
        if parts[ANCHOR]:
            key, at, h, c = (np.concatenate(x) for x in zip(*parts.pop(ANCHOR), strict=True))
            first, later = settle_contexts(key, at, h, c)
            mine = h[first]  # in order
            several = np.zeros(len(first), bool)
            several[1:] = mine[1:] == mine[:-1]
            several[:-1] |= several[1:].copy()
            left = first[several]
            mark(SETTLED, key[later], at[later])
            mark(OPEN, key[left], at[left], h[left])
        yield gathered()

    return anchors.repartition(buckets, "kind", "bucket").mapInArrow(run, ROWS)


def by_document(rows: DataFrame, buckets: int, *kinds: str) -> DataFrame:
    """(key, marks): the packed arrays of each document, from rows that are packed by bucket of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpacked(decompress(blob), "<i8", *kinds) for batch in batches for blob in batch.column(1).to_pylist()]
        if not parts:
            return
        key, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        key, rest = key[order], [x[order] for x in rest]
        cuts = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
        for at in range(0, len(cuts) - 1, 4096):
            own = cuts[at : at + 4097]
            yield pa.RecordBatch.from_arrays([pa.array(key[own[:-1]]), pa.array([packed(*(x[a:b] for x in rest)) for a, b in zip(own[:-1], own[1:], strict=True)], pa.binary())], ["key", "marks"])

    return rows.repartitionById(buckets, "bucket").select("bucket", "blob").mapInArrow(run, "key long, marks binary")


def fetch_contexts(texts: DataFrame, open_: DataFrame, shards: int, buckets: int) -> DataFrame:
    """The bytes of the contexts that are open, dealt by their anchor's hash."""
    joined = texts.join(by_document(open_, buckets, "<u4", "<u8"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, (data, offsets) = key_array(batch.column(0)), batch_bytes(batch.column(1))
            key, start, length, shard = [], [], [], []
            for k, marks in enumerate(batch.column(2).to_pylist()):
                at, h = unpacked(marks, "<u4", "<u8")
                n = offsets[k + 1] - offsets[k]
                at, h = at[at.astype(np.int64) + GRAM <= n].astype(np.int64), h[at.astype(np.int64) + GRAM <= n]
                lo, hi = np.maximum(at - BEFORE, 0), np.minimum(at + MATCH, n)
                key.append(np.full(len(at), keys[k])), start.append(lo), length.append(hi - lo), shard.append(h % np.uint64(shards))
                data_at = offsets[k] + lo
                start[-1] = np.stack([lo, data_at], 1)
            if not key:
                continue
            key, start, length, shard = np.concatenate(key), np.concatenate(start), np.concatenate(length), np.concatenate(shard).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.r_[np.flatnonzero(np.r_[True, shard[order][1:] != shard[order][:-1]]), len(order)] if len(order) else [0]
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = order[a:b]
                n = length[own]
                body = data[np.repeat(start[own, 1] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                head = packed(key[own].astype("<i8"), start[own, 0].astype("<u4"), n.astype("<u2"))
                out.append((OPEN, int(shard[own[0]]), compress(len(own).to_bytes(4, "little") + head + body.tobytes())))
            yield rows_of(out)

    return joined.select("key", "text", "marks").mapInArrow(run, ROWS)


def repeated_starts(contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(key, start) of windows that occur earlier, among contexts (keys, starts, lengths, bytes), by suffix sorting."""
    key, start, length = (np.concatenate(x) for x in zip(*[c[:3] for c in contexts], strict=True))
    length = length.astype(np.int64)
    # contexts side by side, a separator after each
    ends = np.cumsum(length + 1)
    text = np.zeros(int(ends[-1]), np.uint8)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False
    text[inside] = np.concatenate([c[3] for c in contexts])
    text[~inside] = 0xFF  # in no UTF-8 text; windows that reach over one are not looked at in any case
    text = np.r_[text, np.uint8(0)]
    found_key, found_start = [], []
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def close() -> None:
        """A run of suffixes that share MATCH characters: all but the earliest repeat."""
        at, run = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((start_of(at), key_of(at), run))
        k, s, r = key_of(at)[order], start_of(at)[order], run[order]
        head = np.r_[True, r[1:] != r[:-1]]
        group = np.cumsum(head) - 1
        later = (k != k[head][group]) | (s != s[head][group])
        found_key.append(k[later]), found_start.append(s[later])

    context_of = lambda at: np.searchsorted(ends, at, "right")
    key_of = lambda at: key[context_of(at)]
    start_of = lambda at: start[context_of(at)].astype(np.int64) + at - (ends[context_of(at)] - 1 - length[context_of(at)])
    run_number = 0
    for at, lcp in suffix_array.sorted_suffixes(text):
        runs = run_number + np.cumsum(lcp < MATCH)
        if held and runs[-1] != run_number:  # the open run ends in this block
            same = runs == run_number
            held.append((at[same], runs[same]))
            close()
            at, runs = at[~same], runs[~same]
        run_number = runs[-1] if len(runs) else run_number
        which = np.minimum(context_of(at), len(ends) - 1)
        whole = (at + MATCH < ends[which]) & (at < ends[-1])
        at, runs = at[whole], runs[whole]
        if not len(at):
            continue
        last = runs == run_number
        many = np.zeros(len(runs), bool)
        many[1:] = runs[1:] == runs[:-1]
        many[:-1] |= many[1:].copy()
        if (many & ~last).any():
            held.append((at[many & ~last], runs[many & ~last]))
            close()
        if last.any():
            held.append((at[last], runs[last]))
    if held:
        close()
    if not found_key:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k, s = np.concatenate(found_key), np.concatenate(found_start)
    order = np.lexsort((s, k))
    return k[order], s[order]


def ranges(key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts (sorted) as covered stretches: key, first byte, byte after the last."""
    if not len(key):
        return key, start, start
    new = np.r_[True, (key[1:] != key[:-1]) | (start[1:] > start[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(key)] - 1
    return key[first], start[first], start[last] + MATCH


def compare(contexts: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, list[bytes]] = {}
        for batch in batches:
            for shard, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                shards.setdefault(shard, []).append(blob)
        while shards:
            parts = []
            for blob in map(decompress, shards.popitem()[1]):
                n = int.from_bytes(blob[:4], "little")
                key, start, length = np.frombuffer(blob, "<i8", n, 4), np.frombuffer(blob, "<u4", n, 4 + 8 * n), np.frombuffer(blob, "<u2", n, 4 + 12 * n)
                parts.append((key, start, length, np.frombuffer(blob, np.uint8, -1, 4 + 14 * n)))
            key, first, last = ranges(*repeated_starts(parts))
            yield rows_of(dealt(RANGE, doc_bucket(key, buckets), True, key, first.astype("<u4"), last.astype("<u4")))

    return contexts.repartition(buckets, "bucket").mapInArrow(run, ROWS)


def cover(n: int, settled: bytes | None, found: bytes | None) -> np.ndarray:
    """Covered bytes of a text, as runs (first, after the last), apart from each other."""
    firsts, lasts = [], []
    if settled:
        (at,) = unpacked(settled, "<u4")
        at = at.astype(np.int64)
        # all windows of the text that have this anchor's context: their starts reach from BEFORE bytes before it to it
        firsts.append(np.maximum(at - BEFORE, 0)), lasts.append(np.minimum(at + MATCH, n))
    if found:
        a, b = unpacked(found, "<u4", "<u4")
        firsts.append(a.astype(np.int64)), lasts.append(b.astype(np.int64))
    if not firsts:
        return np.zeros((0, 2), np.int64)
    first, last = np.concatenate(firsts), np.minimum(np.concatenate(lasts), n)
    ok = last - first >= MATCH
    first, last = first[ok], last[ok]
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.r_[True, first[1:] > last[:-1]] if len(first) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    return np.stack([first[heads], last[np.r_[heads[1:], len(first)] - 1]], 1) if len(heads) else np.zeros((0, 2), np.int64)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """(key, text, settled, found) for each row: its text and the packed marks of its repeated windows."""
    rows = keyed(docs)
    # shards follow the corpus, so that what a task holds does not
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # documents have one bucket a partition, so that what tasks mark goes as a row for each block of the shuffle
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    shards = SHARDS_EACH * buckets
    met = settle(meet(find_anchors(rows, shards, buckets, hot_classes(rows)), buckets))
    texts = rows.repartition(buckets, "key")
    found = compare(fetch_contexts(texts, met.where(F.col("kind") == OPEN), shards, buckets), buckets).union(met.where(F.col("kind") == RANGE))
    settled = by_document(met.where(F.col("kind") == SETTLED), buckets, "<u4").withColumnRenamed("marks", "settled")
    found = by_document(found, buckets, "<u4", "<u4").withColumnRenamed("marks", "found")
    marks = settled.join(found, "key", "full")
    return texts.join(marks, "key", "left")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """A row for each document: bytes, bytes removed, maximal removed runs, and the digest of what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, removed, spans, digests, sizes = [], [], [], [], []
            keys = batch.column(0).to_pylist()
            for key, text, settled, found in zip(keys, *(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                text = text or b""
                runs = cover(len(text), settled, found)
                digest, done = hashlib.sha256(), 0
                for a, b in runs.tolist():
                    digest.update(text[done:a])
                    done = b
                digest.update(text[done:])
                ids.append(None if key >= NULL_KEY else key), sizes.append(len(text)), spans.append(len(runs))
                removed.append(int((runs[:, 1] - runs[:, 0]).sum())), digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())], [x.split(" ")[0] for x in RESULT.split(", ")])

    return repeated_bytes(docs).select("key", "text", "settled", "found").mapInArrow(run, RESULT)


def dedup_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text): what is left of each text, bytes that no longer make whole characters included as U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for key, text, settled, found in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                text, kept, done = text or b"", [], 0
                for a, b in cover(len(text), settled, found).tolist():
                    kept.append(text[done:a])
                    done = b
                ids.append(None if key >= NULL_KEY else key), texts.append(b"".join([*kept, text[done:]]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return repeated_bytes(docs).select("key", "text", "settled", "found").mapInArrow(run, "doc_id long, text string")
