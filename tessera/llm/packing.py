"""Best-fit packing by a plan over the histogram of lengths.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens. The plan is made from the number of pieces of
each length alone (at most ``capacity`` numbers): best fit, longest first, for all pieces of a length together. It says which
ranks within a length go to which sequences at which place; pieces take their places by a join on length and rank.
Ranks are counted in buckets whose sizes are added up, so that a length that very many pieces share is no single task.

Defined results: a null text is an empty document (the closing id alone); a very long text is cut into pieces, of which only the last
may be shorter; repeated rows are packed each on its own; pieces of one length take places in the order of doc_id, piece and checksum; a null
doc_id stays null; an empty table gives an empty result; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import documents, settle

CAPACITY, CLOSING = 4096, 1
#: Bytes of words and ids that a worker keeps, characters that are encoded at once, characters of words on a line, pieces a bucket of ranks should have.
KEPT, AT_ONCE, LINE, BUCKET = 96 << 20, 4 << 20, 4000, 50_000
#: What a kept word costs besides its characters: the string, its place in the dictionary and three numbers.
WORD_COST = 180


class _Numbers(dict):
    """Word -> number; a new word gets the next one and is noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordEncoder:
    """Ids of texts by a tokenizer whose words end at white space.

    Words are parted at blanks and line ends, which the tokenizer drops, and each distinct word is encoded once; the ids of
    a text are its words' ids in order. What is kept is counted in bytes and forgotten when it is more than KEPT, so besides
    that only the words of the texts at hand are held, however long words are.
    """

    def __init__(self, path: str, closing: int = CLOSING):
        from tokenizers import Tokenizer

        self.tokenizer, self.closing = Tokenizer.from_file(path), closing
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.held = 0
        self.flat, self.used = np.zeros(1 << 12, np.uint32), 0  # a buffer that doubles
        self.first, self.count, self.known = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), 0

    @staticmethod
    def _room(buffer: np.ndarray, used: int, more: int) -> np.ndarray:
        if used + more <= len(buffer):
            return buffer
        grown = np.zeros(max(2 * len(buffer), used + more), buffer.dtype)
        grown[:used] = buffer[:used]
        return grown

    @staticmethod
    def plain(word: str) -> bool:
        """Does the tokenizer keep the word's length, so that places in a line of words can be told apart?"""
        return "<|" not in word and len(word.lower()) == len(word) and unicodedata.is_normalized("NFC", word) and word.isprintable()

    def learn(self) -> None:
        """Encode the words that are new: many plain ones as one line, the others one by one."""
        new, self.numbers.new = self.numbers.new, []
        if not new:
            return
        at, count = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)

        def keep(ids: list[int]) -> int:
            self.flat = self._room(self.flat, self.used, len(ids))
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            return self.used - len(ids)

        def line(own: list[int]) -> None:
            if own:
                words = [new[i] for i in own]
                starts = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                e = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
                cuts = np.r_[0, np.searchsorted(np.fromiter((o[0] for o in e.offsets), np.int64, len(e)), starts)]
                at[own], count[own] = keep(e.ids) + cuts[:-1], np.diff(cuts)

        plain, long_ = [], 0
        for k, w in enumerate(new):
            if w and self.plain(w):
                plain.append(k)
                long_ += len(w) + 1
                if long_ > LINE:
                    line(plain)
                    plain, long_ = [], 0
            elif w:
                ids = self.tokenizer.encode(w, add_special_tokens=False).ids
                at[k], count[k] = keep(ids), len(ids)
        line(plain)
        self.first, self.count = self._room(self.first, self.known, len(new)), self._room(self.count, self.known, len(new))
        self.first[self.known : self.known + len(new)], self.count[self.known : self.known + len(new)] = at, count
        self.known += len(new)
        self.held += sum(map(len, new)) * 2 + len(new) * WORD_COST + 4 * int(count.sum())

    @staticmethod
    def words(text: str | None) -> list[str]:
        """The text's words. In plain Latin text, letters and signs are parted where the tokenizer parts them, and all is lower case."""
        text = text or ""
        if "<|" not in text and not _other.search(text):
            text = _seam.sub(r" \g<0> ", text.lower())
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text its ids, closed by the closing id, as unsigned 32-bit numbers."""
        if not texts:
            return []
        words = [self.words(t) for t in texts]
        n = np.fromiter(map(len, words), np.int64, len(words))
        w = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
        self.learn()
        count = self.count[w]
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(self.first[w] - (ends - count), count) + np.arange(int(count.sum()))]
        if self.held > KEPT:
            self.clear()
        return [np.append(part, np.uint32(self.closing)) for part in np.split(ids, np.r_[0, ends][np.cumsum(n)[:-1]])]


#: Characters beyond the Latin blocks; and whole runs of signs, where the tokenizer parts words.
_other = re.compile("[^\x00-\u024f]")
_seam = re.compile(r"(?<![^a-z0-9\u00e0-\u00f6\u00f8-\u00ff \n])[.,!?;:#$%&*|]+(?![^a-z0-9\u00e0-\u00f6\u00f8-\u00ff \n])")


_encoders: dict[str, WordEncoder] = {}


def encoder_for(path: str) -> WordEncoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32)."""
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        for whole in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < whole.num_rows:  # some texts at a time, by their size
                before = sizes[at - 1] if at else 0
                n = max(1, min(256, int(np.searchsorted(sizes, before + AT_ONCE, "right")) - at))
                batch = whole.slice(at, n)
                at += n
                rows = [
                    (doc, k, k * capacity, len(part), zlib.crc32(part.astype("<u4").tobytes()))
                    for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True)
                    for k, part in enumerate(ids[s : s + capacity] for s in range(0, len(ids), capacity))
                ]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, rank after the last, first sequence, pieces a sequence, offset).

    Piece of rank r goes to sequence ``first + (r - first rank) // pieces`` at ``offset + (r - first rank) % pieces * length``.
    Sequences with the same content so far are one run of numbers, so the plan's size follows from ``capacity`` and not from
    the number of pieces.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}  # tokens left -> runs (first sequence, number)
    sizes: list[int] = []  # keys of ``free`` in order
    sequences = 0

    def give_back(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in free:
                bisect.insort(sizes, left)
            free.setdefault(left, []).append((first, n))

    for length in sorted((k for k in histogram if k > 0), reverse=True):
        rank, rest = 0, histogram[length]
        while rest:
            k = bisect.bisect_left(sizes, length)
            if k < len(sizes):
                left = sizes[k]
                first, n = free[left].pop()
                if not free[left]:
                    del free[left], sizes[k]
            else:
                left, first = capacity, sequences
                n = -(-rest // (capacity // length))
                sequences += n
            each = left // length  # best fit goes on with the sequence it has just filled, which now fits tighter
            full = min(n, rest // each)
            if full:
                rows.append((length, rank, rank + full * each, first, each, capacity - left))
                give_back(left - each * length, first, full)
                rank, rest, first, n = rank + full * each, rest - full * each, first + full, n - full
            if rest and n and rest < each:
                rows.append((length, rank, rank + rest, first, rest, capacity - left))
                give_back(left - rest * length, first, 1)
                rank, rest, first, n = rank + rest, 0, first + 1, n - 1
            give_back(left, first, n)
    return rows


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece."""
    spark = docs.sparkSession
    cut = settle(pieces(docs, tokenizer_path, capacity))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # ``capacity`` rows at most
    rows = plan(histogram, capacity)
    buckets = max(16, sum(histogram.values()) // BUCKET)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    ranked = cut.withColumn("k", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    sums = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "bucket", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    ranked = ranked.join(sums, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("k"))
    slots = spark.createDataFrame(rows, "p_length long, p_from long, p_to long, p_first long, p_each long, p_offset long")
    # the plan's size is bounded by the capacity alone
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_from")) & (F.col("rank") < F.col("p_to")))
    nth = F.col("rank") - F.col("p_from")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("p_first") + F.expr("(rank - p_from) div p_each")).alias("sequence_id"),
        (F.col("p_offset") + nth % F.col("p_each") * F.col("length")).alias("offset"),
    )
