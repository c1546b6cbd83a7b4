"""Scores of texts by a probabilistic suffix tree: contexts of up to ORDER words, kept where they tell more than their suffix does.

Tokens are a text's words and one end. The root's distribution is that of the base score. A context is a candidate if it occurs at least
MIN_COUNT times in training texts, and becomes a state if the divergence test holds: with every occurrence left out in turn, its own smoothed
distribution must give its successors a probability that is more than GAIN nats higher, in all, than that of the longest state that it ends in.
A state's distribution is smoothed by that state's: (c + T p) / (C + T), for c of C occurrences and T different
successors. A token is scored in the longest state that its text's words before it end in; a text's start is a symbol of contexts as well.

How it runs. Texts are parsed once, into blocks: rows that hold the token numbers of about BLOCK_TOKENS tokens and the words that these stand for.
Words are counted in shards by their hash, and each gets a number of its own for the whole corpus. Then, level by level, a block sends to each shard of
contexts its different (context, successor) pairs with their counts and the parent's probabilities, and gets back for each pair its count in the
corpus and a number for the longer context that it makes, for each context whether it is a state, and the number of its successors. A block's share for a shard is one row, packed in as few bytes as
it needs. Counts are over whole training texts; a longer context is counted only if the shorter one was frequent enough, which loses none, since it can't be more frequent. Scoring
works on the same blocks, so texts don't move. What comes back is written to the shared folder by groups of blocks, and the tasks that read a group's blocks read it there.

Size. A block is a bounded number of tokens and one text at least; shards follow the corpus (SHARD_TOKENS tokens each). A context with HOT_COUNT occurrences or more is
dealt to several shards by its successors, and its parts are added up by a small aggregation before the test (which is then the plain divergence, as nothing is gained by leaving one of so many out).
Nothing that grows with the corpus passes through the driver.

Defined results: a null or blank text is one end; a null doc_id learns, as crc32 of nothing is 0, and stays null; repeated rows count each; a very long text is
a block of its own; with no training texts N and V are 0 and every token has the base probability 1; ties have no order that matters; an empty table gives an empty result; other columns are not looked at.
The test takes the parent's probabilities to 1/16 of a nat. Numbers replace words exactly: no hash stands for a word or context.
"""

from __future__ import annotations

import gc
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import CRC_TABLE, Tables, crc32_sql, documents, file_system, new_path, settle

ORDER, MIN_COUNT, GAIN, NATS = 2, 4, 3.0, 16
FOLDS, HELD_OUT = 5, 1
BLOCK_TOKENS, SHARD_TOKENS, HOT_COUNT = 1 << 20, 1 << 22, 1 << 18
BLOCK = "block long, bin int, doc_ids array<long>, held array<boolean>, lengths binary, ids binary, words binary, n_tokens long, n_train long"
SENT = "shard int, block long, bin int, a binary, b binary, c binary, d binary, e binary"
BACK = "block long, bin int, shard int, a binary, b binary, c binary, hot_states array<long>, hot_parts array<array<double>>"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def tokens(text: bytes | None) -> list[bytes]:
    """Words of the UTF-8 bytes (bytes.lower and bytes.split know ASCII alone), then the end, an empty one."""
    return [*(text or b"").lower().split(), b""]


def pack(x: np.ndarray) -> bytes:
    """Numbers from 0 on, in as many byte planes as the largest needs, compressed."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.compress(planes.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    width, planes = data[0], np.frombuffer(zstandard.decompress(data[1:]), np.uint8)
    out = np.zeros((len(planes) // width, 8), np.uint8)
    out[:, :width] = planes.reshape(width, -1).T
    return out.view("<i8").ravel()


def pack_steps(x: np.ndarray) -> bytes:
    """Numbers by their steps, for those that nearly ascend."""
    d = np.diff(x, prepend=0)
    return pack(np.where(d < 0, -2 * d - 1, 2 * d))


def unpack_steps(data: bytes) -> np.ndarray:
    d = unpack(data)
    return np.cumsum(np.where(d & 1, -(d >> 1) - 1, d >> 1))


def pack_words(words: list[bytes]) -> bytes:
    sizes = pack(np.fromiter(map(len, words), np.int64, len(words)))
    return len(sizes).to_bytes(8, "little") + sizes + zstandard.compress(b"".join(words), 1)


def unpack_words(data: bytes) -> list[bytes]:
    n = 8 + int.from_bytes(data[:8], "little")
    ends = np.cumsum(unpack(data[8:n])).tolist()
    joined = zstandard.decompress(data[n:])
    return [joined[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}
    names, types = zip(*(c.split(" ") for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[t]) for v, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def blocks(docs: DataFrame) -> DataFrame:
    """The texts as BLOCK rows; ``bin`` is the task that made a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), count()

        def flush() -> pa.RecordBatch:
            lengths, held = np.array([len(x) for x in ids]), np.array([held_out(i) for i in doc_ids])
            row = ((part << 24) + next(made), part, doc_ids, held.tolist(), pack(lengths), pack(np.concatenate(ids)), pack_words(list(numbers)), int(lengths.sum()), int(lengths[~held].sum()))
            return batch_of([row], BLOCK)

        doc_ids, ids, size, numbers = [], [], 0, defaultdict(count().__next__)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = tokens(text.as_py())
                doc_ids.append(doc_id)
                ids.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                size += len(words)
                if size >= BLOCK_TOKENS:
                    yield flush()
                    doc_ids, ids, size, numbers = [], [], 0, defaultdict(count().__next__)
        if doc_ids:
            yield flush()

    return documents(docs, "binary").mapInArrow(run, BLOCK)


class Answers:
    """What was written for the blocks of a bin, by block and shard; the last bin is kept. ``hot``: where the answers of hot contexts are, if there are any."""

    def __init__(self, path: str, hot: str | None = None):
        self.paths, self.bin, self.rows = [path, *([hot] if hot else [])], None, {}

    def of(self, bin_: int, block: int) -> dict[int, dict]:
        if bin_ != self.bin:
            from pyarrow import fs

            self.bin, self.rows = bin_, {}
            for store, at in map(file_system, self.paths):
                for x in store.get_file_info(fs.FileSelector(f"{at}/bin={bin_}", allow_not_found=True)):
                    if x.base_name.endswith(".parquet"):
                        with store.open_input_file(x.path) as file:
                            for row in pq.ParquetFile(file).read().to_pylist():
                                self.rows.setdefault(row["block"], {}).setdefault(row["shard"], {}).update(row)
        return self.rows.get(block, {})


class Shards:
    """How words and contexts are dealt to shards; counts of the whole corpus."""

    def __init__(self, n: int, hot: int, train: int = 0, vocabulary: int = 0):
        self.n, self.hot, self.train, self.vocabulary = n, hot, train, vocabulary

    def of_words(self, words: list[bytes]) -> np.ndarray:
        return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(self.n)).astype(np.int64)

    def of_pairs(self, states: np.ndarray, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
        parts = 1 + counts // self.hot
        with np.errstate(over="ignore"):
            h = (states.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ ((words % parts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h >> np.uint64(20)) % np.uint64(self.n)).astype(np.int64)

    def root(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.train + 0.5 * (self.vocabulary + 1))


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of ``keys`` begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


class Pairs:
    """The different (context, successor) pairs of a block at one level, and those of them that are sent, in the order of shards.

    A pair that only unlearnt texts of the block have, and whose shorter one was never learnt, has count 0 and stays here, unless it is the first of its context, whose answer it brings.
    """

    def __init__(self, text: Text, shards: Shards):
        self.at = np.flatnonzero(text.seen >= MIN_COUNT)
        states, own = np.unique(text.state[self.at], return_inverse=True)
        keys, first, self.of = np.unique(own * len(text.number) + text.ids[self.at], return_index=True, return_inverse=True)
        place, self.context = self.at[first], keys // max(len(text.number), 1)
        n = np.bincount(self.of, text.learnt[self.at], len(keys)).astype(np.int64)
        new = np.zeros(len(keys), bool)
        new[runs(self.context)] = True
        some = np.flatnonzero((n > 0) | (text.bound[place] > 0) | new)
        place, self.contexts = place[some], len(states)
        words, state, seen = text.number[text.ids[place]], text.state[place], text.seen[place]
        shard = shards.of_pairs(state, seen, words)
        order = np.argsort(shard.astype(np.uint16) if shards.n < 1 << 16 else shard, kind="stable")
        self.order = some[order]
        self.shard, self.words, self.state, self.n, self.seen = shard[order], words[order], state[order], n[self.order], seen[order]
        # only what has been learnt needs the parent's probability, which is the same in every block
        self.loss = np.where(self.n > 0, np.rint(-np.log(text.p[place][order]) * NATS), 0).clip(0, 65535).astype(np.int64)
        self.runs, self.hot, self.shards = runs(self.shard, self.state), self.seen >= shards.hot, shards.n

    def sent(self) -> Iterator[tuple[int, list[bytes]]]:
        """By shard: contexts and whether they are hot, the number of their pairs, successors, counts, the parent's losses."""
        for a, b in zip(cut := runs(self.shard), np.append(cut[1:], len(self.shard))[: len(cut)], strict=True):
            at = self.runs[np.searchsorted(self.runs, a) : np.searchsorted(self.runs, b)]
            yield int(self.shard[a]), [pack(np.diff(2 * self.state[at] + self.hot[at], prepend=0)), pack(np.diff(np.append(at, b))), pack(self.words[a:b]), pack(self.n[a:b]), pack(self.loss[a:b])]

    def back(self, answers: dict[int, dict]) -> tuple[np.ndarray, ...]:
        """By pair in the order of ``of``: count, successors of the context, whether it is a state, number of the longer context."""
        rows = [answers[s] for s in self.shard[runs(self.shard)].tolist()]
        join = lambda c: np.concatenate([unpack(r[c]) for r in rows]) if rows else np.zeros(0, np.int64)
        counts, heads = join("a"), join("b")
        longer = np.concatenate([unpack_steps(r["c"]) for r in rows]) if rows else np.zeros(0, np.int64)
        hot = {s: p for r in rows if r["hot_parts"] for s, p in zip(r["hot_states"], r["hot_parts"], strict=True)}
        for k in np.flatnonzero(self.hot[self.runs]).tolist():
            successors, keep = hot[int(self.state[self.runs[k]])]
            heads[k] = 2 * int(successors) + int(keep)
        numbers = np.zeros(len(counts), np.int64)
        numbers[counts >= MIN_COUNT] = longer
        numbers = np.where(numbers > 0, numbers * self.shards + self.shard, 0)  # a shard counts its own from 1
        out = [np.zeros(len(self.context), np.int64) for _ in range(2)]
        out[0][self.order], out[1][self.order] = counts, numbers
        by_context = np.zeros(self.contexts, np.int64)
        by_context[self.context[self.order[self.runs]]] = heads
        heads = by_context[self.context]
        return out[0], heads >> 1, heads & 1, out[1]


class Text:
    """A block's tokens: local ids, the numbers and counts of their words, and what the model says so far."""

    def __init__(self, row: dict, answers: dict[int, dict], shards: Shards):
        self.ids, lengths = unpack(row["ids"]), unpack(row["lengths"])
        self.number, self.count = (np.zeros(int(self.ids.max()) + 1, np.int64) for _ in range(2))
        for x in answers.values():
            at = unpack_steps(x["c"])
            self.number[at], self.count[at] = unpack(x["a"]), unpack(x["b"])
        self.starts = np.cumsum(lengths) - lengths
        self.learnt = np.repeat(~np.array(row["held"], bool), lengths)
        self.bound = self.count[self.ids]  # how often a longer pair can come at most
        self.p = self.base = shards.root(self.count)[self.ids]
        end = self.count[self.ids[lengths[0] - 1]]  # a text's last token
        self._shift(self.number[self.ids], self.count[self.ids], 0, end)

    def _shift(self, state: np.ndarray, seen: np.ndarray, first: int, first_seen: int) -> None:
        """The contexts of a level: those that end in the token before; ``first`` at a text's start."""
        self.state, self.seen = np.roll(state, 1), np.roll(seen, 1)
        self.state[self.starts], self.seen[self.starts] = first, first_seen

    def step(self, pairs: Pairs, answers: dict[int, dict]) -> None:
        """Takes a level's answers in, and goes on to contexts that are longer by one."""
        c, successors, keep, number = (x[pairs.of] for x in pairs.back(answers))
        seen, p = self.seen[pairs.at], self.p[pairs.at]
        self.p = self.p.copy()
        self.p[pairs.at] = np.where(keep, (c + successors * p) / (seen + successors), p)
        state, counts = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64)
        state[pairs.at], counts[pairs.at] = number, c
        self.bound = counts
        self._shift(state, counts, 0, 0)


def over_blocks(held: DataFrame, paths: list[tuple], shards: Shards, schema: str, what: Callable[[dict, Text, Pairs | None], Iterator[tuple]], last: bool) -> DataFrame:
    """``what`` over every block after as many levels as there are answers; the first of them are those of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [Answers(*p) for p in paths]
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                own = [f.of(row["bin"], row["block"]) for f in files]
                text = Text(row, own[0], shards)
                for answers in own[1:]:
                    text.step(Pairs(text, shards), answers)
                rows = list(what(row, text, None if last else Pairs(text, shards)))
                if rows:
                    yield batch_of(rows, schema)

    return held.mapInArrow(run, schema)


def by_shard(sent: DataFrame, merge: Callable[[int, list[dict]], Iterator[tuple]], shards: Shards) -> DataFrame:
    """``merge`` over all rows of a shard, shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard and rows:
                    yield batch_of(list(merge(shard, rows)), BACK)
                    rows = []
                shard = row["shard"]
                rows.append(row)
        if rows:
            yield batch_of(list(merge(shard, rows)), BACK)

    return sent.repartition(shards.n, "shard").sortWithinPartitions("shard", "block").mapInArrow(run, BACK)


def write_back(rows: DataFrame, bins: int, tables: Tables) -> str:
    """Answers by the bins of their blocks, in a place of their own."""
    path = new_path(rows.sparkSession, "answers")
    tables.paths.append(path)
    rows.repartition(bins, "bin").sortWithinPartitions("bin", "block").write.partitionBy("bin").option("compression", "zstd").parquet(path)
    return path


def send_words(held: DataFrame, shards: Shards) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                words, lengths = unpack_words(row["words"]), unpack(row["lengths"])
                n = np.bincount(unpack(row["ids"]), np.repeat(~np.array(row["held"], bool), lengths), len(words)).astype(np.int64)
                shard = shards.of_words(words)
                order = np.argsort(shard, kind="stable")
                cuts = runs(shard[order])
                groups = zip(cuts, [*cuts[1:], len(order)], strict=True)
                yield batch_of([(int(shard[order[a]]), row["block"], row["bin"], pack_words([words[i] for i in order[a:b]]), pack(n[order[a:b]]), pack_steps(order[a:b]), None, None) for a, b in groups], SENT)

    return held.mapInArrow(run, SENT)


def merge_words(n_shards: int) -> Callable[[int, list[dict]], Iterator[tuple]]:
    """Numbers from 1 on, the frequent words' first, and counts; one row of its own says how many words have been learnt."""

    def merge(shard: int, rows: list[dict]) -> Iterator[tuple]:
        total: dict[bytes, int] = {}
        for row in rows:
            for w, n in zip(unpack_words(row["a"]), unpack(row["b"]).tolist(), strict=True):
                total[w] = total.get(w, 0) + n
        number = {w: 1 + k * n_shards + shard for k, w in enumerate(sorted(total, key=lambda w: (-total[w], w)))}
        yield -1, -1, shard, None, None, None, None, [[float(sum(n > 0 for n in total.values()))]]
        for row in rows:
            words = unpack_words(row["a"])
            yield row["block"], row["bin"], shard, pack(np.array([number[w] for w in words])), pack(np.array([total[w] for w in words])), row["c"], None, None

    return merge


def merge_pairs(last: bool) -> Callable[[int, list[dict]], Iterator[tuple]]:
    """Counts, contexts with their test, numbers of longer contexts; hot contexts' parts in a row of their own."""

    def merge(shard: int, rows: list[dict]) -> Iterator[tuple]:
        heads, sizes, words, n, loss = ([unpack(r[c]) for r in rows] for c in "abcde")
        heads = [np.cumsum(h) for h in heads]  # they ascend within a block
        marks = np.concatenate([np.repeat(h, s) for h, s in zip(heads, sizes, strict=True)])
        words, n, loss = np.concatenate(words), np.concatenate(n), np.concatenate(loss)
        order = np.lexsort((words, marks))
        first = runs(marks[order], words[order])
        c = np.add.reduceat(n[order], first)
        head, p = marks[order][first], np.exp(-np.maximum.reduceat(loss[order], first) / NATS)
        own = runs(head)
        spans = np.diff(np.append(own, len(head)))
        successors, seen = np.add.reduceat((c > 0).astype(np.int64), own), np.add.reduceat(c, own)
        t, total = np.repeat(successors, spans), np.repeat(seen, spans)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(c > 0, c * (np.log((c - 1 + t * p) / (total - 1 + t)) - np.log(p)), 0.0)
            plain = np.where(c > 0, c * np.log(c / p), 0.0)
        keep = np.add.reduceat(gain, own) > GAIN
        hot = np.flatnonzero(head[own] & 1)
        yield -1, -1, shard, None, None, None, (head[own[hot]] >> 1).tolist(), np.column_stack([successors[hot], seen[hot], np.add.reduceat(plain, own)[hot]]).astype(float).tolist()
        longer = np.cumsum(c >= MIN_COUNT)
        entry = np.empty(len(order), np.int64)
        entry[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        answer = 2 * successors + keep
        at = 0
        for row, h, s in zip(rows, heads, sizes, strict=True):
            e = entry[at : at + int(s.sum())]
            at += len(e)
            counts = c[e]
            numbers = longer[e][counts >= MIN_COUNT]
            yield row["block"], row["bin"], shard, pack(counts), pack(answer[np.searchsorted(head[own], h)]), pack_steps(np.zeros_like(numbers) if last else numbers), (h[h & 1 == 1] >> 1).tolist(), None

    return merge


def settled_hot(path: str, bins: int, tables: Tables) -> str | None:
    """Where the successors and the test of hot contexts are, for the rows that name some; None if there are none."""
    answers = tables.spark.read.schema(BACK).parquet(path)
    parts = answers.where("bin < 0").select(F.explode(F.arrays_zip("hot_states", "hot_parts")).alias("x")).select(F.col("x.hot_states").alias("state"), F.col("x.hot_parts").alias("p"))
    sums = parts.groupBy("state").agg(*(F.sum(F.col("p")[k]).alias(n) for k, n in enumerate(("successors", "seen", "plain"))))
    tested = tables.store(sums.select("state", F.array("successors", (F.col("plain") - F.col("seen") * F.log("seen") > GAIN).cast("double")).alias("hot_part")))
    if tested.isEmpty():
        return None
    asked = answers.where("bin >= 0").select("bin", "block", "shard", F.explode("hot_states").alias("state"))
    found = asked.join(tested, "state").groupBy("bin", "block", "shard").agg(F.collect_list("state").alias("hot_states"), F.collect_list("hot_part").alias("hot_parts"))
    return write_back(found, bins, tables)


def release(spark: SparkSession) -> None:
    """A hint to the driver's JVM: what it no longer refers to is gone, so Spark drops the shuffles of results that have been stored."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def document_scores(row: dict, text: Text, _: Pairs | None) -> Iterator[tuple]:
    known = (text.count > 0)[text.ids].astype(np.int64)
    sums = [np.add.reduceat(x, text.starts) for x in (np.ones_like(known), known, np.log10(text.base), np.log10(text.p))]
    yield from zip(row["doc_ids"], row["held"], *(s.tolist() for s in sums), strict=True)


def sent_pairs(row: dict, _: Text, pairs: Pairs | None) -> Iterator[tuple]:
    for shard, data in pairs.sent():
        yield shard, row["block"], row["bin"], *data


def score(docs: DataFrame, order: int = ORDER, hot: int = HOT_COUNT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of ``docs``."""
    tables, whole = Tables(docs.sparkSession), Tables(docs.sparkSession)
    held = whole.store(blocks(docs))
    n_tokens, train, bins = held.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0)), F.count_distinct("bin")).first()
    parts = docs.sparkSession.sparkContext.defaultParallelism
    shards, bins = Shards(max(parts, -(-n_tokens // SHARD_TOKENS)), hot), max(parts, bins)
    spark = docs.sparkSession
    path = write_back(by_shard(send_words(held.select("block", "bin", "held", "lengths", "ids", "words"), shards), merge_words(shards.n), shards), bins, tables)
    heads = spark.read.schema(BACK).parquet(path).where("bin < 0")
    vocabulary = heads.agg(F.coalesce(F.sum(F.col("hot_parts")[0][0]), F.lit(0.0))).first()[0]
    shards, paths = Shards(shards.n, hot, train, int(vocabulary)), [(path, None)]
    held = tables.store(held.drop("words"))  # numbers stand for them from here on
    whole.clear()
    for level in range(1, order + 1):
        release(spark)
        sent = over_blocks(held, paths, shards, SENT, sent_pairs, False)
        path = write_back(by_shard(sent, merge_pairs(level == order), shards), bins, tables)
        paths.append((path, settled_hot(path, bins, tables)))
    release(spark)
    scores = over_blocks(held, paths, shards, SCORES, document_scores, True)
    out = settle(scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score")))
    tables.clear()
    return out


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _level(k: int) -> str:
    """Pairs, tested contexts and probabilities of a level; x{k-1} has p."""
    s = ", ".join(f"s{i}" for i in range(1, k + 1))
    return f"""
g{k} AS (SELECT {s}, w, any_value(p) AS p, count(*) FILTER (NOT held) AS c FROM x{k - 1} WHERE s{k} IS NOT NULL GROUP BY {s}, w),
h{k} AS (SELECT {s}, sum(c)::DOUBLE AS n, count(*) FILTER (c > 0) AS t FROM g{k} GROUP BY {s} HAVING sum(c) >= {MIN_COUNT}),
q{k} AS (SELECT g{k}.*, n, t, exp(-round(-ln(p) * {NATS}) / {NATS}) AS q FROM g{k} JOIN h{k} USING ({s})),
k{k} AS (SELECT {s}, sum(c * (ln((c - 1 + t * q) / (n - 1 + t)) - ln(q))) > {GAIN} AS keep FROM q{k} WHERE c > 0 GROUP BY {s}),
x{k} AS (SELECT x.* EXCLUDE (p), CASE WHEN keep THEN (q{k}.c + t * x.p) / (n + t) ELSE x.p END AS p FROM x{k - 1} x LEFT JOIN q{k} USING ({s}, w) LEFT JOIN k{k} USING ({s}))"""


#: One blank stands for a text's start, the empty word for its end. Numbers are rounded, as sums differ in their last places.
SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, {crc32_sql("coalesce(doc_id::VARCHAR, '')")} % {FOLDS} = {HELD_OUT} AS held, list_append(list_filter(regexp_split_to_array({_LOWER}, '[ 	-
]+'), lambda w: w <> ''), '') AS ws FROM documents, tab),
t AS (SELECT r, held, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
u AS (SELECT w, count(*) AS c FROM t WHERE NOT held GROUP BY w),
k AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM u),
x0 AS (SELECT r, held, w, coalesce(lag(w) OVER o, ' ') AS s1, CASE WHEN i > 1 THEN coalesce(lag(w, 2) OVER o, ' ') END AS s2, coalesce(c, 0) > 0 AS known, (coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)) AS base, base AS p
  FROM t LEFT JOIN u USING (w), k WINDOW o AS (PARTITION BY r ORDER BY i)),{_level(1)},{_level(2)},
f AS (SELECT r, count(*) AS n_tokens, count(*) FILTER (known) AS n_known, sum(log10(base)) AS base_score, sum(log10(p)) AS score FROM x2 GROUP BY r)
SELECT doc_id, held AS held_out, n_tokens, n_known, n AS train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score FROM d JOIN f USING (r), k
"""
