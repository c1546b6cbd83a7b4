"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters.

The model of each language is trained on its trusted texts (``labels``: good and not toxic), all but every HELD_OUT-th. Counts are
tables that are sharded by n-gram: raw counts for ORDER characters, continuation counts (in how many different longer n-grams)
below, with three discounts for each order and language from its counts of counts. The n-grams that occur anywhere in the
corpus are gathered once each (they are combined within each task first, so a common n-gram costs a row a task), and the count
joins, order by order, give each its probability.

Probabilities return to the documents by a join as well: a piece is PIECE_ROWS rows in a row of a file, pieces are dealt to blocks of
about BLOCK_ROWS rows, a block's different n-grams are joined with their probabilities, and the block's table is written in a place
of its own in the shared folder. The task that reads a piece takes its block's table from there and adds up. So the documents do
not move, nothing passes through the driver, and what a task holds is the n-grams of a block. Within a block's table n-grams are
known by a 64-bit hash. A document's perplexity is the mean over its characters. Documents that do not come straight from files
are stored first.

A language's threshold is that one of the QUANTILES of the trusted texts that were held out for which the share of labelled bad
texts (toxic or poor) above it exceeds the share of held-out ones above it by most, the higher one of equals. A language without
labelled bad texts has the median and FENCE times the spread from it to the 95th hundredth, of logarithms. A document at the
threshold is kept.

Toxic texts may be made of a language's most common n-grams. So a second model of the same kind is trained on the labelled toxic
texts (all but every HELD_OUT-th), each n-gram has its probability under both, and a document's contrast is how much likelier a
character of it is under the second. Its threshold is found in the same way among the CONTRASTS of held-out trusted texts, with
the toxic texts that were held out; a language without such texts has none.

A character is its whole code point (21 bits), an n-gram two numbers: the first two and the last three characters. White space
counts as one blank; a text starts after ORDER - 1 zero characters.

Defined results: a null or blank text has no characters, a null perplexity, and is kept; a null language is a language; a
language without trusted texts has no threshold and keeps its documents; every row is scored on its own, so repeated rows, and
rows with null or repeated ids, stay as they are; a very long text is read whole; empty tables give an empty result; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Tables, file_system, new_path, settle

ORDER, BITS, FENCE, HELD_OUT = 5, 21, 4.0, 5
#: Rows of a file that go together, rows whose n-grams share a table, characters that are looked at together.
PIECE_ROWS, BLOCK_ROWS, AT_ONCE = 16_384, 131_072, 1 << 18
#: N-grams that a task holds before it passes them on; trusted ids and languages that are broadcast: with more, their joins are shuffled.
HELD_GRAMS, BROADCAST_IDS, BROADCAST_LANGS = 1_500_000, 4_000_000, 10_000
LEAST_SPREAD = 0.02
#: The quantiles of held-out trusted texts that a threshold is chosen from: one in ten to one in a hundred of them are lost.
QUANTILES = (0.9, 0.925, 0.95, 0.975, 0.99)
CONTRASTS = (0.95, 0.975, 0.99, 0.995)
#: The models, by the sort of texts that they learn from.
MODELS = ("good", "toxic")
ONE, TWO = (1 << BITS) - 1, (1 << 2 * BITS) - 1
KEY = ["lang", "a", "b"]


def blanked(text: str | None) -> str:
    return " ".join((text or "").split())


def codes(joined: str, start: int = 0, stop: int | None = None, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end at the characters from ``start`` to ``stop``: the first characters, and the last three."""
    stop = len(joined) if stop is None else stop
    before = min(start, order - 1)
    points = np.frombuffer(joined[start - before : stop].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    padded = np.concatenate([np.zeros(order - 1 - before, np.int64), points])
    n = max(stop - start, 0)
    if order != 5:
        parts = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
        for k in range(order if n else 0):
            parts[k >= order - 3] = (parts[k >= order - 3] << BITS) | padded[k : k + n]
        return parts[0], parts[1]
    pairs = (padded[:-1] << BITS) | padded[1:]
    return pairs[:n], (pairs[2 : 2 + n] << BITS) | padded[4 : 4 + n]


def stretches(texts: list[str | None]) -> Iterator[list[tuple[int, str, int, int]]]:
    """The texts' characters in stretches (text, its characters, first, after the last) of AT_ONCE together at most."""
    out, held = [], 0
    for k, text in enumerate(texts):
        joined = blanked(text)
        for start in range(0, len(joined), AT_ONCE):
            stop = min(start + AT_ONCE, len(joined))
            if out and held + stop - start > AT_ONCE:
                yield out
                out, held = [], 0
            out.append((k, joined, start, stop))
            held += stop - start
    if out:
        yield out


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of n-grams."""
    with np.errstate(over="ignore"):
        h = (a.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ b.view(np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def rows_in(docs: DataFrame, n: int, tables: Tables) -> DataFrame:
    """(doc_id, lang, text, block)."""
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text")]
    blocks = max(1, -(-n // BLOCK_ROWS))
    block = F.pmod(F.xxhash64(F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / PIECE_ROWS)), F.lit(blocks)).alias("block")
    try:
        return docs.select(*own, block)
    except AnalysisException:  # not straight from files
        return tables.store(docs.select(*own)).select("doc_id", "lang", "text", block)


def merged(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal n-grams added up (but for those whose hashes clash, which may stay apart); in order of their hashes."""
    if not len(a):
        return a, b, n
    order = np.argsort(mixed(a, b), kind="stable")  # fast on what was merged before
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[first], b[first], np.add.reduceat(n, first)


def grams_in(rows: DataFrame, n_docs: int) -> DataFrame:
    """(block, lang, a, b, n): highest-order n-grams, combined within each task as far as HELD_GRAMS allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], list[tuple]] = {}
        size = 0

        def gather() -> int:
            for key, parts in held.items():
                held[key] = [merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
            return sum(len(parts[0][0]) for parts in held.values())

        def flush() -> Iterator[pa.RecordBatch]:
            gather()
            for (block, lang), ((a, b, n),) in held.items():
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(block, pa.int64()), len(a)), pa.repeat(pa.scalar(lang, pa.string()), len(a)), pa.array(a), pa.array(b), pa.array(n)], ["block", *KEY, "n"])
            held.clear()

        for batch in batches:
            by_key: dict[tuple[int, str], list[str | None]] = {}
            for lang, text, block in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                by_key.setdefault((block, lang), []).append(text)
            for key, texts in by_key.items():
                for group in stretches(texts):
                    a, b = (np.concatenate(x) for x in zip(*(codes(*g[1:]) for g in group), strict=True))
                    own = merged(a, b, np.ones(len(a), np.int64))
                    held.setdefault(key, []).append(own)
                    size += len(own[0])
                    if size > HELD_GRAMS:
                        size = gather()
                        if 3 * size > 2 * HELD_GRAMS:
                            yield from flush()
                            size = 0
        yield from flush()

    # a table of very many small files is read by fewer tasks, so that a common n-gram is not a row for each file
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, 2 * -(-n_docs // PIECE_ROWS))
    return rows.select("lang", "text", "block").coalesce(parts).mapInArrow(run, "block long, lang string, a long, b long, n long")


def gram_counts(rows: DataFrame, n_docs: int) -> DataFrame:
    """(lang, a, b, n0, n1): how often each model has met an n-gram, null for never. ``rows`` have the model's number before their language."""
    number, lang = F.split("lang", ":", 2)[0], F.split("lang", ":", 2)[1]
    found = grams_in(rows, n_docs).select(number.alias("model"), lang.alias("lang"), "a", "b", "n")
    return found.groupBy(*KEY).agg(*(F.sum(F.when(F.col("model") == str(m), F.col("n"))).alias(f"n{m}") for m in range(len(MODELS))))


def block_grams(rows: DataFrame, n_docs: int) -> DataFrame:
    """(block, lang, a, b, first): the different n-grams of each block; ``first`` for one block of each n-gram."""
    before = F.lag("block").over(Window.partitionBy(*KEY).orderBy("block"))
    found = grams_in(rows, n_docs).select("block", *KEY).withColumn("before", before).where("before IS NULL OR before <> block")
    return found.select("block", *KEY, F.col("before").isNull().alias("first"))


def suffix(order: int) -> list[Column]:
    """The n-gram of ``order`` characters without its first one."""
    a = F.col("a").bitwiseAND(F.lit(ONE)) if order == 5 else F.lit(0).cast("long")
    b = F.col("b") if order > 3 else F.col("b").bitwiseAND(F.lit(TWO if order == 3 else ONE))
    return [a.alias("a"), b.alias("b")]


def context(order: int) -> list[Column]:
    """The n-gram without its last character, as (ha, hb)."""
    b = F.shiftrightunsigned("b", BITS).bitwiseOR(F.shiftleft(F.col("a").bitwiseAND(F.lit(ONE)), 2 * BITS))
    return [F.shiftrightunsigned("a", BITS).alias("ha"), b.alias("hb")]


def each(rule: Callable[[int], Column]) -> list[Column]:
    """A column for each model."""
    return [rule(m) for m in range(len(MODELS))]


def discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3 of each model) from the counts of counts; where these are too few, half of a count of one and less of more."""
    n = counts.groupBy("lang").agg(*[F.count_if(F.col(f"n{m}") == k).cast("double").alias(f"c{k}_{m}") for k in (1, 2, 3, 4) for m in range(len(MODELS))])

    def rule(k: int, m: int) -> Column:
        c = {j: F.col(f"c{j}_{m}") for j in (1, 2, 3, 4)}
        y = c[1] / (c[1] + 2 * c[2])
        usable = (c[1] > 0) & (c[2] > 0) & (c[3] > 0)
        return F.when(usable, F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), k - (k + 1) * y * c[k + 1] / c[k]))).otherwise(0.5).alias(f"d{k}_{m}")

    return n.select("lang", *[rule(k, m) for k in (1, 2, 3) for m in range(len(MODELS))])


def discount(m: int) -> Column:
    n = F.col(f"n{m}")
    return F.when(n >= 3, F.col(f"d3_{m}")).when(n == 2, F.col(f"d2_{m}")).when(n == 1, F.col(f"d1_{m}"))


class Model:
    """Count tables of all orders, the models side by side, so that an n-gram is a row for all of them and moves once.

    ``counts[k]``: (lang, a, b, left), ``contexts[k]``: (lang, ha, hb, total, weight of what was discounted); null for what a model has not met.
    """

    def __init__(self, highest: DataFrame, tables: Tables, order: int = ORDER):
        self.order, self.counts, self.contexts = order, {}, {}
        table = highest
        for k in range(order, 0, -1):
            table = tables.store(table)
            cuts = settle(discounts(table))  # a row a language
            cuts = F.broadcast(cuts) if cuts.count() <= BROADCAST_LANGS else cuts
            counts = table.join(cuts, "lang").select(*KEY, *each(lambda m: F.col(f"n{m}")), *each(lambda m: discount(m).alias(f"d{m}")))
            self.counts[k] = counts.select(*KEY, *each(lambda m: (F.col(f"n{m}") - F.col(f"d{m}")).alias(f"left{m}")))
            sums = [f(m) for m in range(len(MODELS)) for f in (lambda m: F.sum(f"n{m}").cast("double").alias(f"total{m}"), lambda m: F.sum(f"d{m}").alias(f"cut{m}"))]
            self.contexts[k] = counts.groupBy("lang", *context(k)).agg(*sums)
            if k > 1:
                met = lambda m: F.count(f"n{m}")
                table = table.groupBy("lang", *suffix(k)).agg(*each(lambda m: F.when(met(m) > 0, met(m)).alias(f"n{m}")))
        self.sizes = table.groupBy("lang").agg(*each(lambda m: F.when(F.count(f"n{m}") > 0, F.count(f"n{m}") + 1).cast("double").alias(f"size{m}")))

    def score(self, sets: dict[int, DataFrame]) -> DataFrame:
        """(lang, a, b, p0, p1) of the n-grams ``sets[order]`` by one count join and one context join for each order, from the lowest up."""
        below = None
        for k in range(1, self.order + 1):
            grams = sets[k].join(self.counts[k], KEY, "left")
            grams = grams.select("*", *context(k)).join(self.contexts[k], ["lang", "ha", "hb"], "left")
            if below is None:
                grams = grams.join(self.sizes, "lang", "left").select("*", *each(lambda m: (1 / F.coalesce(f"size{m}", F.lit(2.0))).alias(f"lower{m}")))
            else:
                shorter = grams.select("*", *(c.alias(n) for c, n in zip(suffix(k), ("sa", "sb"), strict=True)))
                grams = shorter.join(below.select("lang", F.col("a").alias("sa"), F.col("b").alias("sb"), *each(lambda m: F.col(f"p{m}").alias(f"lower{m}"))), ["lang", "sa", "sb"])
            seen = lambda m: (F.coalesce(f"left{m}", F.lit(0.0)) + F.col(f"cut{m}") * F.col(f"lower{m}")) / F.col(f"total{m}")
            below = grams.select(*KEY, *each(lambda m: F.when(F.col(f"total{m}").isNull(), F.col(f"lower{m}")).otherwise(seen(m)).alias(f"p{m}")))
        return below


def gram_sets(wanted: DataFrame, tables: Tables, order: int = ORDER) -> dict[int, DataFrame]:
    """The n-grams ``wanted`` (lang, a, b) and the shorter ones that they end in, of each order; stored, as every model reads them."""
    sets = {order: wanted}
    for k in range(order, 1, -1):
        sets[k - 1] = tables.store(sets[k].select("lang", *suffix(k)).distinct())
    return sets


class Scores:
    """Look-up of n-grams, by their hashes, in an open-addressed table; what is not in it counts as zero."""

    def __init__(self, a: np.ndarray, b: np.ndarray, *logs: np.ndarray):
        self.bits = max(4, int(1.5 * len(a)).bit_length())
        size = 1 << self.bits
        self.keys, self.logs = np.zeros(size, np.uint64), np.zeros((size + 1, len(logs)), np.float32)  # key 0: free; the last row is for what is not found
        values, keys = np.stack(logs, axis=1), self._keys(a, b)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = keys[free]  # of several for one place the last stays
            won = left[self.keys[at[left]] == keys[left]]
            self.logs[at[won]] = values[won]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (size - 1)

    @staticmethod
    def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum(mixed(a, b), np.uint64(1))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The logarithms of each n-gram."""
        keys = self._keys(a, b)
        at = self._home(keys)
        own = self.keys[at]
        lost = np.flatnonzero(own != keys)
        while len(lost):
            gone = self.keys[at[lost]] == 0
            at[lost[gone]] = len(self.keys)
            lost = lost[~gone]
            at[lost] = (at[lost] + 1) & (len(self.keys) - 1)
            lost = lost[self.keys[at[lost]] != keys[lost]]
        return self.logs[at]


def block_tables(grams: DataFrame, scored: DataFrame) -> str:
    """Writes (lang, a, b, log_p, log_q) of each block's n-grams under block=<number>, and returns where."""
    path = new_path(grams.sparkSession, "scores")
    grams.join(scored, KEY).repartition("block").sortWithinPartitions("block", *KEY).write.partitionBy("block").option("compression", "zstd").parquet(path)
    return path


def load_block(path: str, block: int) -> dict[str, Scores]:
    """A block's tables, a language each."""
    from pyarrow import fs

    store, at = file_system(path)
    found: dict[str, Scores] = {}
    files = [x.path for x in store.get_file_info(fs.FileSelector(f"{at}/block={block}", allow_not_found=True)) if x.base_name.endswith(".parquet")]
    if files:
        rows = pa.concat_tables(pq.ParquetFile(store.open_input_file(x)).read(["lang", "a", "b", "log_p", "log_q"]) for x in sorted(files)).combine_chunks()
        lang = rows.column("lang").combine_chunks().dictionary_encode()
        at, columns = lang.indices.to_numpy(zero_copy_only=False), [rows.column(c).to_numpy() for c in ("a", "b", "log_p", "log_q")]
        for k, name in enumerate(lang.dictionary.to_pylist()):
            found[name] = Scores(*(c[at == k] for c in columns))
    return found


def add_up(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, lang, log_p, log_q, n): the sums over a row's characters, with the table of the row's block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = None, {}
        for batch in batches:
            sums = np.zeros((batch.num_rows, 3))
            by_key: dict[tuple[int, str], list[int]] = {}
            for k, (lang, block) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                by_key.setdefault((block, lang), []).append(k)
            for block, lang in sorted(by_key, key=lambda x: (x[0] != known, x)):
                places = by_key[block, lang]
                if block != known:
                    known, own = block, load_block(path, block)
                for group in stretches(batch.column(2).take(pa.array(places)).to_pylist()) if lang in own else ():
                    logs = own[lang].of(*(np.concatenate(x) for x in zip(*(codes(*g[1:]) for g in group), strict=True)))
                    n = np.array([stop - start for *_, start, stop in group])
                    added = np.add.reduceat(logs, np.cumsum(n) - n, axis=0, dtype=np.float64)
                    np.add.at(sums, np.array(places)[[k for k, *_ in group]], np.column_stack([added, n]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array(sums[:, 2].astype(np.int64))], ["doc_id", "lang", "log_p", "log_q", "n"])

    return rows.select("doc_id", "lang", "text", "block").mapInArrow(run, "doc_id long, lang string, log_p double, log_q double, n long")


def document_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, sort, held_out, n_chars, perplexity, contrast), a row for each row of ``docs``, stored.

    ``sort``: good, toxic, poor or null by the labels; ``held_out``: no model has learnt from it.
    """
    tables, texts = Tables(docs.sparkSession), Tables(docs.sparkSession)
    n = docs.count()
    rows = rows_in(docs, n, texts)
    sort = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), sort.alias("sort")).where("sort IS NOT NULL").groupBy("doc_id").agg(F.max("sort").alias("sort"))
    labelled = labelled.withColumn("held_out", (F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0) | (F.col("sort") == "poor"))
    learnt = labelled.where("NOT held_out").select("doc_id", F.col("sort").alias("model"))
    if learnt.count() <= BROADCAST_IDS:
        learnt = F.broadcast(learnt)
    number = F.when(F.col("model") == MODELS[0], "0:").otherwise("1:")
    model = Model(gram_counts(rows.join(learnt, "doc_id").select(F.concat(number, "lang").alias("lang"), "text", "block"), n), tables)
    grams = tables.store(block_grams(rows, n))
    wanted = grams.where("first").select(*KEY)
    scored = tables.store(model.score(gram_sets(wanted, tables)).select(*KEY, *(F.log(f"p{m}").cast("float").alias(x) for m, x in enumerate(("log_p", "log_q")))))
    texts.paths.append(path := block_tables(grams.drop("first"), scored))
    known = settle(model.sizes.where("size1 IS NOT NULL").select("lang", F.lit(True).alias("known")))
    tables.clear()
    marked = add_up(rows, path).join(labelled, "doc_id", "left").join(known, "lang", "left")
    contrast = F.when((F.col("n") > 0) & F.col("known"), (F.col("log_q") - F.col("log_p")) / F.col("n"))
    out = settle(marked.select("doc_id", "lang", "sort", F.coalesce("held_out", F.lit(False)).alias("held_out"), F.col("n").alias("n_chars"), F.when(F.col("n") > 0, F.exp(-F.col("log_p") / F.col("n"))).alias("perplexity"), contrast.alias("contrast")))
    texts.clear()
    return out


def limits(scores: DataFrame, value: str, bad: Column, quantiles: tuple[float, ...], fence: float | None) -> DataFrame:
    """(lang, limit of ``value``): the quantile of held-out good texts that parts them best from ``bad`` ones."""
    marked = scores.where(F.col(value).isNotNull()).withColumn("good", F.col("held_out") & (F.col("sort") == "good")).withColumn("bad", bad).where("good OR bad")
    found = marked.where("good").groupBy("lang").agg(F.percentile_approx(value, [0.5, 0.95, *quantiles], 10_000).alias("q"))
    above = lambda k, side: F.avg(F.when(F.col(side), (F.col(value) > F.col("q")[2 + k]).cast("double")))
    gains = [F.struct((above(k, "bad") - above(k, "good")).alias("gain"), F.first(F.col("q")[2 + k]).alias("limit")) for k in range(len(quantiles))]
    chosen = marked.join(found, "lang").groupBy("lang").agg(F.array_max(F.array(*gains)).alias("best"))
    fenced = F.col("q")[0] + fence * F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(LEAST_SPREAD)) if fence is not None else F.lit(None).cast("double")
    return found.join(chosen, "lang").select("lang", F.when(F.col("best.gain").isNull(), fenced).otherwise(F.col("best.limit")).alias("limit"))


def classify(docs: DataFrame, labels: DataFrame, fence: float = FENCE) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold, contrast, contrast_threshold, kept: one row for each row of ``docs``."""
    scores = document_scores(docs, labels)
    by_p = limits(scores.withColumn("log", F.log("perplexity")), "log", F.col("sort").isin("toxic", "poor"), QUANTILES, fence).select("lang", F.exp("limit").alias("threshold"))
    by_q = limits(scores, "contrast", (F.col("sort") == "toxic") & F.col("held_out"), CONTRASTS, None).select("lang", F.col("limit").alias("contrast_threshold"))
    cuts = settle(by_p.join(by_q, "lang", "full"))  # a row a language
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold") * (1 + 1e-12), F.lit(True)) & F.coalesce(F.col("contrast") <= F.col("contrast_threshold"), F.lit(True))
    return scores.join(cuts, "lang", "left").select("doc_id", "lang", "n_chars", "perplexity", "threshold", "contrast", "contrast_threshold", kept.alias("kept"))
