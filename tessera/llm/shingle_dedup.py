"""SimHash near-dedup verified by Jaccard similarity of word shingles, for the corpus pipeline.

Two documents are linked if their sets of SHINGLE-word shingles have a similarity of LEAST or more; groups are the connected
components. Equal sets are merged first. Candidates come from the vantage-point trees of ``simhash`` over the sets' fingerprints,
and, as a pair of similarity 0.8 has fingerprints some ten bits apart, where no triangle bound prunes, from MinHash as well:
BANDS bands of ROWS values each, so that such a pair shares no band in about 3 of a million cases. Each candidate pair is
verified on its sets unless its documents are linked already. Candidates are gathered by their components; a component over
BLOCK documents or BLOCK_BYTES of text is cut into blocks that meet pair by pair, so none is capped.

Defined results: as in ``simhash``, but a pair at exactly LEAST is linked, and doc_ids are not null (``keep_one`` puts keys in their place); texts without words are equal to each other, a text of fewer words than a shingle is one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import components, documents, settle
from tessera.llm.simhash import RADIUS, SEED, Forest, bits_of, digested, distance, fingerprint_links

SHINGLE, LEAST, BANDS, ROWS, BLOCK, BLOCK_BYTES = 5, 0.8, 32, 5, 512, 32 << 20
STEP = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(SEED)
MULTIPLY = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = text.lower().split()  # of bytes, as in ``simhash.fingerprint``
    if not words:
        return np.zeros(0, np.uint64)
    known = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(words)}
    w = np.array([known[x] for x in words], np.uint64)
    size = min(size, len(w))
    out = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ w[k : k + len(out)]) * STEP
        out ^= out >> np.uint64(29)
    return np.unique(out)


def digest(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED)


def bands(own: np.ndarray) -> np.ndarray:
    """A hash for each band, different bands apart; none without shingles."""
    if not len(own):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 4096):
        x = own[at : at + 4096, None] * MULTIPLY[None, :]
        least = np.minimum(least, ((x ^ (x >> np.uint64(32))) * STEP).min(axis=0))
    out = (least.reshape(BANDS, ROWS) * MIX).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return (out ^ (out >> np.uint64(31))) * STEP


def alike(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, node, fp, size, bands): node stands for the set of shingles, fp is its SimHash, size the text's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sets = [shingles(x or b"") for x in texts]
            nodes = np.array([digest(s) for s in sets], np.uint64).view(np.int64)
            marks = np.array([bits_of(s) for s in sets], np.uint64).view(np.int64)
            sizes = pa.array([len(x or b"") for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes), pa.array(marks), sizes, pa.array([bands(s).view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "digest", "node", "fp", "size", "bands"])

    return digested(docs).mapInArrow(run, "doc_id long, digest long, node long, fp long, size long, bands array<long>")


def verified(group: pa.Table) -> pa.Table:
    """(u, v): a spanning forest of the pairs of a group that are candidates and similar enough."""
    nodes = group.column("node").to_numpy()
    order = np.argsort(nodes, kind="stable")
    nodes = nodes[order]
    sets = [shingles(x or b"") for x in group.column("text").take(pa.array(order)).to_pylist()]
    forest, compared, buckets = Forest(len(sets)), set(), {}

    def compare(a: int, b: int) -> None:
        if (a, b) not in compared and (forest.find(np.array([a])) != forest.find(np.array([b])))[0]:
            compared.add((a, b))
            if alike(sets[a], sets[b]):
                forest.link(np.array([a]), np.array([b]))

    marks = np.array([bits_of(s) for s in sets], np.uint64)
    for a in range(len(sets)):  # fingerprints within the radius
        for b in (a + 1 + np.flatnonzero(distance(marks[a + 1 :], marks[a]) <= RADIUS)).tolist():
            compare(a, b)
    for k, own in enumerate(sets):
        for b in bands(own).tolist():
            buckets.setdefault(b, []).append(k)
    for bucket in buckets.values():
        members = np.array(bucket)
        for n, a in enumerate(bucket[:-1]):
            label = forest.find(members[n:])
            if (label == label[0]).all():
                break
            for b in members[n:][label != label[0]].tolist():
                compare(a, b)
    label = forest.label
    mine = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.table({"u": pa.array(nodes[mine]), "v": pa.array(nodes[label[mine]])})


def near_duplicates(docs: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, digest, component_id): one row for each row of ``docs``."""
    found = settle(prints(docs))
    distinct = settle(found.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.any_value("fp").alias("fp"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands")))
    # vantage-point trees over the fingerprints; nodes of one fingerprint hang on its least node
    leads = settle(distinct.groupBy("fp").agg(F.min("node").alias("lead")))
    links_ = fingerprint_links(leads)
    alike_ = links_.join(leads, links_.u == leads.fp).select(F.col("lead").alias("u"), "v").join(leads, F.col("v") == leads.fp).select("u", F.col("lead").alias("v"))
    same = distinct.select("node", "fp").join(leads, "fp").where("node <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v"))
    shared = distinct.select("node", F.explode("bands").alias("band"))
    least = shared.groupBy("band").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "least")
    stars = shared.join(least, "band").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    candidates = settle(components(stars.union(alike_).union(same)))
    known = distinct.select("node", "first_id", "size").join(candidates, "node")
    blocks = known.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / block_bytes)).cast("long").alias("k"))
    wanted = known.select("node", "first_id", "root").join(blocks, "root")
    texts = documents(docs, "binary").withColumnRenamed("doc_id", "first_id")

    # a document whose id repeats with other texts is told apart by its node
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = np.array([digest(shingles(x or b"")) for x in batch.column(3).to_pylist()], np.uint64).view(np.int64)
            yield batch.filter(pa.array(nodes == batch.column(1).to_numpy()))

    rows = texts.join(wanted, "first_id").select("root", "node", "k", "text").mapInArrow(own, "root long, node long, k long, text binary").dropDuplicates(["node"])
    rows = rows.withColumn("b", F.pmod(F.xxhash64("node"), "k")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    rows = rows.select("root", F.least("b", "j").alias("low"), F.greatest("b", "j").alias("high"), "node", "text")
    links = rows.groupBy("root", "low", "high").applyInArrow(verified, "u long, v long")
    groups = settle(components(links))
    linked = distinct.select("node", "first_id").join(groups, "node")
    firsts = linked.groupBy("root").agg(F.min("first_id").alias("least_id"))
    linked = linked.join(firsts, "root").select("node", "least_id")
    classes = settle(distinct.select("node", "first_id").join(linked, "node", "left").select("node", F.coalesce("least_id", "first_id").alias("component_id")))
    return found.select("doc_id", "digest", "node").join(classes, "node").select("doc_id", "digest", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """As ``simhash.keep_one``, with groups by shingle similarity."""
    return simhash.keep_one(docs, near_duplicates)
