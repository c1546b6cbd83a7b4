"""Near-duplicate groups by SimHash and vantage-point trees.

Fingerprints of equal value are merged first. A tree of vantage points, built from a bounded sample, partitions the distinct
fingerprints by Hamming distance into shards; a fingerprint also goes, as a query, to every later shard whose region the
triangle bounds do not rule out. Each shard builds its own vantage-point tree below and finds the exact pairs within the
radius. A shard returns a spanning forest of what it links, never the pairs, so a group of many copies costs a row for each
member. Shards that stay too large (a ball that no vantage point splits) are cut into blocks that meet pair by pair.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; repeated rows get the same class, rows that repeat
a doc_id with another text the class of theirs; a class whose doc_ids are all null has a null component_id; a very long text is
read whole; fingerprints at the same distance are in no order; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, documents, settle

SEED, SHINGLE, RADIUS = 42, 3, 3
#: Distinct fingerprints that the upper tree is built from, and fingerprints a shard and a block should have at most.
SAMPLE, SHARD, LEAF = 8, 65536, 192  # points of the sample for each shard, at least 8192 in all
LEAST_LEVELS = 5
#: Nodes of the upper tree that a task holds at once: 16 bytes each.
MOST_LEVELS = 20
#: Document keys from here on stand for null ids.
NULL_KEY = 1 << 62


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits: bit b is set if it is set in over half of the shingles' hashes."""
    words = text.lower().split()  # of bytes: lower() changes A-Z alone, split() parts at the six ASCII spaces
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return bits_of(np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], np.uint64))


def bits_of(hashes: np.ndarray) -> int:
    """The fingerprint of some 64-bit hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def digested(docs: DataFrame) -> DataFrame:
    """(doc_id, text: binary, digest: xxhash64 of the text)."""
    rows = documents(docs)
    return rows.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("digest"))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, digest, fp): a hash of the text, and the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array([fingerprint(x or b"", shingle) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out)], ["doc_id", "digest", "fp"])

    return digested(docs).mapInArrow(run, "doc_id long, digest long, fp long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def choose_vantage(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int]:
    """Of some points, the one whose distances to the others spread most, and their median."""
    look = points if len(points) <= 512 else rng.choice(points, 512)
    best = max(rng.choice(points, min(8, len(points)), replace=False), key=lambda v: float(distance(look, v).astype(np.float64).var()))
    return best, int(np.median(distance(look, best)))


def upper_tree(points: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a complete tree; node k has children 2k+1 (within the radius) and 2k+2."""
    vantage, radius = np.zeros(2**levels - 1, np.uint64), np.full(2**levels - 1, 64, np.int64)
    rng, own = np.random.default_rng(7), {0: points}
    for k in range(2**levels - 1):
        mine = own.pop(k)
        if len(mine):
            vantage[k], radius[k] = choose_vantage(mine, rng)
        near = distance(mine, vantage[k]) <= radius[k]
        own[2 * k + 1], own[2 * k + 2] = mine[near], mine[~near]
    return vantage, radius


def route(points: np.ndarray, vantage: np.ndarray, radius: np.ndarray, levels: int, reach: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the point, shard, at home?): its own shard, and each later one that may hold a point within ``reach``."""
    index, node, home = np.arange(len(points)), np.zeros(len(points), np.int64), np.ones(len(points), bool)
    for _ in range(levels):
        d = distance(points[index], vantage[node]).astype(np.int64)
        near = d <= radius[node]
        inner, outer = d - reach <= radius[node], d + reach > radius[node]
        # within the radius is the smaller child number; a query goes on to the far side of its home only if that comes later
        take_in, take_out = inner & (near | ~home), outer
        index = np.concatenate([index[take_in], index[take_out]])
        node_in, node_out = 2 * node[take_in] + 1, 2 * node[take_out] + 2
        home = np.concatenate([(home & near)[take_in], (home & ~near)[take_out]])
        node = np.concatenate([node_in, node_out])
    return index, node - (2**levels - 1), home


class Forest:
    """Labels of points 0..n-1 under links; the label is the smallest index of a set."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Labels of some points; their paths are halved on the way, the rest of the forest is not touched."""
        while True:
            up = self.parent[x]
            higher = self.parent[up]
            if (up == higher).all():
                return up
            self.parent[x] = higher
            x = np.where(up == x, x, higher)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.find(a), self.find(b)
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))

    @property
    def label(self) -> np.ndarray:
        return self.find(np.arange(len(self.parent)))


def shard_links(points: np.ndarray, held: np.ndarray, reach: int = RADIUS) -> np.ndarray:
    """Label of every point after linking each with the ``held`` points within ``reach``, through a local vantage-point tree."""
    forest, rng = Forest(len(points)), np.random.default_rng(11)
    stack = [(np.flatnonzero(held), np.arange(len(points)))]
    while stack:
        data, ask = stack.pop()
        if not len(data) or not len(ask):
            continue
        split = None
        if len(data) > LEAF:
            v, r = choose_vantage(points[data], rng)
            near = distance(points[data], v).astype(np.int64) <= r
            split = near if 0 < near.sum() < len(data) else None
        if split is None:  # a leaf, or points that no vantage point parts
            step = max(1, (1 << 22) // len(data))
            for at in range(0, len(ask), step):
                mine = ask[at : at + step]
                i, j = np.nonzero(distance(points[mine][:, None], points[data][None, :]) <= reach)
                forest.link(mine[i], data[j])
            continue
        d = distance(points[ask], v).astype(np.int64)
        stack += [(data[split], ask[d - reach <= r]), (data[~split], ask[d + reach > r])]
    return forest.label


def fingerprint_links(distinct: DataFrame, reach: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(u, v) over distinct fingerprints ``fp``: edges whose components are those of all pairs within ``reach`` bits."""
    spark = distinct.sparkSession
    n = distinct.count()
    levels = min(MOST_LEVELS, max(LEAST_LEVELS, int(np.ceil(np.log2(max(n, 1) / shard))) if n > shard else 0))
    wanted = max(8192, SAMPLE << levels)  # 64 MB at MOST_LEVELS, which is at 68 thousand million fingerprints
    sampled = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) <= (wanted << 20) // max(n, 1)) if n > 4 * wanted else distinct
    sample = sampled.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(wanted).toArrow().column("fp").to_numpy().view(np.uint64)
    tree = spark.sparkContext.broadcast(upper_tree(sample, levels))  # 2^levels nodes: 16 MB at MOST_LEVELS

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vantage, radius = tree.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                points = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                index, leaf, home = route(points, vantage, radius, levels, reach)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(home), pa.array(points[index].view(np.int64))], ["shard", "home", "fp"])

    rows = distinct.select("fp").mapInArrow(routed, "shard long, home boolean, fp long")
    # shards that are too large though the tree is deep enough: balls that no vantage point splits, at most n / (2 * shard) of them
    large = rows.where("home").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * shard).collect()
    cut = {r["shard"]: -(-r["n"] // (2 * shard)) for r in large}
    rows = rows.withColumn("block", F.lit(0).cast("long")).withColumn("held", F.col("home"))
    if cut:
        blocks = F.create_map(*[F.lit(x) for s, k in cut.items() for x in (s, k)])
        rows = rows.withColumn("k", F.coalesce(F.try_element_at(blocks, F.col("shard").cast("int")), F.lit(1)))
        rows = rows.withColumn("b", F.pmod(F.xxhash64("fp"), F.col("k")))
        # a held row is held in its own block of the shard and asks in all of them
        rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k").cast("long") - 1)))
        rows = rows.withColumn("held", F.col("home") & (F.col("block") == F.col("b"))).drop("k", "b")

    def linked(group: pa.Table) -> pa.Table:
        points = group.column("fp").to_numpy().view(np.uint64)
        order = np.argsort(points.view(np.int64), kind="stable")
        points, held = points[order], group.column("held").to_numpy()[order]
        label = shard_links(points, held, reach)
        mine = np.flatnonzero(label != np.arange(len(points)))
        return pa.table({"u": pa.array(points[mine].view(np.int64)), "v": pa.array(points[label[mine]].view(np.int64))})

    return rows.groupBy("shard", "block").applyInArrow(linked, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, reach: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id, digest of the text): one row for each row of ``docs``."""
    prints = settle(fingerprints(docs, shingle))
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    groups = settle(components(fingerprint_links(distinct, reach)))
    linked = distinct.join(groups, distinct.fp == groups.node).select("fp", "first_id", "root")
    least = linked.groupBy("root").agg(F.min("first_id").alias("least_id"))
    linked = linked.join(least, "root").select("fp", "least_id")
    # rows without links are in a class of their own; checkpointed, so that AQE can split a hot fingerprint in the last join
    classes = settle(distinct.join(linked, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id")))
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "digest")


def free_name(columns: list[str], name: str) -> str:
    """A column name that clashes with none of ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_one(docs: DataFrame, groups=None) -> DataFrame:
    """``docs``, all columns, with one row left of each near-duplicate group: that of its smallest doc_id.

    ``groups``: from (doc_id, text) to (doc_id, component_id), a row for a row; by default ``near_duplicates``. Documents are
    known by their doc_id and their text: rows that repeat both leave one row. Rows that repeat a doc_id with other texts are
    documents of their own; those of the group's smallest doc_id all stay. A row with a null doc_id stands after all others, in
    the order of its text's hash, so it stays if no other row of its group does.
    """
    key, digest = free_name(docs.columns, "document_key"), free_name(docs.columns, "text_digest")
    hashed = F.xxhash64(F.col("text").cast("string"))
    stand_in = F.lit(NULL_KEY).bitwiseOR(hashed.bitwiseAND(F.lit(NULL_KEY - 1)))
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), stand_in)).withColumn(digest, hashed)
    found = (groups or near_duplicates)(keyed.select(F.col(key).alias("doc_id"), "text"))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(key), F.col("digest").alias(digest)).distinct()
    return keyed.join(gone, [key, digest], "left_anti").dropDuplicates([key, digest]).select(*[F.col(f"`{c}`") for c in docs.columns])
