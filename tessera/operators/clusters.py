"""Clusters and near-duplicates: overlap of member sets, merging in order, and the greedy choice of what to keep within a source.

Sets meet by their rarest members alone (prefix filtering): two sets of enough in common share one of the rare ones, however common the rest is. Equal sets
are one class first, so copies never meet in pairs; only ``overlapping``, whose result is the pairs, lists them for every class in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.aggregates import centroids
from tessera.operators.settle import settle


def _classes(sets: DataFrame) -> DataFrame:
    """(owner, rep, size): of owners with equal sets (owner, member), the least is ``rep``."""
    # two sums of independent hashes and the size stand for a set: no set is gathered
    sums = [F.sum(F.xxhash64(F.lit(salt), "member").cast("decimal(38,0)")).alias(f"h{salt}") for salt in (1, 2)]
    keyed = sets.groupBy("owner").agg(F.count(F.lit(1)).alias("size"), *sums)
    least = keyed.groupBy("size", "h1", "h2").agg(F.min("owner").alias("rep"))
    return keyed.join(least, ["size", "h1", "h2"]).select("owner", "rep", "size")


def _pairs(sets: DataFrame, sizes: DataFrame, prefix: Column, fits: Column) -> DataFrame:
    """(x, y, both): pairs of owners, the smaller set first (ties by owner), that share a member of x's ``prefix`` rarest; ``fits`` over sx, sy, both.

    sets: (owner, member) once each, sizes: (owner, size).
    """
    held = sets.groupBy("member").agg(F.count(F.lit(1)).alias("df"))
    ranked = sets.join(held, "member").join(sizes, "owner")
    place = F.row_number().over(Window.partitionBy("owner").orderBy("df", "member"))
    ranked = settle(ranked.withColumn("place", place).select("owner", "member", "size", (F.col("place") <= prefix).alias("rare")))
    x = ranked.where("rare").select(F.col("owner").alias("x"), "member", F.col("size").alias("sx"))
    y = ranked.select(F.col("owner").alias("y"), "member", F.col("size").alias("sy"))
    met = x.join(y, "member").where("sx < sy OR (sx = sy AND x < y)")
    met = settle(met.select("x", "y", "sx", "sy").distinct())
    mine = met.join(sets.select(F.col("owner").alias("x"), "member"), "x")
    shared = mine.join(sets.select(F.col("owner").alias("y"), "member"), ["y", "member"]).groupBy("x", "y", "sx", "sy").agg(F.count(F.lit(1)).alias("both"))
    return shared.where(fits)


def _sets(members: DataFrame) -> DataFrame:
    return settle(members.where("cluster_id IS NOT NULL AND member_id IS NOT NULL").select(F.col("cluster_id").alias("owner"), F.col("member_id").alias("member")).distinct())


def overlapping(members: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(a, b, overlap), a < b: all pairs of clusters whose shared members are more than ``threshold`` of the smaller one's; equal clusters overlap by 1.

    members: (cluster_id, member_id). Rows with nulls are left out. Classes of equal clusters are compared, then every one's clusters are listed.
    """
    sets = _sets(members)
    classes = settle(_classes(sets))
    near = _near_classes(sets, classes, threshold)
    if threshold < 1:
        near = near.unionByName(classes.groupBy(F.col("rep").alias("a")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", F.col("a").alias("b"), F.lit(1.0).alias("overlap")))
    one, other = classes.select(F.col("rep").alias("a"), F.col("owner").alias("x")), classes.select(F.col("rep").alias("b"), F.col("owner").alias("y"))
    every = near.join(one, "a").join(other, "b").where("a <> b OR x < y")
    return every.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "overlap")


def _near_classes(sets: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, overlap), a < b: of classes by their least ids; sets: (owner, member), classes: (owner, rep, size)."""
    reps = settle(classes.where("owner = rep").select("owner", "size"))
    kept = settle(sets.join(reps.select("owner"), "owner", "left_semi"))
    least = F.floor(F.col("size") * threshold + 1e-9) + 1  # members that a set of this size must share with a larger one
    pairs = _pairs(kept, reps, F.col("size") - least + 1, F.col("both") > F.col("sx") * threshold + 1e-9)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("both") / F.col("sx")).alias("overlap"))


def refine(members: DataFrame, vectors: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(cluster_id, absorbed_by, size[, centroid]): what merging in order makes of clusters.

    Clusters are gone through by id, and every later cluster that overlaps one by more than ``threshold`` of the smaller goes into it, unless an earlier one took it: so each
    goes to the least that it overlaps, with the members that it had at first, and a cluster takes in those that come to it whether or not it has gone itself. ``size`` and
    ``centroid`` are those after merging; vectors: (member_id, embedding), members without one don't count for the centroid.
    """
    sets = settle(members.where("cluster_id IS NOT NULL AND member_id IS NOT NULL").select("cluster_id", "member_id").distinct())
    named = sets.select(F.col("cluster_id").alias("owner"), F.col("member_id").alias("member"))
    classes = settle(_classes(named))
    near = _near_classes(named, classes, threshold)
    both = near.select("a", "b").union(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = both.groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("other"))
    own = F.col("rep") if threshold < 1 else F.lit(None)  # a copy overlaps by 1
    found = classes.join(first, "rep", "left").select(F.col("owner").alias("cluster_id"), F.least(F.when(own < F.col("owner"), own), F.when(F.col("other") < F.col("owner"), F.col("other"))).alias("absorbed_by"))
    found = settle(found)
    more = found.where("absorbed_by IS NOT NULL").join(sets, "cluster_id").select(F.col("absorbed_by").alias("cluster_id"), "member_id")
    merged = settle(sets.union(more).distinct())
    out = found.join(merged.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")), "cluster_id")
    if vectors is not None:
        middle = centroids(merged.join(vectors.select("member_id", "embedding").where("embedding IS NOT NULL"), "member_id"), "embedding", "cluster_id")
        out = out.join(middle.select("cluster_id", "centroid"), "cluster_id", "left")
    return out


def refine_all(members: DataFrame, threshold: float = 0.5, rounds: int = 20) -> DataFrame:
    """(cluster_id, member_id) after merging again and again until no two clusters overlap: what was absorbed is gone, its members are where it went."""
    sets = settle(members.where("cluster_id IS NOT NULL AND member_id IS NOT NULL").select("cluster_id", "member_id").distinct())
    for _ in range(rounds):
        into = refine(sets, None, threshold).where("absorbed_by IS NOT NULL").select("cluster_id", "absorbed_by")
        into = settle(into)
        if into.isEmpty():
            return sets
        # chains of one round end at their root: each step looks one further up, and halves what is left
        for _ in range(64):
            up = into.join(into.select(F.col("cluster_id").alias("absorbed_by"), F.col("absorbed_by").alias("next")), "absorbed_by", "left")
            moved = settle(up.select("cluster_id", F.coalesce("next", "absorbed_by").alias("absorbed_by"), F.col("next").isNotNull().alias("more")))
            into = moved.select("cluster_id", "absorbed_by")
            if moved.where("more").isEmpty():
                break
        sets = settle(sets.join(into, "cluster_id", "left").select(F.coalesce("absorbed_by", "cluster_id").alias("cluster_id"), "member_id").distinct())
    raise RuntimeError("clusters did not settle")


def first_independent(nodes: DataFrame, edges: DataFrame, most: int = 200) -> DataFrame:
    """(node, kept): the greedy choice in the order of ``rank``, in rounds: (node, rank), edges (u, v) both ways round.

    What has no undecided neighbour before it stays, what has a kept one before it goes; so each round decides at least the first of every run.
    """
    ranks = nodes.select("node", "rank")
    down = edges.join(ranks.select(F.col("node").alias("u"), F.col("rank").alias("ru")), "u").join(ranks.select(F.col("node").alias("v"), F.col("rank").alias("rv")), "v").where("ru < rv").select("u", "v")
    down = settle(down.distinct())
    touched = down.select(F.col("v").alias("node")).distinct()
    kept = settle(ranks.join(touched, "node", "left_anti").select("node"))
    gone, open_ = kept.limit(0), settle(touched)
    for _ in range(most):
        if open_.isEmpty():
            return kept.withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False)))
        lost = settle(open_.join(down.join(kept.select(F.col("node").alias("u")), "u", "left_semi").select(F.col("v").alias("node")).distinct(), "node", "left_semi"))
        left = open_.join(lost, "node", "left_anti")
        gone = settle(gone.union(lost))
        waits = down.join(left.select(F.col("node").alias("u")), "u", "left_semi").select(F.col("v").alias("node")).distinct()
        free = left.join(waits, "node", "left_anti")
        kept = settle(kept.union(free))
        open_ = settle(left.join(free, "node", "left_anti"))
    raise RuntimeError("choices did not settle")


#: Words that are told from rare ones by their counts, and ids that are broadcast to keep texts from being sent.
COMMON, BROADCAST_IDS = 65_536, 1_000_000


def _candidates(texts: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """(x, y, sx, sy): pairs of one source that may have ``share`` of their words in common (Jaccard), the smaller first (ties by node); texts: (id, content), sets: (node, source, size).

    Of a text its rarest words leave as 64-bit hashes, as many as must hold a shared one; the order is by counts for the COMMON most frequent hashes and by the hash for the rest, the same for all.
    Two texts whose first shared word stands too far back are no pair. Equal hashes of different words add pairs, and never lose one.
    """
    hashed = texts.select("id", F.transform(F.array_distinct(T.tokens("content")), lambda w: F.xxhash64(w)).alias("w"))
    counts = hashed.select(F.explode("w").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    top = counts.where("n > 1").orderBy(F.desc("n"), "h").limit(COMMON).toArrow().combine_chunks()
    common = np.array(top.column(0), np.int64)
    by_hash = np.argsort(common)
    held = texts.sparkSession.sparkContext.broadcast((common[by_hash], (len(common) - by_hash).astype(np.int64)))  # COMMON at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = held.value
        for batch in batches:
            sizes, h = np.array(pc.list_value_length(batch.column(1)), np.int64), np.array(batch.column(1).flatten(), np.int64)
            rank = np.zeros(len(h), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                rank = np.where(known[at] == h, place[at], 0)
            order = np.lexsort((h, rank, np.repeat(np.arange(len(sizes)), sizes)))
            first = sizes - np.ceil(sizes * share - 1e-9).astype(np.int64) + 1
            first = np.where(sizes > 0, first, 0)
            kept = (np.arange(len(h)) - np.repeat(np.r_[0, np.cumsum(sizes)][:-1], sizes)) < np.repeat(first, sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(first)], pa.int32()), pa.array(h[order][kept]))], ["id", "w"])

    rare = hashed.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, w array<bigint>")
    keyed = settle(rare.join(sets.select(F.col("node").alias("id"), F.xxhash64("source").alias("scope"), "size"), "id"))
    each = keyed.select("id", "size", "scope", F.posexplode("w").alias("p", "h")).select("id", "size", "p", F.xxhash64("scope", "h").alias("key"))
    x, y = each.toDF("x", "sx", "px", "key"), each.toDF("y", "sy", "py", "key")
    pairs = x.join(y, "key").where(((F.col("sx") < F.col("sy")) | ((F.col("sx") == F.col("sy")) & (F.col("x") < F.col("y")))) & (F.col("sx") >= share * F.col("sy") - 1e-9))
    found = pairs.groupBy("x", "y", "sx", "sy").agg(F.min("px").alias("px"), F.min("py").alias("py"))
    most = F.least(F.col("sx") - F.col("px"), F.col("sy") - F.col("py"))
    found = found.where(most >= share / (1 + share) * (F.col("sx") + F.col("sy")) - 1e-9)
    source = sets.select(F.col("node").alias("x"), F.col("source").alias("of_x")), sets.select(F.col("node").alias("y"), F.col("source").alias("of_y"))
    return found.join(source[0], "x").join(source[1], "y").where("of_x = of_y").select("x", "y", "sx", "sy")


def within_source(drawers: DataFrame, distance: float = 0.15, least_group: int = 5, short: int = 20) -> DataFrame:
    """(id, source_file, status): kept, dropped or short; the greedy rule of a source, for all sources at once.

    In sources of ``least_group`` drawers or more, longest first (in bytes, ties by id), a drawer goes if its words' Jaccard distance to one that was kept is below
    ``distance``. Shorter ones than ``short`` bytes are looked at by no one; a drawer without words stays. Ids are unique and not null. A null text is empty; a null source is a source.
    """
    share = 1 - distance
    texts = drawers.select("id", F.coalesce("content", F.lit("")).alias("content"))
    words = F.array_distinct(T.tokens("content"))
    source = F.coalesce(F.concat(F.lit("s"), F.col("source_file").cast("string")), F.lit(""))
    # words are read from the texts again where they are needed: what is stored is numbers
    word_set = F.unhex(F.sha2(F.array_join(F.array_sort("words"), "\n"), 256))
    rows = drawers.select("id", "source_file", F.coalesce("content", F.lit("")).alias("content")).select("id", "source_file", F.octet_length("content").alias("bytes"), words.alias("words"))
    rows = rows.select("id", "source_file", source.alias("source"), "bytes", F.size("words").alias("size"), word_set.alias("set"))
    groups = rows.groupBy("source").agg((F.count(F.lit(1)) >= least_group).alias("looked"))
    marked = settle(rows.join(groups, "source").withColumn("in", F.col("looked") & (F.col("bytes") >= short) & (F.col("size") > 0)))
    ranked = marked.where(F.col("in")).select("source", "set", "size", F.struct((-F.col("bytes")).alias("b"), F.col("id")).alias("rank"))
    firsts = settle(ranked.groupBy("source", "set", "size").agg(F.min("rank").alias("rank")).select(F.col("rank.id").alias("node"), "source", "size", "rank"))
    met = settle(_candidates(texts, firsts, share))
    # a text is sent once for every pair that it may be in; others stay where they are
    asked = met.select(F.col("x").alias("id")).union(met.select(F.col("y").alias("id"))).distinct()
    if asked.count() <= BROADCAST_IDS:  # checked
        texts = texts.join(F.broadcast(asked), "id", "left_semi")
    said = texts.select("id", F.array_join(F.array_distinct(T.tokens("content")), " ").alias("said"))  # no word has a blank in it
    both = met.join(said.toDF("x", "of_x"), "x").join(said.toDF("y", "of_y"), "y").select("x", "y", "sx", "sy", "of_x", "of_y")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(set(one.split(" ")).intersection(other.split(" "))) for one, other in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n, pa.int64())], ["x", "y", "sx", "sy", "both"])

    kind = met.schema["x"].dataType.simpleString()
    both = both.mapInArrow(shared, f"x {kind}, y {kind}, sx int, sy int, both long")
    edges = settle(both.where(1 - F.col("both") / (F.col("sx") + F.col("sy") - F.col("both")) < F.lit(distance)).select(F.col("x").alias("u"), F.col("y").alias("v")))
    chosen = first_independent(firsts.select("node", "rank"), edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    kept = chosen.where("kept").select(F.col("node").alias("id"), F.lit(True).alias("stays"))
    status = F.when(F.col("bytes") < short, "short").when(~F.col("in") | F.col("stays"), "kept").otherwise("dropped")
    return marked.join(kept, "id", "left").select("id", "source_file", status.alias("status"))
