"""Retention, eviction, forgetting, versions, packing into budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import decay as D


def days_since(then: str, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400.0)


def with_scores(memories: DataFrame, scores: DataFrame, default_retention: float = 1.0) -> DataFrame:
    """Memories with their retention rows; defaults where there is none."""
    return memories.join(scores.select("memory_id", "retention_strength", "last_accessed", "access_count", "decay_rate"), "memory_id", "left").withColumn("retention_strength", F.coalesce("retention_strength", F.lit(default_retention))).withColumn("access_count", F.coalesce("access_count", F.lit(0)))


def retention(scored: DataFrame, now: Column) -> DataFrame:
    r = D.ebbinghaus(F.col("retention_strength"), F.col("decay_rate"), days_since("last_accessed", now))
    return scored.withColumn("retention", r).withColumn("tier", D.tier(F.col("retention")))


def eviction_candidates(scored: DataFrame, strategy: str, target: int, protect: float = 0.9) -> DataFrame:
    """The first ``target`` by the strategy's key, those with retention of at least ``protect`` left out."""
    key = {"lru": F.col("last_accessed"), "lfu": F.col("access_count"), "lowest_retention": F.col("retention"), "oldest": F.col("created_at")}[strategy]
    return scored.where(F.col("retention") < protect).orderBy(key.asc_nulls_first(), "memory_id").limit(target)


def forget(scored: DataFrame, now: Column, least: float = 0.1) -> DataFrame:
    return scored.withColumn("verdict", D.forget_verdict(F.coalesce(F.col("forget_after") <= now, F.lit(False)), F.col("retention"), F.col("access_count"), days_since("last_accessed", now), least))


def evolve(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """New versions: version + 1, id with the version's suffix, the old one superseded and no longer the latest."""
    c = changes.select("memory_id", F.col("content").alias("_content"))
    new = memories.where("is_latest").join(c, "memory_id").select(*[
        F.concat("memory_id", F.lit("-v"), (F.col("version") + 1).cast("string")).alias("memory_id") if n == "memory_id" else (F.col("version") + 1).alias("version") if n == "version" else F.col("_content").alias("content") if n == "content"
        else F.concat("supersedes", F.array("memory_id")).alias("supersedes") if n == "supersedes" else F.lit(True).alias("is_latest") if n == "is_latest" else F.col(n)
        for n in memories.columns
    ])
    old = memories.join(c.select("memory_id").withColumn("_hit", F.lit(True)), "memory_id", "left").withColumn("is_latest", F.col("is_latest") & F.col("_hit").isNull()).drop("_hit")
    return old.select(*memories.columns).unionByName(new)


def fit_prefix(rows: DataFrame, by: str, order: list[Column], cost: str, budget: int) -> DataFrame:
    """Rows of each group in order as long as their running cost stays within the budget."""
    running = F.sum(cost).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", running).where(F.col("running") <= budget)


def pack_context(rows: DataFrame, by: str, cost: str, budget: int) -> DataFrame:
    """(by, chosen): greedy in order of priority, then id; what does not fit is skipped and smaller rows after it may still fit.

    A context's candidates pass as a sorted stream, however many they are; what is held is what was chosen, which the budget
    bounds as long as costs are positive.
    """
    kind = rows.schema[by].dataType
    ordered = rows.select(by, "priority", F.col("id").cast("string").alias("id"), F.col(cost).cast("long").alias("cost"))
    ordered = ordered.repartition(by).sortWithinPartitions(F.col(by), F.asc_nulls_last("priority"), F.asc_nulls_last("id"), "cost").select(by, "id", "cost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, used, chosen, done = None, 0, [], []
        for batch in batches:
            for key, id_, spent in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ != (key,):
                    if open_ is not None:
                        done.append((open_[0], chosen))
                    open_, used, chosen = (key,), 0, []
                if spent is not None and used + spent <= budget:
                    used += spent
                    chosen.append(id_)
            if done:
                yield _packed(done, batch.schema.field(0).type, by)
                done = []
        if open_ is not None:
            done.append((open_[0], chosen))
            yield _packed(done, batch.schema.field(0).type, by)

    return ordered.mapInArrow(run, f"{by} {kind.simpleString()}, chosen array<string>")


def _packed(done: list[tuple], kind: pa.DataType, by: str) -> pa.RecordBatch:
    keys, chosen = zip(*done, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(chosen, pa.list_(pa.string()))], [by, "chosen"])


def sliding_window(rows: DataFrame, by: str, now: Column, hours: int = 24, least_importance: int = 3, most: int = 20, tokens: int = 4000) -> DataFrame:
    """What stays in a session's window: recent, important, the newest ``most``, within the token budget from the newest back."""
    kept = rows.where((F.unix_timestamp(now) - F.unix_timestamp("ts") <= hours * 3600) & (F.col("importance") >= least_importance))
    newest = Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("id"))
    kept = kept.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most)
    return kept.withColumn("_t", F.sum("tokens").over(newest.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_t") <= tokens).drop("_n", "_t")


def around(rows: DataFrame, anchor: Column, before: int, after: int) -> DataFrame:
    """Rows around the first that matches ``anchor``, by time. Only the two neighbourhoods are ranked, each a bounded take."""
    hit = rows.where(anchor).orderBy("ts", "id").limit(1).select(F.col("ts").alias("_ts"), F.col("id").alias("_id"))
    placed = rows.crossJoin(F.broadcast(hit))  # one row
    earlier = (F.col("ts") < F.col("_ts")) | ((F.col("ts") == F.col("_ts")) & (F.col("id") < F.col("_id")))
    a = placed.where(earlier).orderBy(F.desc("ts"), F.desc("id")).limit(before)
    b = placed.where(~earlier).orderBy("ts", "id").limit(after + 1)
    return a.unionByName(b).drop("_ts", "_id")


def provenance(memories: DataFrame, known: DataFrame) -> DataFrame:
    """(memory_id, steps, verified, confidence): every source, related and superseded id must exist; share of those times strength."""
    refs = memories.select("memory_id", "strength", F.explode(F.concat("source_ids", "related_ids", "supersedes")).alias("ref"))
    checked = refs.join(known.select(F.col("id").alias("ref")).distinct().withColumn("_hit", F.lit(1)), "ref", "left")
    g = checked.groupBy("memory_id", "strength").agg(F.count(F.lit(1)).alias("steps"), F.sum(F.coalesce("_hit", F.lit(0))).alias("verified"))
    return g.select("memory_id", "steps", "verified", (F.col("verified") / F.col("steps") * F.col("strength")).alias("confidence"))


def upsert(existing: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Last write wins: for each key the row with the greatest version, rows of ``new`` winning ties."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new")))
    return both.withColumn("_p", place).where("_p = 1").drop("_p", "_new")
