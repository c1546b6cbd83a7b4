"""Bi-temporal facts: (triple_id, subject, predicate, object, valid_from, valid_to, t_created, t_expired, confidence).

Bounds are inclusive as each query states; an open end is null. Entity names come from a table (entity_id, name).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_at(when: Column) -> Column:
    """valid_from <= when <= valid_to."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= when)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= when))


def known_at(when: Column) -> Column:
    """t_created <= when <= t_expired."""
    return (F.col("t_created") <= when) & (F.col("t_expired").isNull() | (F.col("t_expired") >= when))


def entity_as_of(triples: DataFrame, entities: DataFrame, entity: str, when: Column | None = None, direction: str = "both") -> DataFrame:
    """Facts of an entity, valid at ``when`` and not expired by then; with the other side's name and the direction."""
    facts = triples if when is None else triples.where(valid_at(when) & (F.col("t_expired").isNull() | (F.col("t_expired") > when)))
    sides = []
    for name, own, other in (("outgoing", "subject", "object"), ("incoming", "object", "subject")):
        if direction in (name, "both"):
            sides.append(facts.where(F.col(own) == entity).join(entities.select(F.col("entity_id").alias(other), "name"), other).withColumn("direction", F.lit(name)))
    out = sides[0]
    for more in sides[1:]:
        out = out.unionByName(more)
    return out


def bitemporal(triples: DataFrame, entity: str, valid: Column, known: Column) -> DataFrame:
    """Facts of a subject that were valid at ``valid`` as known at ``known``."""
    return triples.where((F.col("subject") == entity) & valid_at(valid) & known_at(known))


def by_predicate(triples: DataFrame, entities: DataFrame, predicate: str, when: Column | None = None) -> DataFrame:
    """Facts of a predicate with both names; expiry is not looked at."""
    facts = triples.where(F.col("predicate") == predicate)
    facts = facts if when is None else facts.where(valid_at(when))
    s = entities.select(F.col("entity_id").alias("subject"), F.col("name").alias("subject_name"))
    o = entities.select(F.col("entity_id").alias("object"), F.col("name").alias("object_name"))
    return facts.join(s, "subject").join(o, "object")


def timeline(triples: DataFrame, entity: str, limit: int = 100, known: Column | None = None) -> DataFrame:
    """Facts that touch an entity by valid_from, unknown starts first."""
    facts = triples.where((F.col("subject") == entity) | (F.col("object") == entity))
    facts = facts if known is None else facts.where(known_at(known))
    return facts.orderBy(F.asc_nulls_first("valid_from"), "triple_id").limit(limit)


def range_endpoints(triples: DataFrame, entity: str, start: Column, end: Column) -> DataFrame:
    """Facts of a subject valid at either end, each once by (subject, predicate, object)."""
    own = triples.where(F.col("subject") == entity)
    return own.where(valid_at(start)).unionByName(own.where(valid_at(end))).dropDuplicates(["subject", "predicate", "object"])


def range_overlap(triples: DataFrame, entity: str, start: Column, end: Column) -> DataFrame:
    """Facts of a subject valid at any time of the range."""
    return triples.where((F.col("subject") == entity) & (F.col("valid_from").isNull() | (F.col("valid_from") <= end)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= start)))


def close_conflicts(triples: DataFrame, single_valued: Sequence[str] | None = None) -> DataFrame:
    """Open facts end when the next fact of the same subject and predicate starts, for predicates with one value (default: all)."""
    w = Window.partitionBy("subject", "predicate").orderBy("valid_from", "triple_id")
    after = F.lead("valid_from").over(w)
    applies = F.lit(True) if single_valued is None else F.col("predicate").isin(*single_valued)
    return triples.withColumn("_next", after).withColumn("valid_to", F.when(applies & F.col("valid_to").isNull(), F.col("_next")).otherwise(F.col("valid_to"))).drop("_next")


def add_triples(existing: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Upsert: rejects facts that end before they start, skips those that are open already, closes open conflicts. Of new rows for one fact the one that ends last is taken."""
    good = new.where(F.col("valid_to").isNull() | F.col("valid_from").isNull() | (F.col("valid_to") >= F.col("valid_from")))
    open_ = existing.where("valid_to IS NULL").select("subject", "predicate", "object")
    latest = F.row_number().over(Window.partitionBy("subject", "predicate", "object").orderBy(F.desc_nulls_last("valid_to"), "triple_id"))
    added = good.join(open_, ["subject", "predicate", "object"], "left_anti")
    fresh = added.withColumn("_n", latest).where("_n = 1").drop("_n").withColumn("t_created", F.coalesce("t_created", now))
    starts = added.groupBy("subject", "predicate").agg(F.min(F.coalesce("valid_from", now)).alias("_end"))
    closed = existing.join(starts, ["subject", "predicate"], "left").withColumn("valid_to", F.when(F.col("valid_to").isNull(), F.col("_end")).otherwise(F.col("valid_to"))).drop("_end")
    return closed.unionByName(fresh.select(*existing.columns))


def invalidate(triples: DataFrame, facts: DataFrame, ended: Column) -> DataFrame:
    """Open facts named in ``facts`` (subject, predicate, object) end at ``ended``."""
    marked = triples.join(facts.select("subject", "predicate", "object").distinct().withColumn("_hit", F.lit(True)), ["subject", "predicate", "object"], "left")
    return marked.withColumn("valid_to", F.when(F.col("_hit") & F.col("valid_to").isNull(), ended).otherwise(F.col("valid_to"))).drop("_hit").select(*triples.columns)


def stats(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: entities, triples, current, expired, sorted distinct predicates. Predicates are a vocabulary, not data."""
    facts = triples.agg(F.count(F.lit(1)).alias("triples"), F.count_if(F.col("valid_to").isNull()).alias("current"), F.sort_array(F.collect_set("predicate")).alias("predicates"))
    return facts.withColumn("expired", F.col("triples") - F.col("current")).crossJoin(entities.agg(F.count(F.lit(1)).alias("entities")))
