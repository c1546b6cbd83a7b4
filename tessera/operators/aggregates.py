"""Counts, profiles and patterns. Set-valued results hold vocabularies (tags, agents, files of one path), never whole groups of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_wing(drawers: DataFrame) -> DataFrame:
    return drawers.groupBy(F.coalesce("wing", F.lit("unknown")).alias("wing")).agg(F.count(F.lit(1)).alias("n"))


def by_room(drawers: DataFrame, wing: str | None = None) -> DataFrame:
    kept = drawers.where("coalesce(room, '') <> ''")
    return (kept if wing is None else kept.where(F.col("wing") == wing)).groupBy("room").agg(F.count(F.lit(1)).alias("n"))


def taxonomy(drawers: DataFrame) -> DataFrame:
    return drawers.groupBy("wing", "room").agg(F.count(F.lit(1)).alias("n"))


def status(drawers: DataFrame) -> DataFrame:
    """Total and the counts by wing and by room from one pass: (kind, name, n)."""
    sets = drawers.groupingSets([[F.col("wing")], [F.col("room")], []], F.col("wing"), F.col("room")).agg(F.count(F.lit(1)).alias("n"), F.grouping("wing").alias("gw"), F.grouping("room").alias("gr"))
    kind = F.when((F.col("gw") == 0), "wing").when(F.col("gr") == 0, "room").otherwise("total")
    return sets.select(kind.alias("kind"), F.coalesce("wing", "room", F.lit("")).alias("name"), "n")


def tag_counts(rows: DataFrame, tags: str = "tags") -> DataFrame:
    return rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def helpfulness(feedback: DataFrame) -> DataFrame:
    """(drawer_id, score): .5 + helpful/(helpful + unhelpful); 1 without either."""
    g = feedback.groupBy("drawer_id").agg(F.count_if(F.col("outcome") == "helpful").alias("h"), F.count_if(F.col("outcome") == "unhelpful").alias("u"))
    return g.select("drawer_id", F.when(F.col("h") + F.col("u") == 0, 1.0).otherwise(0.5 + F.col("h") / (F.col("h") + F.col("u"))).alias("score"))


def co_changes(observations: DataFrame, least: int = 2) -> DataFrame:
    """(file_a, file_b, sessions): pairs of files within one observation, by distinct sessions."""
    pairs = observations.select("session_id", F.explode(F.array_distinct("files")).alias("file_a"), "files").select("session_id", "file_a", F.explode(F.array_distinct("files")).alias("file_b")).where("file_a < file_b")
    return pairs.distinct().groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("sessions")).where(F.col("sessions") >= least)


def error_repeats(observations: DataFrame, least: int = 2) -> DataFrame:
    """(title, n, files): titles of errors that came ``least`` times, and all files they touched."""
    counted = observations.groupBy("title").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    files = observations.select("title", F.explode("files").alias("f")).groupBy("title").agg(F.sort_array(F.collect_set("f")).alias("files"))
    return counted.join(files, "title", "left")


def concept_index(observations: DataFrame) -> DataFrame:
    """(concept, id): the inverted index as rows, so that a common concept is no single value."""
    return observations.select(F.explode("concepts").alias("concept"), "id").distinct()


def file_history(observations: DataFrame) -> DataFrame:
    e = observations.select("session_id", "ts", F.explode("files").alias("path"))
    return e.groupBy("path").agg(F.count(F.lit(1)).alias("entries"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct("session_id").alias("sessions"))


def signal_threads(signals: DataFrame) -> DataFrame:
    return signals.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("from_agent")), ",").alias("senders"))


def reservation_heatmap(reservations: DataFrame) -> DataFrame:
    return reservations.groupBy("path").agg(F.count_if(F.col("active")).alias("active"), F.count_if(F.col("active") & F.col("exclusive")).alias("exclusive"), F.count_if(F.col("active") & ~F.col("exclusive")).alias("shared"), F.count_distinct("agent_id").alias("agents"))


def facet_stats(facets: DataFrame) -> DataFrame:
    return facets.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def facet_query(facets: DataFrame, match_all: list[str], match_any: list[str]) -> DataFrame:
    """Targets that have all of the first ``dimension:value`` keys and, if any are given, one of the second. Only rows with a named key move."""
    key = F.concat_ws(":", "dimension", "value")
    named = facets.withColumn("key", key).where(F.col("key").isin(*match_all, *match_any)).select("target_id", "key").distinct()
    g = named.groupBy("target_id").agg(F.count_if(F.col("key").isin(*match_all)).alias("a") if match_all else F.lit(0).alias("a"), F.count_if(F.col("key").isin(*match_any)).alias("o") if match_any else F.lit(1).alias("o"))
    return g.where((F.col("a") == len(set(match_all))) & (F.col("o") > 0)).select("target_id")


def centroids(members: DataFrame, vector: str = "embedding", by: str = "label") -> DataFrame:
    """(by, centroid, n): element-wise mean; groups with vectors of several sizes have none."""
    sizes = members.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.size(vector)).alias("k")).where("k = 1").select(by, "n")
    parts = members.select(by, F.posexplode(vector).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = parts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("s"))
    return whole.join(sizes, by).select(by, F.transform("s", lambda x: x["m"]).alias("centroid"), "n")


def duplicate_stats(drawers: DataFrame, least: int = 5, large: int = 20, share: float = 0.4) -> DataFrame:
    """(source_file, n, estimate): sources with at least ``least`` drawers; for more than ``large``, an estimate of copies."""
    g = drawers.groupBy("source_file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return g.withColumn("estimate", F.when(F.col("n") > large, F.floor(F.lit(share) * F.col("n"))).otherwise(F.lit(0)).cast("long"))


def top_rows(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """Top ``n`` in a total order, as one bounded take-ordered step."""
    return rows.orderBy(*order).limit(n)


def project_profile(observations: DataFrame, n: int = 20) -> DataFrame:
    """(kind, name, n): the ``n`` most common concepts and files of each project, by count, then name."""
    both = observations.select("project", F.lit("concept").alias("kind"), F.explode("concepts").alias("name")).unionByName(observations.select("project", F.lit("file").alias("kind"), F.explode("files").alias("name")))
    counted = both.groupBy("project", "kind", "name").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("project", "kind").orderBy(F.desc("n"), "name"))
    return counted.withColumn("place", place).where(F.col("place") <= n)
