"""Stores: Parquet-backed drawers, vectors and snapshots, exports, imports and incremental reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXPORT_VERSIONS = ("1.0", "1.1", "2.0")


def metadata_equals(wanted: dict[str, str]) -> Column:
    """All keys equal; a missing key counts as an empty string."""
    out = F.lit(True)
    for key, value in wanted.items():
        out = out & (F.coalesce(F.col("metadata")[key], F.lit("")) == value)
    return out


def checked_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """The vectors, failing at the first whose size is not the manifest's."""
    ok = F.when(F.size("embedding") == dims, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit(f"manifest has {dims} dimensions, vector has "), F.size("embedding").cast("string"))))
    return vectors.withColumn("embedding", ok)


def already_mined(files: DataFrame, drawers: DataFrame, mode: str | None = None, check_mtime: bool = True, version: int = 2) -> DataFrame:
    """Files that no drawer of the same source covers: same mode (missing: exchange), normalised at ``version`` or later, same mtime."""
    seen = drawers.where(F.coalesce("normalize_version", F.lit(1)) >= version)
    if mode is not None:
        seen = seen.where(F.coalesce("extract_mode", F.lit("exchange")) == mode)
    keys = ["source_file", "mtime"] if check_mtime else ["source_file"]
    return files.join(seen.select(*keys).distinct(), keys, "left_anti")


def sweep(messages: DataFrame, cursors: DataFrame) -> DataFrame:
    """Messages not older than their session's cursor (session_id, cursor); equal times stay, an id comes once."""
    fresh = messages.join(cursors, "session_id", "left").where(F.col("cursor").isNull() | (F.col("ts") >= F.col("cursor"))).drop("cursor")
    return fresh.withColumn("id", F.concat(F.lit("sweep_"), "session_id", F.lit("_"), "uuid")).dropDuplicates(["id"])


def cursors(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.max("ts").alias("cursor"))


def markdown_export(drawers: DataFrame, path: str) -> None:
    """One folder a source, rows ordered by source and filing time within a file, rendered as markdown. A large source has several files."""
    body = F.concat(F.lit("## "), "id", F.lit("\n\n"), "content", F.lit("\n"))
    drawers.select("source_file", "filed_at", body.alias("value")).hint("rebalance", "source_file").sortWithinPartitions("source_file", "filed_at").select("source_file", "value").write.partitionBy("source_file").text(path)


def tree_export(drawers: DataFrame, path: str) -> None:
    """wing/room folders of text files; large rooms are split among tasks, small ones gathered."""
    drawers.select("wing", "room", F.col("content").alias("value")).hint("rebalance", "wing", "room").write.partitionBy("wing", "room").text(path)


def front_matter(*fields: str, body: str = "content") -> Column:
    """A markdown note with its fields as YAML front matter."""
    lines = [F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), F.col(body))


def json_page(rows: DataFrame, order: str, offset: int, size: int) -> DataFrame:
    """A page of at most 1000 rows as JSON, with ``has_more``; only offset + size + 1 rows are taken."""
    size = min(size, 1000)
    head = rows.orderBy(order).limit(offset + size + 1)
    numbered = head.withColumn("_n", F.row_number().over(Window.orderBy(order)))
    more = numbered.agg((F.count(F.lit(1)) > offset + size).alias("has_more"))
    page = numbered.where((F.col("_n") > offset) & (F.col("_n") <= offset + size))
    return page.select(F.to_json(F.struct(*rows.columns)).alias("json"), F.col("_n").alias("position")).crossJoin(F.broadcast(more))


def import_rows(existing: DataFrame, incoming: DataFrame, version: str, mode: str = "merge", key: str = "id") -> DataFrame:
    """merge: incoming rows replace those with their key; skip: existing rows stay; replace: only incoming rows."""
    if version not in EXPORT_VERSIONS:
        raise ValueError(f"export version {version} is not one of {', '.join(EXPORT_VERSIONS)}")
    if mode == "replace":
        return incoming
    if mode == "skip":
        return existing.unionByName(incoming.join(existing.select(key), key, "left_anti").select(*existing.columns))
    if mode == "merge":
        return existing.join(incoming.select(key), key, "left_anti").select(*existing.columns).unionByName(incoming)
    raise ValueError(f"unknown import mode {mode}")


def delete_rows(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_anti").select(*rows.columns)


def corrupt_ids(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.where(F.coalesce(F.col(key).cast("string"), F.lit("")) == "")


def save_snapshot(rows: DataFrame, root: str, version: int) -> None:
    rows.write.mode("overwrite").parquet(f"{root}/version={version}")


def load_snapshot(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/version={version}")


def latest_generation(manifest: DataFrame) -> DataFrame:
    """Shards of the newest generation that has all of its shards."""
    whole = manifest.groupBy("generation").agg(F.count_distinct("shard").alias("have"), F.max("n_shards").alias("need")).where("have = need").agg(F.max("generation").alias("generation"))
    return manifest.join(F.broadcast(whole), "generation", "left_semi")
