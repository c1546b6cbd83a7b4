"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where it is unset, which only a local master may use."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _made:
        _made.append(tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(shutil.rmtree, _made[0], ignore_errors=True)
    return f"file://{_made[0]}"


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor costs a re-read and not a re-run."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def file_system(path: str):
    """Any store that pyarrow opens by its address, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Tables:
    """Intermediate tables as Parquet in the shared folder: smaller than checkpoints, and gone with ``clear``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def store(self, df: DataFrame) -> DataFrame:
        self.paths.append(path := new_path(self.spark, "table"))
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """For when what was made from the tables has itself been stored."""
        context = self.spark.sparkContext
        for path in self.paths:
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = []


def documents(docs: DataFrame, text_type: str = "string") -> DataFrame:
    """doc_id and text alone, in fixed types; other columns (whatever their names) are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast(text_type).alias("text"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (u, v: long) as (node, root), root being the smallest node.

    Alternating large-star and small-star rounds. Every round is two min-aggregations, combined before the shuffle, and
    joins on distinct keys' minima; no neighbour list is ever gathered, so a star with very many leaves is no hot task.
    Self-loops are kept as singletons. An empty input gives an empty result.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = settle(edges)
    signature = None
    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour of u is hung on u's smallest neighbour
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(edges.where("u = v").select("u", "v")).distinct()
        # small star: u and its smaller neighbours are hung on the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        new = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        edges = settle(new)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == signature:
            break
        signature = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


#: CRC-32 in DuckDB, which has none: a recursive table from its polynomial (after WITH RECURSIVE; ``tab`` has the table as a list), and the loop over bytes.
CRC_TABLE = "bits AS (SELECT i, i AS v, 0 AS k FROM range(256) AS t(i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8), tab AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8)"


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, where ``tab`` is among the tables."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(list_filter(string_split({text}, ''), lambda y: y <> ''), lambda y: ascii(y)::BIGINT)), lambda a, y: xor(a // 256, tab.t[(xor(a, y) & 255) + 1])), 4294967295)"
