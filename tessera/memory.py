"""One class over the operators: a memory of drawers, links, tags and scores, kept as Parquet under one folder.

Every change writes a new generation of the tables that it changes; readers take the newest generation that is complete, so a
job that is lost half-way leaves the memory as it was. One writer at a time. What is returned are DataFrames. The embedder is
the caller's function from a Series of texts to a Series of vectors; without one there is no vector stream.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import aggregates, graph, knowledge, lifecycle, retrieval
from tessera.sources import stores

Embedder = Callable[[pd.Series], pd.Series]
SCHEMAS = {
    "drawers": "id string, content string, wing string, room string, session string, importance double, accesses long, filed_at timestamp",
    "vectors": "id string, embedding array<float>",
    "links": "edge_id string, subject string, predicate string, object string, weight double",
    "tags": "node string, tag string",
}


class Memory:
    def __init__(self, spark: SparkSession, root: str, embed: Embedder | None = None):
        self.spark, self.root, self.embed = spark, root.rstrip("/"), embed

    # --- tables ---

    def _generations(self, name: str) -> list[int]:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        paths = [x.getPath() for x in fs.listStatus(folder)]
        return sorted(int(p.getName().partition("=")[2]) for p in paths if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def table(self, name: str) -> DataFrame:
        found = self._generations(name)
        reader = self.spark.read.schema(SCHEMAS[name])
        return reader.parquet(f"{self.root}/{name}/generation={found[-1]}") if found else self.spark.createDataFrame([], SCHEMAS[name])

    def _write(self, name: str, rows: DataFrame) -> None:
        names = [x.strip().split(" ")[0] for x in SCHEMAS[name].split(", ")]
        rows.select(*names).write.parquet(f"{self.root}/{name}/generation={(self._generations(name) or [0])[-1] + 1}")

    # --- changes ---

    def add(self, drawers: DataFrame) -> None:
        """Drawers (id, content, wing, room and, if there are, session, importance, filed_at); those with a known id are replaced."""
        given = {c.lower() for c in drawers.columns}
        default = {"session": F.lit(None).cast("string"), "importance": F.lit(0.5), "accesses": F.lit(0).cast("long"), "filed_at": F.current_timestamp()}
        new = drawers.withColumns({c: e for c, e in default.items() if c not in given}).withColumn("id", F.col("id").cast("string")).withColumn("session", F.coalesce(F.col("session").cast("string"), "id")).dropDuplicates(["id"])
        self._write("drawers", stores.import_rows(self.table("drawers"), new.select(*self.table("drawers").columns), stores.EXPORT_VERSIONS[-1]))
        if self.embed is not None:
            embed = self.embed

            @F.pandas_udf("array<float>")
            def vector(texts: pd.Series) -> pd.Series:
                return embed(texts)

            self._write("vectors", stores.import_rows(self.table("vectors"), new.select("id", vector("content").alias("embedding")), stores.EXPORT_VERSIONS[-1]))

    def delete(self, ids: DataFrame) -> None:
        """Drawers of these ids (id), with their vectors, tags and links."""
        gone = ids.select(F.col("id").cast("string").alias("id")).distinct()
        self._write("drawers", stores.delete_rows(self.table("drawers"), gone))
        self._write("vectors", stores.delete_rows(self.table("vectors"), gone))
        self._write("tags", self.table("tags").join(gone, F.col("node") == F.col("id"), "left_anti"))
        links = self.table("links").join(gone, F.col("subject") == F.col("id"), "left_anti")
        self._write("links", links.join(gone, F.col("object") == F.col("id"), "left_anti"))

    def tag(self, rows: DataFrame) -> None:
        """(node, tag), each once."""
        self._write("tags", self.table("tags").unionByName(rows.select(F.col("node").cast("string").alias("node"), "tag")).distinct())

    def untag(self, rows: DataFrame) -> None:
        self._write("tags", self.table("tags").join(rows.select(F.col("node").cast("string").alias("node"), "tag"), ["node", "tag"], "left_anti"))

    def link(self, edges: DataFrame) -> None:
        """(subject, predicate, object, weight); a link that exists is not added again."""
        self._write("links", knowledge.link(self.table("links"), edges.select(F.col("subject").cast("string").alias("subject"), "predicate", F.col("object").cast("string").alias("object"), "weight")))

    def boost(self, ids: DataFrame, by: float = 0.1) -> None:
        """Importance up by ``by``, at most 1, and an access counted; a negative ``by`` takes off, down to 0."""
        hit = ids.select(F.col("id").cast("string").alias("id")).distinct().withColumn("_hit", F.lit(1))
        rows = self.table("drawers").join(hit, "id", "left")
        more = F.when(F.col("_hit") == 1, by).otherwise(0.0)
        self._write("drawers", rows.withColumn("importance", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("importance") + more))).withColumn("accesses", F.col("accesses") + F.coalesce("_hit", F.lit(0))))

    # --- questions ---

    def search(self, queries: DataFrame, k: int = 10, strategy: str = "hybrid", **where: str) -> DataFrame:
        """The ``k`` best drawers of each query (query_id, query); strategy: bm25, overlap, full_text or hybrid. ``where``: wing and room."""
        drawers = self.table("drawers")
        if strategy == "hybrid":
            vectors = asked = None
            if self.embed is not None:
                embed = self.embed

                @F.pandas_udf("array<float>")
                def vector(texts: pd.Series) -> pd.Series:
                    return embed(texts)

                vectors, asked = self.table("vectors"), queries.select("query_id", vector("query").alias("embedding"))
            return retrieval.hybrid(drawers, queries, vectors, asked, k=k, wing=where.get("wing"), room=where.get("room"))
        for column, value in where.items():
            drawers = drawers.where(F.col(column) == value)
        scored = {"bm25": retrieval.bm25, "overlap": retrieval.overlap, "full_text": retrieval.full_text}[strategy](drawers, queries)
        return retrieval.top_k(scored, k)

    def related(self, seeds: DataFrame, depth: int = 2) -> DataFrame:
        """(node, depth) over links in both directions."""
        return graph.expand(self.table("links"), seeds, depth)

    def cascade(self, seeds: DataFrame, depth: int = 2) -> DataFrame:
        """(node, score) over links and shared tags from seeds (node, score)."""
        return graph.cascade(self.table("links"), seeds, depth, tags=self.table("tags"))

    def recent(self, n: int = 20) -> DataFrame:
        return self.table("drawers").orderBy(F.desc("filed_at"), "id").limit(n)

    def fetch(self, ids: Sequence[str]) -> DataFrame:
        """Drawers in the order asked for."""
        wanted = self.spark.createDataFrame(list(enumerate(ids)), "place int, id string")
        return self.table("drawers").join(F.broadcast(wanted), "id").orderBy("place").drop("place")

    def taxonomy(self) -> DataFrame:
        return aggregates.taxonomy(self.table("drawers"))

    def story(self, budget: int = 800) -> DataFrame:
        """What to recall first in each wing: drawers by importance as long as their characters fit."""
        rows = self.table("drawers").withColumn("cost", F.length("content"))
        return lifecycle.fit_prefix(rows, "wing", [F.desc("importance"), F.asc("id")], "cost", budget).drop("running", "cost")

    def export(self, path: str) -> None:
        stores.tree_export(self.table("drawers"), path)
