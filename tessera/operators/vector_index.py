"""Approximate vector search by cells and residual codes: every row is indexed, few are scored, and the index finds out itself how far it must look.

Cells grow with the table (one for every CELL_ROWS rows) and are fitted in two levels: coarse centres on a bounded sample, then, in Spark, the cells of each coarse
centre on a bounded sample of its own rows. A row lies in the cell of its nearest centre; what is left of it is coded part by part with a codebook of
256 entries a part, a byte for PART numbers. A search takes each query's nearest cells, estimates similarity from codes, and scores the ``depth`` best
estimates exactly, from their vectors, which no other row's are read for. How many cells and how deep is found when the index is built: for a few stored
vectors the exact neighbours are searched, and both are as small as lets TARGET of these neighbours through. ``retrieval.vector_search`` stays the exact way.

A query set is stated and travels to the rows, so a cell that holds a third of the rows is no task of its own. Files are cut by ranges of cells, and a search reads
those of its cells. Centres that are broadcast are checked for size; beyond it rows meet the cells of their coarse centre in salted groups.

Defined results: rows without a vector, with a null or non-finite number, or of another size than most of the sample, are in cell -1, which no search reads; zero vectors
have similarity 0; ties go by id; repeated ids count each; an empty table has no cells and gives no results.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators.retrieval import QUERY_VECTORS, _unit, top_k, vector_search
from tessera.operators.settle import settle

#: Rows a cell has about; rows of a sample for each centre and at most; rounds of k-means; numbers in a coded part; coarse centres at most.
CELL_ROWS, SAMPLE_ROWS, SAMPLE, ROUNDS, PART, COARSE = 256, 64, 200_000, 10, 4, 2048
#: Neighbours that the index should find, stored vectors that it is set by, cells and estimates it may need at most, neighbours that are looked for.
TARGET, PROBED, MOST_CELLS, MOST_DEPTH, NEIGHBOURS = 0.98, 64, 1024, 400, 10
BROADCAST_BYTES, GROUP_ROWS = 64 << 20, 100_000


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Centres by Lloyd's rounds; an empty one starts again at a row."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        home = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        n = np.bincount(home, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(-2 * (x[i : i + 4096] @ centres.T) + (centres * centres).sum(1)).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Model:
    """``coarse``: centres; ``books[part, entry]``: residual codebooks; how many cells and estimates a search takes."""

    size: int
    coarse: np.ndarray
    books: np.ndarray
    cells: int = 0
    depth: int = 0

    def code(self, rest: np.ndarray) -> np.ndarray:
        return np.stack([nearest(rest[:, p * PART : (p + 1) * PART], book[:, : min(PART, self.size - p * PART)]) for p, book in enumerate(self.books)], 1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], 1)[:, : self.size]


def _usable(vectors: DataFrame) -> DataFrame:
    fits = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fits).select("id", F.col("embedding").cast("array<double>").alias("embedding"))


def _rows(column) -> np.ndarray:
    return _unit(np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1))


def fit(vectors: DataFrame) -> tuple[Model, DataFrame]:
    """A model without its search widths, and the centres of all cells, (cell, coarse, embedding); cells count through from 0."""
    spark, rows = vectors.sparkSession, _usable(vectors)
    sample = rows.select("embedding", F.xxhash64("id").alias("h")).orderBy("h").limit(min(SAMPLE, max(1, COARSE * SAMPLE_ROWS))).select("embedding").collect()  # bounded
    none = spark.createDataFrame([], "cell long, coarse int, embedding array<double>")
    if not sample:
        return Model(0, np.zeros((0, 0)), np.zeros((0, 256, PART))), none
    size = int(np.bincount([len(r.embedding) for r in sample]).argmax())
    x = _unit(np.array([r.embedding for r in sample if len(r.embedding) == size]))
    rows = rows.where(F.size("embedding") == size)
    wanted = max(1, -(-rows.count() // CELL_ROWS))
    coarse = kmeans(x[: SAMPLE_ROWS * COARSE], min(COARSE, int(np.ceil(np.sqrt(wanted)))))
    held = spark.sparkContext.broadcast(coarse)  # COARSE rows at most

    def coarse_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _rows(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(nearest(own, held.value).astype(np.int32)), batch.column(0), pa.array(own.tolist())], ["coarse", "h", "embedding"])

    keyed = rows.select(F.xxhash64("id").alias("h"), "embedding").mapInArrow(coarse_of, "coarse int, h long, embedding array<double>")
    sizes = settle(keyed.groupBy("coarse").agg(F.count(F.lit(1)).alias("n")))  # COARSE rows at most
    cells = F.greatest(F.lit(1), F.round(F.col("n") / CELL_ROWS)).cast("int")
    plan = sizes.select("coarse", "n", cells.alias("k"))
    chosen = keyed.join(F.broadcast(plan), "coarse").where(F.pmod("h", F.lit(1_000_000)) * F.col("n") < F.lit(1_000_000) * F.greatest(F.col("k") * SAMPLE_ROWS, F.lit(CELL_ROWS)))

    def refine(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("h")
        centres = kmeans(np.stack(group["embedding"].to_numpy()), int(group["k"].iloc[0]))
        return pd.DataFrame({"coarse": np.int32(group["coarse"].iloc[0]), "at": np.arange(len(centres)), "embedding": list(centres)})

    fine = chosen.groupBy("coarse").applyInPandas(refine, "coarse int, at long, embedding array<double>")
    centres = settle(fine.select((F.col("coarse").cast("long") * (1 << 32) + F.col("at")).alias("cell"), "coarse", "embedding"))
    own = np.array([r.embedding for r in centres.orderBy(F.xxhash64("cell")).limit(SAMPLE // SAMPLE_ROWS).collect()])  # bounded
    rest = x[:20_000] - own[nearest(x[:20_000], own)]
    parts = -(-size // PART)
    books = np.zeros((parts, 256, PART))
    for p in range(parts):
        found = kmeans(rest[:, p * PART : (p + 1) * PART], 256)
        books[p, :, : found.shape[1]] = found[np.arange(256) % len(found)]
    return Model(size, coarse, books), centres


def index(vectors: DataFrame, model: Model, centres: DataFrame) -> DataFrame:
    """(id, embedding, cell, code) of every row of ``vectors`` (id, embedding)."""
    spark, kinds = vectors.sparkSession, {f.name: f.dataType.simpleString() for f in vectors.schema}
    out = f"id {kinds['id']}, embedding {kinds['embedding']}, cell long, code binary"
    v = F.col("embedding")
    good = F.coalesce((F.size(v) == model.size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = vectors.select("id", "embedding")
    bad = rows.where(~good).select("id", "embedding", F.lit(-1).cast("long").alias("cell"), F.lit(None).cast("binary").alias("code"))
    if not model.size:
        return bad
    held = spark.sparkContext.broadcast(model)
    n_cells = centres.count()

    def coded(ids, vectors_, x: np.ndarray, cells: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
        at = nearest(x, table)
        codes = held.value.code(x - table[at])
        return pa.RecordBatch.from_arrays([ids, vectors_, pa.array(cells[at]), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "embedding", "cell", "code"])

    if n_cells * model.size * 8 <= BROADCAST_BYTES:
        found = centres.orderBy("cell").select("cell", "embedding").collect()  # checked
        table = spark.sparkContext.broadcast((np.array([r.cell for r in found]), np.array([r.embedding for r in found])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield coded(batch.column(0), batch.column(1), _rows(batch.column(1)), *table.value)

        return rows.where(good).mapInArrow(run, out).unionByName(bad)

    def coarse_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest(_rows(batch.column(1)), held.value.coarse).astype(np.int32))], ["id", "embedding", "coarse"])

    keyed = rows.where(good).mapInArrow(coarse_of, f"id {kinds['id']}, embedding {kinds['embedding']}, coarse int")
    salts = settle(keyed.groupBy("coarse").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("salts")))  # COARSE rows at most
    left = keyed.join(F.broadcast(salts), "coarse").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).drop("salts")
    right = centres.join(F.broadcast(salts), "coarse").select("coarse", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "cell", F.col("embedding").alias("centre"))

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return pa.table({n: [] for n in ("id", "embedding", "cell", "code")})
        theirs = theirs.sort_by("cell")
        table = np.array(theirs["centre"].to_pylist())
        v = mine["embedding"].combine_chunks()
        return pa.Table.from_batches([coded(mine["id"].combine_chunks(), v, _rows(v), theirs["cell"].to_numpy(), table)])

    return left.groupBy("coarse", "salt").cogroup(right.groupBy("coarse", "salt")).applyInArrow(meet, out).unionByName(bad)


def probes(centres: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, cell, rank): the ``n`` nearest cells of each query."""
    return top_k(vector_search(centres.select(F.col("cell").alias("id"), "embedding"), queries, n), n).select("query_id", F.col("id").alias("cell"), "rank")


def estimates(indexed: DataFrame, model: Model, centres: DataFrame, queries: DataFrame, cells: int, depth: int) -> DataFrame:
    """(query_id, id, cell, score, rank): the ``depth`` best estimates in the ``cells`` nearest cells."""
    asked = queries.select("query_id", "embedding").limit(QUERY_VECTORS + 1).collect()  # checked
    if len(asked) > QUERY_VECTORS:
        raise ValueError(f"more than {QUERY_VECTORS} query vectors at once; search in blocks")
    asked = [r for r in asked if r.embedding is not None and len(r.embedding) == model.size and None not in r.embedding]
    spark = indexed.sparkSession
    kinds = {"id": indexed.schema["id"].dataType.simpleString(), "query_id": queries.schema["query_id"].dataType.simpleString()}
    if not asked:
        return spark.createDataFrame([], f"query_id {kinds['query_id']}, id {kinds['id']}, cell long, score double, rank int")
    number = {r.query_id: n for n, r in enumerate(asked)}
    by_cell: dict[int, list[int]] = {}
    for r in probes(centres, queries, cells).collect():  # the stated queries times MOST_CELLS at most
        if r.query_id in number:
            by_cell.setdefault(r.cell, []).append(number[r.query_id])
    tables = {r.cell: np.array(r.embedding) for r in centres.join(F.broadcast(spark.createDataFrame([(c,) for c in by_cell], "cell long")), "cell").collect()}
    held = spark.sparkContext.broadcast((by_cell, tables, _unit(np.array([r.embedding for r in asked], np.float64)), [r.query_id for r in asked], model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_, centre, q, names, model_ = held.value
        best: dict[int, list] = {}
        for batch in batches:
            own = batch.column(1).to_numpy(zero_copy_only=False)
            order = np.argsort(own, kind="stable")
            cuts = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]]) if len(own) else []
            for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                mine = order[a:b]
                if (cell := int(own[mine[0]])) not in asked_:
                    continue
                codes = np.frombuffer(b"".join(batch.column(2).take(pa.array(mine)).to_pylist()), np.uint8).reshape(len(mine), -1)
                scores = q[asked_[cell]] @ (centre[cell] + model_.decode(codes)).T
                for row, n in enumerate(asked_[cell]):
                    keep = np.argpartition(-scores[row], depth)[:depth] if len(mine) > depth else np.arange(len(mine))
                    ids, s = batch.column(0).take(pa.array(mine[keep])), scores[row][keep]
                    old = best.get(n)
                    if old is not None:
                        ids, s, at = pa.concat_arrays([old[0], ids]), np.r_[old[1], s], np.r_[old[2], np.full(len(keep), cell)]
                        keep = np.argpartition(-s, depth)[:depth] if len(s) > depth else np.arange(len(s))
                        best[n] = [ids.take(pa.array(keep)), s[keep], at[keep]]
                    else:
                        best[n] = [ids, s, np.full(len(keep), cell)]
        for n, (ids, s, at) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([names[n]] * len(s)), ids, pa.array(at), pa.array(s)], ["query_id", "id", "cell", "score"])

    wanted = indexed.select("id", "cell", "code").where(F.col("cell").between(min(by_cell), max(by_cell))) if by_cell else indexed.select("id", "cell", "code").limit(0)
    return top_k(wanted.mapInArrow(run, f"query_id {kinds['query_id']}, id {kinds['id']}, cell long, score double"), depth)


def search(indexed: DataFrame, model: Model, centres: DataFrame, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best of the rows that are scored, which are ``model.depth`` for each query at most (times k / NEIGHBOURS for more).

    Of rows that repeat an id in one cell each counts.
    """
    depth = model.depth * -(-k // NEIGHBOURS)
    likely = estimates(indexed, model, centres, queries, model.cells, depth).select("query_id", "id", "cell").distinct()
    asked = F.broadcast(queries.select("query_id", F.col("embedding").alias("_q")))  # checked by ``estimates``
    scored = indexed.select("id", "cell", "embedding").join(likely, ["id", "cell"]).join(asked, "query_id")
    return top_k(scored.select("query_id", "id", F.round(V.cosine(F.col("embedding"), F.col("_q")), 9).alias("score")), k)


def adjust(indexed: DataFrame, model: Model, centres: DataFrame, target: float = TARGET) -> Model:
    """The model with as many cells and as deep as lets ``target`` of the exact neighbours of PROBED stored vectors through."""
    if not model.size:
        return model
    some = settle(indexed.where("cell >= 0").orderBy(F.xxhash64("id", "cell")).limit(PROBED).select(F.monotonically_increasing_id().alias("query_id"), "embedding"))
    rows = indexed.where("cell >= 0")
    true = settle(top_k(vector_search(rows.select("id", "embedding"), some, NEIGHBOURS), NEIGHBOURS).select("query_id", "id"))
    homes = true.join(rows.select("id", "cell"), "id").join(probes(centres, some, MOST_CELLS), ["query_id", "cell"], "left")
    ranks = sorted(r[0] if r[0] is not None else MOST_CELLS - 1 for r in homes.select("rank").collect())  # PROBED times NEIGHBOURS
    within = lambda xs, share: xs[min(len(xs) - 1, int(np.ceil(share * len(xs))) - 1)] + 1
    cells = within(ranks, target)
    places = true.join(estimates(indexed, model, centres, some, cells, MOST_DEPTH).select("query_id", "id", "rank"), ["query_id", "id"])
    depth = within(sorted(r[0] for r in places.select("rank").collect()), target)
    return Model(model.size, model.coarse, model.books, int(cells), int(max(depth, NEIGHBOURS)))


def save(indexed: DataFrame, model: Model, centres: DataFrame, root: str) -> None:
    """Rows by ranges of cells, centres, and the model, which is written last."""
    spark = indexed.sparkSession
    indexed.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell").write.option("parquet.block.size", 16 << 20).parquet(f"{root}/rows")
    centres.write.parquet(f"{root}/centres")
    said = json.dumps({"size": model.size, "coarse": model.coarse.tolist(), "books": model.books.tolist(), "cells": model.cells, "depth": model.depth})
    spark.createDataFrame([(said,)], "model string").coalesce(1).write.text(f"{root}/model")


def load(spark: SparkSession, root: str) -> tuple[DataFrame, Model, DataFrame]:
    said = json.loads(spark.read.text(f"{root}/model").first()[0])
    model = Model(said["size"], np.array(said["coarse"]), np.array(said["books"]), said["cells"], said["depth"])
    return spark.read.parquet(f"{root}/rows"), model, spark.read.parquet(f"{root}/centres")


def build(vectors: DataFrame, root: str) -> tuple[DataFrame, Model, DataFrame]:
    """Fits, indexes, finds the widths of searches, and stores; what ``load`` gives."""
    model, centres = fit(vectors)
    rows = settle(index(vectors, model, centres))
    save(rows, adjust(rows, model, centres), centres, root)
    return load(vectors.sparkSession, root)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, and the mean share of the exact results that were found."""
    hits = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    each = hits.groupBy("query_id").agg((F.coalesce(F.sum("hit"), F.lit(0)) / F.count(F.lit(1))).alias("share"))
    return each.agg(F.count(F.lit(1)).alias("queries"), F.avg("share").alias("recall"))
