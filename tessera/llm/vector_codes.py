"""Vector codes: every part of a vector becomes the index of the nearest of 16 entries of that part's codebook.

Codebooks are found by Lloyd's rounds with Hamerly's bounds. A part of a vector keeps, from round to round, an upper bound of the
distance to its own entry and one lower bound of the distance to the second nearest. When entries move, the upper bound grows by
the own entry's move and the lower one shrinks by the largest move of another. While the upper bound is strictly below the lower
one, or below half the way from the own entry to the nearest other, the part stays where it is; else its own distance is measured,
and if that isn't strictly below either, all entries are scanned in integers, the lower index winning ties. Bounds are single floats, always rounded
outward, so they never decide what the integers would decide otherwise.

Vectors are dealt to blocks once. A block is a row: ids, labels, integer components, assignments, bounds, and the sums that its
vectors add to the entries. A round is one job over the blocks without a shuffle, which writes them anew to the shared folder (integers take
as few bytes as they need); sums are read back from their own column, combined in each task, and added up in Spark: a row for
each codebook number and task. Only the codebooks (16 times the components of a vector) come to the driver.

Defined results: rows whose vector is null, or holds nulls or components that aren't finite, are left out; vectors must have one length,
divisible by 8 (else an error), and components so small that a distance fits a long (else an error; for 64 components below 2^16); fewer than 16 kept rows make smaller
codebooks; seeds are taken by vec_id, nulls last, then by the vector, each row counting, so copies of a vector may be several entries, of which the first is used;
rows with null or repeated ids are coded each on their own; null labels are one label, and floating-point labels that print alike are one; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Tables, settle

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components in a block at most; labels whose sums are broadcast at most (beyond, their join is salted in SALTS ways), and their bytes.
BLOCK_VALUES, BROADCAST_LABELS, BROADCAST_BYTES, SALTS = 1 << 19, 50_000, 8 << 20, 32
BLOCK = "n long, width int, ids array<long>, labels array<string>, kind string, ints binary, codes binary, upper binary, lower binary, sums array<long>, scans long"


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): what is kept, with components as doubles."""
    v = F.col("embedding").cast("array<double>")
    fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & fits).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"))


def floors(v: np.ndarray) -> np.ndarray:
    """Integers of (n, length) components; raises where distances could pass a long."""
    if v.size and (v.shape[1] % PARTS or not v.shape[1]):
        raise ValueError(f"vectors of {v.shape[1]} components have no {PARTS} equal parts")
    scaled = np.floor(v * SCALE)
    if v.size and np.abs(scaled).max() > math.isqrt((2**63 - 1) // (4 * v.shape[1])):
        raise ValueError("components are too large for distances in 64 bits")
    return scaled.astype(np.int64)


def narrow(x: np.ndarray) -> np.ndarray:
    for kind in ("<i2", "<i4"):
        if not x.size or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x.astype("<i8")


def up(x: np.ndarray) -> np.ndarray:
    """Single floats that are not below ``x`` (doubles that are right to a few last places)."""
    return np.nextafter(np.nextafter(x, np.inf).astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.nextafter(x, -np.inf).astype(np.float32), np.float32(-np.inf)), np.float32(0))


class Codebooks:
    """``entries[part, index]`` and, of the step from those before, how far each moved."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        k = entries.shape[1]
        apart = np.sqrt(((entries[:, :, None] - entries[:, None]) ** 2).sum(-1).astype(np.float64))
        apart[:, np.arange(k), np.arange(k)] = np.inf
        self.half = down(apart.min(-1) / 2) if k > 1 else np.full((len(entries), k), np.inf, np.float32)
        moves = np.sqrt(((entries - before) ** 2).sum(-1).astype(np.float64)) if before is not None else np.zeros(entries.shape[:2])
        moves = np.where(moves > 0, up(moves), 0).astype(np.float64)
        others = np.repeat(moves[:, None], k, 1)
        others[:, np.arange(k), np.arange(k)] = 0
        self.own, self.other = moves, others.max(-1)

    def assign(self, x: np.ndarray, codes: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None):
        """New codes and bounds of parts ``x[row, part]``, and how many were scanned in full."""
        n, k = len(x), self.entries.shape[1]
        fresh = codes is None
        codes = np.zeros((n, PARTS), np.uint8) if fresh else codes.copy()
        upper = np.full((n, PARTS), np.inf, np.float32) if fresh else upper.copy()
        lower = np.zeros((n, PARTS), np.float32) if fresh else lower.copy()
        scans = 0
        for p in range(PARTS):
            if not fresh:
                a = codes[:, p]
                upper[:, p] = np.where(self.own[p][a] > 0, up(upper[:, p].astype(np.float64) + self.own[p][a]), upper[:, p])
                lower[:, p] = np.where(self.other[p][a] > 0, down(lower[:, p].astype(np.float64) - self.other[p][a]), lower[:, p])
                rest = np.flatnonzero(~(upper[:, p] < np.maximum(lower[:, p], self.half[p][a])))
                own = self.entries[p][a[rest]]
                upper[rest, p] = up(np.sqrt(((x[rest, p] - own) ** 2).sum(-1).astype(np.float64)))
                rest = rest[~(upper[rest, p] < np.maximum(lower[rest, p], self.half[p][a[rest]]))]
            else:
                rest = np.arange(n)
            if not len(rest):
                continue
            scans += len(rest)
            d = np.stack([((x[rest, p] - c) ** 2).sum(-1) for c in self.entries[p]], 1)
            best = d.argmin(1)  # the first of equal ones
            codes[rest, p] = best
            upper[rest, p] = up(np.sqrt(d[np.arange(len(rest)), best].astype(np.float64)))
            d[np.arange(len(rest)), best] = np.iinfo(np.int64).max
            lower[rest, p] = down(np.sqrt(d.min(1).astype(np.float64))) if k > 1 else np.float32(np.inf)
        return codes, upper, lower, scans

    def errors(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return sum(((x[:, p] - self.entries[p][codes[:, p]]) ** 2).sum(-1) for p in range(PARTS))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def sums_of(x: np.ndarray, codes: np.ndarray, k: int) -> np.ndarray:
    """[part, entry, sums of components and the count], flat."""
    out = np.zeros((PARTS, k, x.shape[2] + 1), np.int64)
    for p in range(PARTS):
        np.add.at(out[p], codes[:, p], np.column_stack([x[:, p], np.ones(len(x), np.int64)]))
    return out.ravel()


def _row(ids, labels, ints, codes, upper, lower, sums, scans) -> pa.RecordBatch:
    n, width = ints.shape
    values = [n, width, ids, labels, ints.dtype.str, ints.tobytes(), codes.tobytes() if codes is not None else None, upper.tobytes() if upper is not None else None, lower.tobytes() if lower is not None else None, sums, scans]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], [c.split(" ")[0] for c in BLOCK.split(", ")])


def blocks(kept: DataFrame) -> DataFrame:
    """Rows of a task in blocks of BLOCK_VALUES components at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            if not len(lengths):
                continue
            if (lengths != lengths[0]).any():
                raise ValueError("vectors of unlike lengths")
            width = int(lengths[0])
            x = floors(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(lengths), width))
            step = max(1, BLOCK_VALUES // max(1, width))
            for at in range(0, len(x), step):
                part = batch.slice(at, step)
                yield _row(part.column(0).to_pylist(), part.column(1).to_pylist(), narrow(x[at : at + step]), None, None, None, None, 0)

    return kept.mapInArrow(run, BLOCK)


def _opened(row: dict):
    x = np.frombuffer(row["ints"], row["kind"]).astype(np.int64).reshape(row["n"], PARTS, -1)
    if row["codes"] is None:
        return x, None, None, None
    return x, np.frombuffer(row["codes"], np.uint8).reshape(-1, PARTS), *(np.frombuffer(row[c], np.float32).reshape(-1, PARTS) for c in ("upper", "lower"))


def assigned(held: DataFrame, books: Codebooks) -> DataFrame:
    """The blocks with new codes, bounds and sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                x, *state = _opened(row)
                if x.shape[2] != books.entries.shape[2]:
                    raise ValueError("vectors of unlike lengths")
                codes, upper, lower, scans = books.assign(x, *state)
                yield _row(row["ids"], row["labels"], np.frombuffer(row["ints"], row["kind"]).reshape(row["n"], -1), codes, upper, lower, sums_of(x, codes, books.entries.shape[1]), scans)

    return held.mapInArrow(run, BLOCK)


def next_books(held: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry at the floor of its parts' means; unused ones stay."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for s in batch.column(0):
                own = np.array(s.values.to_numpy(zero_copy_only=False), object)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([str(v) for v in total.tolist()], pa.string())], ["at", "n"])

    rows = held.select("sums").mapInArrow(combine, "at int, n string").groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()  # a row for each codebook number
    sums = np.zeros(len(rows), object)
    for r in rows:
        sums[r["at"]] = int(r["n"])
    sums = sums.reshape(PARTS, books.entries.shape[1], -1)
    new = books.entries.copy()
    for p, j in np.ndindex(*new.shape[:2]):
        if count := sums[p, j, -1]:
            new[p, j] = [int(s) // int(count) for s in sums[p, j, :-1]]
    return Codebooks(new, books.entries)


def train(vectors: DataFrame, tables: Tables) -> tuple[DataFrame, Codebooks] | None:
    """The blocks, stored with their last codes, and the codebooks; None if no row is kept."""
    kept = valid(vectors)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()  # 16 rows
    if not first:
        return None
    if len({len(r["v"]) for r in first}) > 1:
        raise ValueError("vectors of unlike lengths")
    seeds = floors(np.array([r["v"] for r in first], np.float64)).reshape(len(first), PARTS, -1).transpose(1, 0, 2)
    books, held = Codebooks(np.ascontiguousarray(seeds)), blocks(kept)
    for _ in range(ROUNDS):
        last, own = tables, Tables(vectors.sparkSession)
        held = own.store(assigned(held, books))
        books = next_books(held, books)
        last.clear()
        tables = own
    held = tables.store(assigned(held, books))
    return held, books, tables


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: a row for each kept vector."""
    spark = vectors.sparkSession
    found = train(vectors, Tables(spark))
    if found is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    held, books, tables = found

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                x, codes, *_ = _opened(row)
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string()), pa.array([text[2 * PARTS * i : 2 * PARTS * (i + 1)] for i in range(len(x))]), pa.array(books.errors(x, codes), pa.int64())], ["vec_id", "label", "code", "error"])

    coded = settle(held.select(*held.columns).mapInArrow(rows, "vec_id long, label string, code string, error long"))
    tables.clear()
    sums = settle(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")))
    labels, size = sums.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("label")), F.lit(0))).first()
    if labels <= BROADCAST_LABELS and size <= BROADCAST_BYTES:
        joined = coded.join(F.broadcast(sums.withColumnRenamed("label", "of")), F.col("label").eqNullSafe(F.col("of")))
    else:  # a label may hold a third of the rows
        sums = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("of_salt"))
        joined = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")).join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("of_salt")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql() -> str:
    """The same rounds as a chain of common table expressions."""
    w = f"(len(e) // {PARTS})"
    steps = [f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label::VARCHAR AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, p, e[p * {w} + 1 : (p + 1) * {w}] AS x FROM v, range({PARTS}) AS t(p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS j, x AS c FROM p WHERE r <= {ENTRIES})"""]
    near = "a{0} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min(struct_pack(d := list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT, j := j)) AS m FROM p JOIN c{0} USING (p) GROUP BY r, p)"
    move = """s{0} AS (SELECT p, j, i, sum(y)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT p, m.j AS j, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{1}) GROUP BY ALL),
c{0} AS MATERIALIZED (SELECT p, j, coalesce(n.c, c{1}.c) AS c FROM c{1} LEFT JOIN (SELECT p, j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{0} GROUP BY p, j) n USING (p, j))"""
    for k in range(ROUNDS):
        steps += [near.format(k), move.format(k + 1, k)]
    steps += [near.format(ROUNDS), f"""f AS (SELECT r, string_agg(printf('%02x', m.j), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) FROM c{ROUNDS}) AS codebooks_sha256 FROM f JOIN v USING (r)"""]
    return ",\n".join(steps)


SQL = _sql()
