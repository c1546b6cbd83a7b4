"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames of about a megabyte; a bundle ends with a seek table (a skippable frame that
holds each frame's compressed and plain size), so that a frame is found and read without those before it. An index maps
record ids to (bundle, frame, offset within the plain frame, length).

Writing: each task writes bundles under names of its own (task attempt and a random part) in the shared folder, through a
temporary name, and returns index rows; only bundles in the index count, so a task that is run again leaves at most an
unused file. The index is a Parquet table and the last thing that is written. Payloads that were archived before are not
kept again: of equal payloads of at least LEAST_REVISIT bytes, the row with the smallest id is a response, the others revisit
it.

Defined results: a null payload is empty; rows that repeat an id and a payload have the same record type; rows with a null
id are responses of their own; a very long payload has a frame of its own; an empty table gives an empty archive; columns other than id, url and payload are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import file_system, new_path

FRAME, BUNDLE, LEVEL = 1 << 20, 256 << 20, 3
LEAST_REVISIT, SALTS = 100, 16
#: Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"  # records carry no crawl time; a fixed one keeps bundles reproducible
INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long"


class BundleWriter:
    """One bundle: frames are closed when full; ``add`` gives a record's frame and its offset in it."""

    def __init__(self, sink, frame: int = FRAME, level: int = LEVEL):
        self.sink, self.frame_size, self.compressor = sink, frame, zstandard.ZstdCompressor(level=level)
        self.buffer, self.frames, self.written = bytearray(), [], 0

    def add(self, record: bytes) -> tuple[int, int]:
        if self.buffer and len(self.buffer) + len(record) > self.frame_size:
            self._close_frame()
        at = len(self.frames), len(self.buffer)
        self.buffer += record
        return at

    def _close_frame(self) -> None:
        packed = self.compressor.compress(bytes(self.buffer))
        self.sink.write(packed)
        self.frames.append((len(packed), len(self.buffer)))
        self.written += len(packed)
        self.buffer.clear()

    def close(self) -> None:
        if self.buffer:
            self._close_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer)
        self.sink.close()


class BundleReader:
    """Random access to the frames of a bundle by its seek table."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 9)
        n, descriptor, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table at the end of the bundle")
        entry = 12 if descriptor & 0x80 else 8
        source.seek(size - 9 - n * entry)
        table = source.read(n * entry)
        self.frames, at = [], 0
        for k in range(n):
            packed, plain = struct.unpack_from("<II", table, k * entry)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        self.source.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=plain)


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{url}')}>"


def bare(value: str) -> str:
    """A header value may hold no line ends."""
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in value)


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    block = b"" if refers_to is not None else payload
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    headers = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {bare(url or '')}",
        f"WARC-Payload-Digest: sha256:{sha}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {n_bytes}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        headers[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(frame: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record in a plain frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        lines = frame[at:end].decode().split("\r\n")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        start = end + 4
        stop = start + int(headers["Content-Length"])
        yield at, headers, frame[start:stop]
        at = stop + 4


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload (null for revisits), n_bytes, digest, refers_to.

    Texts move once, by their row's id; which rows revisit is found from ids and digests alone. A digest that very many rows
    share is reduced to its smallest id before the shuffle, and its rows are dealt to SALTS parts for the join. Rows without an
    id can revisit nothing and do not move.
    """
    raw = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("payload"))
    slim = rows.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("n_bytes"))
    first = slim.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first_id IS NOT NULL")
    salted = slim.where("page_id IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    spread = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    again = salted.join(spread, ["digest", "salt"]).where("page_id <> first_id").select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "first_id").distinct()
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    known = rows.where("page_id IS NOT NULL")
    joined = known.join(again, (known.page_id == again.again_id) & (known.digest == again.again_digest), "left")
    joined = joined.select("page_id", "url", F.when(F.col("first_id").isNull(), F.col("payload")).alias("payload"), "n_bytes", "digest", F.col("first_id").alias("refers_to"))
    return joined.union(rows.where("page_id IS NULL").select("page_id", "url", "payload", "n_bytes", "digest", F.lit(None).cast("long").alias("refers_to")))


def write_archive(pages: DataFrame, target: str, frame: int = FRAME, bundle: int = BUNDLE, least: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages`` as bundles under ``target`` and return the index, read back from ``target``/index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(target)
        store.create_dir(f"{root}/bundles", recursive=True)
        writer, name, rows = None, "", []

        def finish() -> pa.RecordBatch:
            writer.close()
            store.move(f"{root}/bundles/{name}.part", f"{root}/bundles/{name}")
            columns = list(zip(*rows, strict=True))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["record_id", "page_id", "bundle", "frame", "offset", "length"])

        for batch in batches:
            for page_id, url, payload, n_bytes, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    name, rows = f"{uuid.uuid4().hex}.warc.zst", []
                    writer = BundleWriter(store.open_output_stream(f"{root}/bundles/{name}.part", compression=None), frame)
                record = warc_record(page_id, url, payload or b"", digest, n_bytes, refers_to)
                k, at = writer.add(record)
                rows.append((record_id(page_id, url), page_id, name, k, at, len(record)))
                if writer.written > bundle:
                    yield finish()
                    writer = None
        if writer is not None:
            yield finish()

    index = with_revisits(pages, least).mapInArrow(run, INDEX)
    index.write.mode("errorifexists").parquet(f"{target}/index")
    return read_index(pages.sparkSession, target)


def read_index(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{target}/index")


def read_archive(spark: SparkSession, target: str) -> DataFrame:
    """Every record of the index: page_id, payload_bytes, payload_digest, record_type, refers_to, and the payload's own check.

    Frames are read on their own, by the seek table, so a bundle is read by as many tasks as Spark cares to give it.
    A response's length and digest are taken from the payload that was read, a revisit's from its headers.
    """
    frames = read_index(spark, target).groupBy("bundle", "frame").agg(F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(target)
        held, reader = None, None
        for batch in batches:
            for name, k, n in sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if name != held:
                    held, reader = name, BundleReader(store.open_input_file(f"{root}/bundles/{name}"))
                rows = []
                for _, headers, block in parse_records(reader.frame(k)):
                    revisit = headers["WARC-Type"] == "revisit"
                    stated = base64.b32decode(headers["WARC-Payload-Digest"].split(":")[1]).hex()
                    digest = stated if revisit else hashlib.sha256(block).hexdigest()
                    if digest != stated:
                        raise ValueError(f"{name}: a payload differs from its digest")
                    page = int(headers["X-Page-ID"]) if headers["X-Page-ID"] else None
                    rows.append((page, int(headers["X-Payload-Length"]) if revisit else len(block), digest, headers["WARC-Type"], int(headers["X-Refers-To-Page-ID"]) if revisit else None))
                if len(rows) != n:
                    raise ValueError(f"{name}: frame {k} holds {len(rows)} records and the index {n}")
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return frames.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def fetch(spark: SparkSession, target: str, wanted: str) -> tuple[dict[str, str], bytes] | None:
    """Headers and block of one record by its id: a look-up in the index and one frame's read."""
    row = read_index(spark, target).where(F.col("record_id") == wanted).first()
    if row is None:
        return None
    store, root = file_system(target)
    reader = BundleReader(store.open_input_file(f"{root}/bundles/{row.bundle}"))
    plain = reader.frame(row.frame)[row.offset : row.offset + row.length]
    return next((headers, block) for _, headers, block in parse_records(plain))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the archive back."""
    target = new_path(pages.sparkSession, "warc")
    write_archive(pages, target)
    return read_archive(pages.sparkSession, target)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
