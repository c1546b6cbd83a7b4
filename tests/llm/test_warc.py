import hashlib
import io

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import warc as W
from tessera.llm.common import new_path


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("first_id", F.lit(1)).repartition(2)


LONG = "<p>" + "x" * 200 + "</p>"
ROWS = [(3, "http://a/3", LONG), (1, "http://a/1", LONG), (2, None, LONG), (2, None, LONG), (4, "http://a/4", None), (5, "http://a/5", ""), (6, "u\r\nX: y", "short"), (7, "http://a/7", "short"), (None, "http://n", LONG), (8, "http://a/8", "é日" * 90000), (9, "h", "\r\n\r\nWARC/1.1\r\n" * 20), (10, "i", "\r\n\r\nWARC/1.1\r\n" * 20)]


def test_round_trip(spark):
    got = W.round_trip(pages(spark, ROWS)).collect()
    want = []
    for page, _, html in ROWS:
        raw = (html or "").encode()
        first = min((p for p, _, h in ROWS if (h or "") == (html or "") and p is not None), default=None)
        revisit = len(raw) >= 100 and page is not None and page != first
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_frames_and_index(spark):
    target = new_path(spark, "warc-test")
    index = W.write_archive(pages(spark, [(k, f"http://a/{k}", f"page {k} " * 50) for k in range(200)]), target, frame=2000, bundle=10_000)
    assert index.count() == 200 and index.select("bundle").distinct().count() > 2 and index.agg(F.max("frame")).first()[0] > 1
    headers, block = W.fetch(spark, target, W.record_id(77, "http://a/77"))
    assert block.decode() == "page 77 " * 50 and headers["WARC-Type"] == "response"
    assert W.fetch(spark, target, "<urn:uuid:none>") is None
    assert W.read_archive(spark, target).count() == 200


def test_bundle_frames_stand_alone():
    class Sink(io.BytesIO):
        def close(self):
            self.kept = self.getvalue()

    sink = Sink()
    writer = W.BundleWriter(sink, frame=64)
    at = [writer.add(bytes([k]) * 50) for k in range(5)]
    writer.close()
    reader = W.BundleReader(pa.BufferReader(sink.kept))
    for k, (frame, offset) in reversed(list(enumerate(at))):
        assert reader.frame(frame)[offset : offset + 50] == bytes([k]) * 50
    with pytest.raises(ValueError):
        W.BundleReader(pa.BufferReader(sink.kept[:-3] + b"abc"))


def test_empty(spark):
    assert W.round_trip(pages(spark, ROWS).limit(0)).count() == 0
