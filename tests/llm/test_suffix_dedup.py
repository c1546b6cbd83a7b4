import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import suffix_array as A
from tessera.llm import suffix_dedup as X


@pytest.mark.parametrize("queue,block", [(1 << 17, 1 << 18), (20, 7)])
def test_suffixes_and_common_prefixes(monkeypatch, queue, block):
    monkeypatch.setattr(A, "BLOCK", block)
    r = random.Random(1)
    for trial in range(200):
        if trial % 2:
            words = [bytes(r.choice(b"abcd") for _ in range(r.randint(1, 40))) for _ in range(4)]
            text = b"".join(r.choice(words) for _ in range(25)) + b"\0"
        else:
            text = bytes(r.choice(r.choice([b"ab", b"a", b"abcdef"])) for _ in range(r.randint(1, 60))) + b"\0"
        order, lcp = (np.concatenate(x) for x in zip(*A.sorted_suffixes(np.frombuffer(text, np.uint8), queue), strict=True))
        assert sorted(order.tolist()) == list(range(len(text)))
        for k in range(1, len(order)):
            i, j = int(order[k - 1]), int(order[k])
            n = 0
            while n < A.DEPTH and max(i, j) + n < len(text) and text[i + n] == text[j + n]:
                n += 1
            if max(i, j) + n < len(text):
                assert lcp[k] == n and (n == A.DEPTH or text[i + n] > text[j + n])


def brute(rows):
    """First come, first kept, on whole strings."""
    seen, out = set(), {}
    for i, text in sorted(rows.items(), key=lambda x: (x[0] is None, x[0])):
        raw = (text or "").encode()
        marks, fresh = bytearray(len(raw)), []
        for s in range(len(raw) - 99):
            own = raw[s : s + 100]
            if own in seen:
                marks[s : s + 100] = b"\1" * 100
            seen.add(own)
        spans = sum(m and not (k and marks[k - 1]) for k, m in enumerate(marks))
        out[i] = (len(raw), sum(marks), spans, hashlib.sha256(bytes(c for c, m in zip(raw, marks) if not m)).hexdigest())
    return out


def passages(r, n):
    letters = "abcdefgh é日"
    return ["".join(r.choice(letters) for _ in range(r.randint(60, 260))) for _ in range(n)]


@pytest.mark.parametrize("hot", [X.HOT, 2, 0])
def test_equals_brute_force(docs_of, awkward, monkeypatch, hot):
    """With no anchor hot, some and all of them."""
    monkeypatch.setattr(X, "HOT", hot)
    monkeypatch.setattr(X, "HOT_SAMPLE", 1)
    r = random.Random(8)
    pool = passages(r, 6)
    rows = {i: t for i, t in awkward if i is not None}
    for k in range(60):
        rows[100 + k] = " ".join(r.choice(pool) if r.random() < 0.5 else "".join(r.choice("xyz ") for _ in range(r.randint(0, 150))) for _ in range(r.randint(0, 5)))
    rows[300], rows[301], rows[302] = "a" * 700, "ab" * 400, "a" * 99
    rows[303] = rows[100][:50] + rows[101]
    got = {g.doc_id: (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in X.suffix_dedup(docs_of(list(rows.items()))).collect()}
    assert got == brute(rows)


def test_a_line_among_different_surroundings(docs_of, monkeypatch):
    """One line of 60 bytes in very many texts is a hot anchor; its contexts do not meet in one shard, and nothing repeats."""
    monkeypatch.setattr(X, "HOT_SAMPLE", 1)
    monkeypatch.setattr(X, "HOT", 50)
    r, line = random.Random(4), "licensed under the terms of the public licence, version two."
    other = lambda n: "".join(r.choices("abcdefghijklmnop ", k=n))
    docs = docs_of([(k, f"{other(80)}{line}{other(80)}") for k in range(1500)])
    rows = X.keyed(docs)
    hot = X.hot_classes(rows)
    assert hot is not None and 0 < hot.sum() < 100
    anchors = X.find_anchors(rows, 64, 64, hot).collect()
    sizes = {b: sum(len(a.blob) // 28 for a in anchors if a.kind == X.HOT_WINDOW and a.bucket == b) for b in range(64)}
    assert sum(sizes.values()) >= 1500 and max(sizes.values()) < 3 * sum(sizes.values()) / 64
    assert max(sum(len(a.blob) // 24 for a in anchors if a.kind == X.ANCHOR and a.bucket == b) for b in range(64)) < 500
    assert {g.n_removed for g in X.suffix_dedup(docs).collect()} == {0}


def test_a_task_makes_one_row_for_a_bucket(docs_of, monkeypatch):
    """Copies within tasks, copies that meet later, windows of hot anchors: a task's marks in a bucket go as one row."""
    monkeypatch.setattr(X, "HOT_SAMPLE", 1)
    monkeypatch.setattr(X, "HOT", 2)
    r = random.Random(7)
    pool = passages(r, 8)
    docs = docs_of([(k, " ".join(r.choices(pool, k=4)) + "".join(r.choices("xyz ", k=90))) for k in range(300)])
    rows = X.keyed(docs)
    met = X.meet(X.find_anchors(rows, 32, 8, X.hot_classes(rows)), 8).groupBy(F.spark_partition_id().alias("task"), "kind", "bucket").count().collect()
    assert {m.kind for m in met} == {X.SETTLED, X.OPEN, X.RANGE} and max(m["count"] for m in met) == 1


def test_classes_of_anchors_are_even():
    data = np.random.default_rng(6).integers(97, 123, 400_000).astype(np.uint8)
    (_, _, h, _), _ = X.batch_anchors(data, np.array([0, len(data)]))
    counts = np.bincount(X.hot_class(h) >> 10, minlength=64)
    assert counts.min() > 0.6 * counts.mean() and counts.max() < 1.5 * counts.mean()


def test_repeated_rows_are_one_document(docs_of):
    text = " ".join(passages(random.Random(2), 3))
    got = X.suffix_dedup(docs_of([(1, text), (1, text), (2, text), (None, text)])).collect()
    assert sorted((repr(g.doc_id), g.n_removed) for g in got) == sorted([("1", 0), ("1", 0), ("2", len(text.encode())), ("None", len(text.encode()))])


def test_empty(docs_of):
    assert X.suffix_dedup(docs_of(["x"]).limit(0)).count() == 0


def test_texts(docs_of):
    text = "".join(random.Random(3).choices("abcdef ", k=300))
    got = {r.doc_id: r.text for r in X.dedup_texts(docs_of([(1, text), (2, "before " + text + " after"), (3, None)])).collect()}
    assert got == {1: text, 2: "before  after", 3: ""}


def test_anchors_of_long_texts_by_slabs():
    r = np.random.default_rng(5)
    data = r.integers(97, 103, 5000).astype(np.uint8)
    offsets = np.array([0, 30, 2600, 5000])
    whole, small = X.batch_anchors(data, offsets)[0], X.batch_anchors(data, offsets, size=300)[0]
    assert all((a == b).all() for a, b in zip(whole, small))
    hot = np.ones(X.HOT_CLASSES, bool)
    (none, *_), windows = X.batch_anchors(data, offsets, hot=hot)
    again = X.batch_anchors(data, offsets, size=300, hot=hot)[1]
    assert not len(none) and len(windows[0]) == 2471 + 2301
    assert sorted(zip(*(x.tolist() for x in windows), strict=True)) == sorted(zip(*(x.tolist() for x in again), strict=True))
