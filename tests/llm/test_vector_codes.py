"""Vector codes against plain Lloyd's rounds in Python integers."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label string"


def plain(rows):
    """Full scans, no bounds."""
    kept = [(i, [int(np.floor(x * 4096)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 8
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(v, p) for _, v, _ in kept[:16]] for p in range(8)]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: [min(range(len(books[p])), key=lambda j: (d(part(v, p), books[p][j]), j)) for p in range(8)]
    for _ in range(6):
        codes = [near(v) for _, v, _ in kept]
        for p in range(8):
            for j in range(len(books[p])):
                own = [part(v, p) for (_, v, _), c in zip(kept, codes, strict=True) if c[p] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
            books = [[list(e) for e in b] for b in books]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, lab in kept:
        c = near(v)
        out.append((i, "".join(f"{j:02x}" for j in c), sum(d(part(v, p), books[p][c[p]]) for p in range(8)), lab))
    by: dict = {}
    for _, _, e, lab in out:
        by[lab] = by.get(lab, 0) + e
    return sorted(((i, c, e, by[lab], digest) for i, c, e, lab in out), key=repr)


def run(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("error", F.lit("clash")).withColumn("code", F.lit(1)).repartition(parts)
    return sorted((tuple(r) for r in V.compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


@pytest.mark.parametrize("spread", [1.0, 0.002, 40.0])
def test_equals_plain_rounds(spark, spread, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_VALUES", 16 * 30)  # several blocks
    r = np.random.default_rng(5)
    rows = [(i, (r.normal(size=16) * spread).tolist(), f"l{i % 3}") for i in range(200)]
    assert run(spark, rows) == plain(rows)


def test_awkward_rows(spark):
    r = np.random.default_rng(6)
    good = [(i, r.normal(size=8).round(1).tolist(), None if i % 2 else "x") for i in range(30)]
    bad = [(50, None, "x"), (51, [None, *[0.0] * 7], "x"), (52, [float("nan"), *[0.0] * 7], None), (53, [float("-inf"), *[0.0] * 7], "x")]
    repeats = [good[0], good[0], (None, good[3][1], None), (None, [0.0] * 8, "y"), (7, [-0.00001] * 8, "x")]
    assert run(spark, good + bad + repeats) == plain(good + bad + repeats)
    few = good[:5]
    assert run(spark, few) == plain(few)
    same = [(i, [0.5] * 8, "x") for i in range(40)]
    assert run(spark, same) == plain(same)
    assert run(spark, bad) == [] and run(spark, []) == []


def test_errors_are_told(spark):
    with pytest.raises(Exception, match="unlike lengths"):
        run(spark, [(0, [1.0] * 8, "x"), (1, [1.0] * 16, "x")], 1)
    with pytest.raises(Exception, match="equal parts"):
        run(spark, [(0, [1.0] * 9, "x")])
    with pytest.raises(Exception, match="too large"):
        run(spark, [(0, [1e30] * 8, "x")])


def test_salted_labels(spark, monkeypatch):
    monkeypatch.setattr(V, "BROADCAST_LABELS", 0)
    r = np.random.default_rng(7)
    rows = [(i, r.normal(size=8).tolist(), None if i % 3 else "x") for i in range(40)]
    assert run(spark, rows) == plain(rows)


def test_bounds_save_scans_and_never_change_a_code():
    r = np.random.default_rng(8)
    x = V.floors(r.normal(size=(3000, 32)) + 3 * r.integers(0, 5, (3000, 1))).reshape(3000, 8, 4)
    books = V.Codebooks(np.ascontiguousarray(x[:16].transpose(1, 0, 2)))
    state, scans = (None, None, None), []
    for _ in range(8):
        *state, n = books.assign(x, *state)
        full = V.Codebooks(books.entries).assign(x, None, None, None)
        assert (state[0] == full[0]).all()
        own = np.sqrt(np.stack([((x[:, p] - books.entries[p][state[0][:, p]]) ** 2).sum(-1) for p in range(8)], 1).astype(float))
        assert (state[1] >= own).all() and (state[2] <= np.sqrt(np.stack([np.sort(((x[:, p, None] - books.entries[p]) ** 2).sum(-1), 1)[:, 1] for p in range(8)], 1).astype(float))).all()
        scans.append(n)
        new = books.entries.copy()
        for p in range(8):
            for j in range(16):
                if (own := x[state[0][:, p] == j, p]).size:
                    new[p, j] = own.sum(0) // len(own)
        books = V.Codebooks(new, books.entries)
    assert scans[0] == 24_000 and scans[-1] < 0.6 * scans[0]
