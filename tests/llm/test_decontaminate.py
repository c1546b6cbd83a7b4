import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate as D

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit("clash"))


def brute_tiles(doc, item, least):
    """Greedy string tiling as written down: all pairs of places, longest match first."""
    used_d, used_i, tiles = set(), set(), []
    while True:
        best = None
        for b in range(len(item)):
            for a in range(len(doc)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and a + n not in used_d and b + n not in used_i:
                    n += 1
                if n >= least and (best is None or (-n, b, a) < best):
                    best = (-n, b, a)
        if best is None:
            return tiles
        n, b, a = -best[0], best[1], best[2]
        tiles.append((a, b, n))
        used_d.update(range(a, a + n)), used_i.update(range(b, b + n))


def test_tiling_equals_brute_force():
    r = random.Random(4)
    for _ in range(150):
        words = [b"a", b"b", b"c", b"d"]
        doc, item = [r.choice(words) for _ in range(r.randint(0, 30))], [r.choice(words) for _ in range(r.randint(3, 15))]
        index = D.BenchmarkIndex([(1, b" ".join(item).decode())], seed=3)
        got = D.coverages(index, doc)
        want = brute_tiles(doc, item, min(3, len(item)))
        covered = got[0][1] if got else 0.0
        assert covered == pytest.approx(sum(n for *_, n in want) / len(item))


def test_catches_whole_reordered_and_edited_passages(spark, docs_of, awkward):
    words = ITEM.split()
    moved = " ".join(words[10:] + ["filler"] * 5 + words[:10])
    edited = " ".join(words[:8] + ["other"] + words[9:])
    part = " ".join(words[:7])
    rows = [(10, f"some words before, {ITEM.upper()}! and after"), (11, moved), (12, edited), (13, part), (14, "nothing of it here at all")]
    got = {(r.doc_id, r.item_id): r for r in D.contaminated(docs_of(rows + awkward), bench(spark, [(1, ITEM), (2, None), (3, "")])).collect()}
    assert set(got) == {(10, 1), (11, 1), (12, 1)}
    assert got[10, 1].coverage == 1.0 and got[11, 1].n_tiles == 2 and got[12, 1].coverage == 0.95


def test_blocks_give_the_same_rows(spark, docs_of):
    items = [(k, " ".join(f"w{(7 * k + j) % 50}" for j in range(20))) for k in range(30)]
    docs = docs_of([(k, t) for k, t in items] + [(100, "clean text of other words")])
    one = sorted(map(tuple, D.contaminated(docs, bench(spark, items)).collect()))
    many = sorted(map(tuple, D.contaminated(docs, bench(spark, items), block_bytes=500).collect()))
    assert one == many and len({r[0] for r in one}) == 30


def test_short_items_must_occur_whole(spark, docs_of):
    got = D.contaminated(docs_of([(1, "say open the door now"), (2, "open a door")]), bench(spark, [(9, "open the door")])).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 9)]


def test_drop_and_empty(spark, docs_of, awkward):
    docs = docs_of([(10, ITEM), *awkward])
    kept = D.drop_contaminated(docs, bench(spark, [(1, ITEM)]))
    assert kept.schema == docs.schema and kept.count() == len(awkward)
    nothing = bench(spark, [(1, ITEM)]).limit(0)
    assert D.drop_contaminated(docs, nothing).count() == len(awkward) + 1 and D.contaminated(docs, nothing).count() == 0
    assert D.contaminated(docs.limit(0), bench(spark, [(1, ITEM)])).count() == 0


def test_one_repeated_word(monkeypatch):
    """A long text of one word against an item of the same word: a match for each diagonal is held, not a pair for each two places."""
    monkeypatch.setattr(D, "CHUNK", 5000)
    item = ["word"] * 100
    index = D.BenchmarkIndex([(1, " ".join(item))])
    matches = index.seeds(np.ones(20_000, np.int64))
    (width, p, q, n) = matches[0][0]
    assert width == D.SEED and len(p) == 20_000 + 100 - 2 * D.SEED + 1 and n.max() == 100
    assert D.coverages(index, [b"word"] * 20_000) == [(0, 1.0, 1)]
    assert [sum(t[2] for t in brute_tiles([b"word"] * 30, [b"word"] * 12, 6))] == [sum(t[2] for t in D.tile(*BenchmarkRuns(30, 12)))]


def BenchmarkRuns(doc, item):
    return D.BenchmarkIndex([(1, " ".join(["word"] * item))]).seeds(np.ones(doc, np.int64))[0][0]
