import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash as S
from tessera.llm.common import components


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, reach=3):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= reach and label[i] != label[j]:
                a, b = max(label[i], label[j]), min(label[i], label[j])
                label = [b if x == a else x for x in label]
    return label


def test_shard_links_equals_brute_force(monkeypatch):
    monkeypatch.setattr(S, "LEAF", 8)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    points = np.unique(np.concatenate([base, *[base ^ np.uint64((1 << int(a)) | (1 << int(b))) for a, b in rng.integers(0, 64, (6, 2))]]))
    want, got = brute_components([int(p) for p in points]), S.shard_links(points, np.ones(len(points), bool))
    assert list(got) == want


def test_route_meets_every_pair():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    near = points ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64))
    both = np.concatenate([points, near])
    vantage, radius = S.upper_tree(points[:500], 5)
    index, leaf, home = S.route(both, vantage, radius, 5)
    assert np.bincount(index[home], minlength=6000).max() == 1 and home.sum() == 6000
    visits, homes = {}, {}
    for i, s, h in zip(index, leaf, home):
        visits.setdefault(i, set()).add(s)
        if h:
            homes[i] = s
    for i in range(3000):  # the one with the earlier home asks in the other's
        assert homes[i + 3000] in visits[i] or homes[i] in visits[i + 3000]


def test_near_duplicates_equals_brute_force(docs_of, awkward):
    r = random.Random(5)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(r.randint(1, 60))) for _ in range(60)]
    for k in range(0, 60, 3):
        words = (texts[k] * 3).split()
        words[r.randrange(len(words))] = "changed"
        texts += [texts[k], texts[k].upper(), " ".join(words)]
    rows = [(i, t) for i, t in awkward if i is not None] + [(100 + k, t) for k, t in enumerate(texts)]
    prints = [brute_print(t) for _, t in rows]
    label = brute_components(prints)
    least = {x: min(rows[k][0] for k in range(len(rows)) if label[k] == x) for x in set(label)}
    want = sorted((i, f"{p:016x}", least[x]) for (i, _), p, x in zip(rows, prints, label))
    assert sorted(map(tuple, S.near_duplicates(docs_of(rows)).select("doc_id", "fingerprint", "component_id").collect())) == want


def test_blocks_of_an_overfull_shard(spark, monkeypatch):
    rng = np.random.default_rng(9)
    ball = {int(np.uint64(7) ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b))) for a, b in rng.integers(0, 62, (300, 2))}
    df = spark.createDataFrame([(x,) for x in ball], "fp long")
    links = S.fingerprint_links(df, shard=20)
    assert components(links).select("root").distinct().count() == 1


def test_keep_one(docs_of, awkward):
    out = S.keep_one(docs_of(awkward))
    rows = sorted((r.doc_id is None, r.doc_id) for r in out.collect())
    ids = [i for null, i in rows if not null]
    assert 3 in ids and 4 not in ids and len(ids) == len(set(ids))
    assert 0 in ids and 1 not in ids and 2 not in ids  # fingerprint zero is one group
    assert out.columns == docs_of(awkward).columns
    other = [(None, "one text of its own with several words in it"), (None, "quite another text that shares nothing with the first"), (None, "quite another text that shares nothing with the first")]
    assert S.keep_one(docs_of([*awkward, *other])).where("doc_id IS NULL AND text LIKE '%text%'").count() == 2


def test_keep_one_tells_documents_of_one_id_apart(docs_of):
    a, b, c = "first text of some length here", "second text that shares no words with it at all", "third one is unlike both others entirely"
    docs = docs_of([(1, a), (1, b), (1, b), (2, b.upper()), (3, c), (3, a)]).withColumn("document_key", F.lit(5)).withColumn("TEXT_DIGEST", F.lit(6))
    out = S.keep_one(docs)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, a), (1, b), (3, c)]
    assert out.columns == docs.columns and {(r.document_key, r.TEXT_DIGEST) for r in out.collect()} == {(5, 6)}


def test_forest_equals_plain_union():
    rng = np.random.default_rng(2)
    forest, label = S.Forest(200), list(range(200))
    for _ in range(60):
        a, b = rng.integers(0, 200, (2, 4))
        forest.link(a, b)
        for x, y in zip(a, b, strict=True):
            low, high = sorted((label[x], label[y]))
            label = [low if v == high else v for v in label]
        assert forest.label.tolist() == label


def test_empty(docs_of):
    assert S.near_duplicates(docs_of(["x"]).limit(0)).count() == 0
    assert S.keep_one(docs_of(["x"]).limit(0)).count() == 0


@pytest.mark.parametrize("edges,want", [([], {}), ([(1, 2), (2, 3), (5, 5), (9, 8)], {1: 1, 2: 1, 3: 1, 5: 5, 8: 8, 9: 8}), ([(k, k + 1) for k in range(30)], dict.fromkeys(range(31), 0)), ([(0, k) for k in range(1, 40)], dict.fromkeys(range(40), 0))])
def test_components(spark, edges, want):
    df = spark.createDataFrame(edges, "u long, v long")
    assert {r.node: r.root for r in components(df).collect()} == want
