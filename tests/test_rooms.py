"""Ranks of rooms for many queries at once against plain power iteration; BM25 within candidates against a plain one."""

import math

import pytest

from tessera.operators import graph as G
from tessera.operators import retrieval as R

ROOMS = {"kitchen": ["w1", "w2"], "cellar": ["w2"], "attic": ["w1"], "shed": ["w3"], "barn": ["w3"], "alone": ["w4"]}


def plain(seeds, rounds, teleport=0.15):
    near = {a: [(b, len(set(ROOMS[a]) & set(ROOMS[b]))) for b in ROOMS if b != a and set(ROOMS[a]) & set(ROOMS[b])] for a in ROOMS}
    total = sum(seeds.values())
    base = {a: seeds.get(a, 0.0) / total for a in ROOMS}
    rank = dict(base)
    for _ in range(rounds):
        new = {a: teleport * base[a] for a in ROOMS}
        for a in ROOMS:
            links = sum(n for _, n in near[a])
            for b, n in near[a]:
                new[b] += (1 - teleport) * rank[a] * n / links
        rank = new
    return rank


def test_ranks_of_queries(spark):
    nodes = spark.createDataFrame(list(ROOMS.items()), "room string, wings array<string>")
    asked = {"x": {"kitchen": 1.0, "shed": 3.0}, "y": {"alone": 2.0}, "z": {r: 1.0 for r in ROOMS}}
    seeds = spark.createDataFrame([(q, r, m) for q, s in asked.items() for r, m in s.items()], "query_id string, room string, mass double")
    for rounds in (1, 6):
        got = {(r.query_id, r.room): r["rank"] for r in G.pagerank_of_queries(nodes, seeds, rounds=rounds).collect()}
        for q, s in asked.items():
            for room, rank in plain(s, rounds).items():
                assert got.get((q, room), 0.0) == pytest.approx(rank, abs=1e-9)
    few = {(r.query_id, r.room): r["rank"] for r in G.pagerank_of_queries(nodes, seeds, rounds=40, least=1e-3).collect()}
    assert all(abs(few.get((q, room), 0.0) - rank) < 0.02 for q, s in asked.items() for room, rank in plain(s, 40).items())


def test_room_ranks_and_fusion(spark):
    nodes = spark.createDataFrame(list(ROOMS.items()), "room string, wings array<string>")
    queries = spark.createDataFrame([(1, "the Kitchen cell"), (2, "nothing"), (3, None)], "query_id long, query string")
    ranks, seedings = G.room_ranks(nodes, queries, rounds=4)
    assert {r.query_id: r.seeding for r in seedings.collect()} == {1: "q1", 2: "all", 3: "all"}
    hits = spark.createDataFrame([(1, 7, 0.5, "kitchen"), (1, 8, 0.5, "shed"), (2, 9, 0.1, "barn")], "query_id long, id long, score double, room string")
    got = {(r.query_id, r.id): r.fused for r in R.fuse_rooms(hits, ranks, seedings).collect()}
    own, every = plain({"kitchen": 1.0, "cellar": 1.0}, 4), plain({r: 1.0 for r in ROOMS}, 4)
    assert got[1, 7] == pytest.approx(0.35 + 0.3 * own["kitchen"]) and got[1, 8] == pytest.approx(0.35) and got[2, 9] == pytest.approx(0.07 + 0.3 * every["barn"])
    alone = {(r.query_id, r.id): r.fused for r in R.fuse_rooms(hits, ranks, seedings, "ppr").collect()}
    assert alone[1, 8] == 0 and alone[1, 7] == pytest.approx(own["kitchen"])


def test_rerank_counts_within_candidates(spark):
    texts = {1: "a b b c", 2: "a a", 3: "z", 4: None, 5: "b"}
    candidates = spark.createDataFrame([(1, i, 0.1 * i, t) for i, t in texts.items()] + [(2, 1, 0.3, texts[1])], "query_id long, id long, score double, content string")
    queries = spark.createDataFrame([(1, "B a b"), (2, "nowhere")], "query_id long, query string")
    got = {(r.query_id, r.id): r.blended for r in R.rerank(candidates, queries, 4).collect()}
    words = {i: (t or "").split() for i, t in texts.items()}
    avg = sum(map(len, words.values())) / 5

    def blended(i):
        b = sum(n * math.log((5 - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[i]) / avg)) for w, n in (("a", 1), ("b", 2)) if (tf := words[i].count(w)) for df in [sum(w in x for x in words.values())])
        return 0.7 * 0.1 * i + 0.3 * b / (b + 1)

    best = sorted(texts, key=lambda i: -blended(i))[:4]
    assert {i for q, i in got if q == 1} == set(best) and all(got[1, i] == pytest.approx(blended(i)) for i in best) and got[2, 1] == pytest.approx(0.21)
