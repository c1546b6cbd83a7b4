"""Overlapping paths, clusters and greedy choices against plain loops over all pairs."""

import fnmatch
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import clusters as CL
from tessera.operators import coordination as C


def overlaps(wanted, held, both_ways):
    one = lambda p, t: p == t or ("*" in p or "?" in p) and fnmatch.fnmatchcase(t, p.replace("[", "[[]"))
    return all(one(p, t) or both_ways and one(t, p) for p, t in zip(wanted.split("/"), held.split("/"), strict=False))


PATHS = ["src/main.rs", "src/*.rs", "src", "src/", "src/a/b.rs", "src/a", "src/a/*", "*", "**", "*/a", "?rc/main.rs", "src/main.r?", "src/m*n.rs", "src/ma", "", "docs/a", "docs/[x].md", "docs/*.md", "src/a+b", "src/a.b", "src/a*b", "/abs/x", "/abs"]


@pytest.mark.parametrize("both_ways", [False, True])
def test_paths(spark, both_ways):
    held = spark.createDataFrame([(p,) for p in PATHS] + [(None,)], "held_path string").withColumn("_x", F.lit(1))
    wanted = spark.createDataFrame([(p,) for p in PATHS], "path string")
    got = sorted((r.path, r.held_path or "") for r in C.overlapping_paths(held, wanted, both_ways).collect())
    assert got == sorted((w, h) for w in PATHS for h in [*PATHS, ""] if overlaps(w, h, both_ways))


def test_conflicts(spark):
    rows = [(2, "src/a", "x", True, False), (1, "src/a/b.rs", "y", True, True), (3, "docs", "x", True, False), (4, "lib", "y", False, True)]
    held = spark.createDataFrame(rows, "reservation_id long, path string, agent_id string, active boolean, exclusive boolean").withColumn("expires_at", F.lit(9))
    wanted = spark.createDataFrame([("src/*/b.rs", "x", False), ("src/a/c.rs", "y", False), ("src/a/c.rs", "y", True), ("src", "z", False), ("docs/x.md", "z", False), ("lib/a", "z", True), ("docs/*", "x", True)], "path string, agent_id string, exclusive boolean")
    got = {(r.path, r.agent_id, r.exclusive): (r.verdict, r.holder) for r in C.conflicts(held, wanted).collect()}
    assert got == {("src/*/b.rs", "x", False): ("conflict", "y"), ("src/a/c.rs", "y", True): ("conflict", "x"), ("src", "z", False): ("conflict", "y"), ("docs/*", "x", True): ("same_agent", "x")}
    assert C.conflicts(held.limit(0), wanted).count() == 0


def test_reservations_of_a_path_meet_once(spark, monkeypatch):
    rows = [(k, "src/a" if k % 2 else None, "xy"[k % 3 % 2], k % 5 == 0, k % 50 - k // 50) for k in range(3000)]
    held = spark.createDataFrame(rows, "reservation_id long, path string, agent_id string, exclusive boolean, expires_at long").withColumn("active", F.col("reservation_id") > 30)
    wanted = spark.createDataFrame([("src/a", "x", False), ("", "y", True), ("src/*", "z", False)], "path string, agent_id string, exclusive boolean")
    met, plain = [], C.overlapping_paths
    monkeypatch.setattr(C, "overlapping_paths", lambda held, *rest: met.append(held.count()) or plain(held, *rest))
    got = {r.path: (r.verdict, r.holder, r.until) for r in C.conflicts(held, wanted).collect()}
    want = {}
    for path, agent, exclusive in (("src/a", "x", False), ("", "y", True), ("src/*", "z", False)):
        first = min(r for r in rows if r[0] > 30 and overlaps(path, r[1] or "", False) and (r[2] == agent or exclusive or r[3]))
        want[path] = ("same_agent" if first[2] == agent else "conflict", first[2], first[4])
    assert got == want and met == [8]


def folded(clusters, threshold):
    """Pairs in order, each later cluster into the first that it overlaps."""
    ids, members, into = sorted(clusters), {c: set(m) for c, m in clusters.items()}, {}
    for a, b in itertools.combinations(ids, 2):
        if len(clusters[a] & clusters[b]) / min(len(clusters[a]), len(clusters[b])) > threshold and b not in into:
            into[b] = a
            members[a] |= members[b] if b not in into.values() else clusters[b]
    return {c: (into.get(c), members[c]) for c in ids}


def random_clusters(seed, n=60):
    r = random.Random(seed)
    out = {k: {0} | {r.randrange(80) for _ in range(r.choice([1, 2, 5, 12]))} for k in range(n)}  # one member that all share
    return out | {n + k: set(out[k]) for k in range(5)}


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_refined_clusters(spark, threshold):
    clusters = random_clusters(int(threshold * 10))
    df = spark.createDataFrame([(c, m) for c, ms in clusters.items() for m in ms] + [(None, 1), (1, None)], "cluster_id long, member_id long")
    vectors = spark.createDataFrame([(m, [float(m), 1.0]) for m in range(70)], "member_id long, embedding array<double>")
    got = {r.cluster_id: (r.absorbed_by, r["size"], r.centroid) for r in CL.refine(df, vectors, threshold).collect()}
    want = folded(clusters, threshold)
    assert {c: x[:2] for c, x in got.items()} == {c: (into, len(ms)) for c, (into, ms) in want.items()}
    for c, (_, ms) in want.items():
        known = [m for m in ms if m < 70]
        assert got[c][2] == pytest.approx([sum(known) / len(known), 1.0])


@pytest.mark.parametrize("threshold", [0.3, 1.0])
def test_overlapping_lists_equal_clusters(spark, threshold):
    clusters = random_clusters(3) | {99: {500, 501}, 98: {500, 501}, 97: {500, 501}}
    df = spark.createDataFrame([(c, m) for c, ms in clusters.items() for m in ms] + [(None, 1), (1, None)], "cluster_id long, member_id long")
    got = {(r.a, r.b): r.overlap for r in CL.overlapping(df, threshold).collect()}
    share = {(a, b): len(clusters[a] & clusters[b]) / min(len(clusters[a]), len(clusters[b])) for a, b in itertools.combinations(sorted(clusters), 2)}
    assert got == pytest.approx({k: x for k, x in share.items() if x > threshold + 1e-9})


def test_clusters_settle(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "c"), (3, "d"), (4, "x"), (4, "y")], "cluster_id long, member_id string")
    assert sorted(map(tuple, CL.refine_all(df, 0.4).collect())) == [(1, "a"), (1, "b"), (1, "c"), (1, "d"), (4, "x"), (4, "y")]
    assert CL.refine_all(df.limit(0)).count() == 0 and CL.refine(df.limit(0)).count() == 0


def greedy(rows, distance=0.15):
    """The rule of a source, one drawer after the other."""
    out, groups = {}, {}
    for i, source, text in rows:
        groups.setdefault(source, []).append((-len((text or "").encode()), i, frozenset((text or "").lower().split())))
    for group in groups.values():
        kept = []
        for size, i, words in sorted(group, key=lambda x: x[:2]):
            if -size < 20:
                out[i] = "short"
            elif len(group) >= 5 and words and any(1 - len(words & k) / len(words | k) < distance for k in kept if k):
                out[i] = "dropped"
            else:
                out[i] = "kept"
                kept.append(words)
    return out


def test_greedy_near_duplicates(spark):
    r = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for source in ("a", "a", "a", "b", None, "few"):
        for _ in range(4 if source == "few" else 30):
            base = [r.choice(words) for _ in range(30)] + ["common", "also"]
            for _ in range(r.choice([1, 1, 2, 4])):
                text = [w if r.random() > 0.03 else r.choice(words) for w in base]
                rows.append((n, source, " ".join(text)))
                n += 1
            if source == "few":
                break
    rows += [(n, "a", None), (n + 1, "a", " " * 30), (n + 2, "a", "\n" * 25), (n + 3, "a", "tiny"), (n + 4, "few", rows[-1][2]), (n + 5, "b", "x" * 100_000)]
    got = {x.id: x.status for x in CL.within_source(spark.createDataFrame(rows, "id long, source_file string, content string").repartition(3)).collect()}
    want = greedy(rows)
    assert got == want and set(want.values()) == {"kept", "dropped", "short"}
    assert CL.within_source(spark.createDataFrame([], "id long, source_file string, content string")).count() == 0


def test_first_independent_on_a_chain(spark):
    nodes = spark.createDataFrame([(k, k) for k in range(12)], "node long, rank long")
    edges = spark.createDataFrame([(k, k + 1) for k in range(11)] + [(k + 1, k) for k in range(11)], "u long, v long")
    assert {r.node for r in CL.first_independent(nodes, edges).where("kept").collect()} == {0, 2, 4, 6, 8, 10}


def test_introductions_without_claims(spark):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [("a", "Hello all", at(0)), ("a", "I am available", at(90)), ("a", "working on it", at(150)), ("b", "intro", at(0)), ("b", "hello", at(5)), ("c", "hello", at(0)), ("c", None, at(1)), (None, "starting", at(2)), ("d", "Already claimed by a", at(3))]
    events = spark.createDataFrame(rows, "agent_id string, content string, ts timestamp")
    assert sorted((r.agent_id or "", r.ts) for r in C.unclaimed_introductions(events).collect()) == [("", at(2)), ("a", at(0)), ("b", at(0)), ("b", at(5)), ("c", at(0))]
    assert {(r.agent_id, r.n) for r in C.stale_introductions(events).collect()} == {("b", 2)}
    assert {(r.agent_id, r.n) for r in C.duplicate_work(events).collect()} == {("d", 1)}
