"""The trie of rebuilt conversations against a plain one of tuples."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tessera.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, role, text[:32], hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    own = {c: [(x[2], x[5]) for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    built = {c: own.get(c - c % 5, [])[: h[c]] + v[h[c] :] for c, v in own.items()}
    members: dict = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    out = []
    for node, cs in members.items():
        below = [p for p in members if p[: len(node)] == node]
        kids = [p for p in below if len(p) == len(node) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("clash")).withColumn("c", F.lit(1)).withColumn("name", F.lit(2)).repartition(3)
    return sorted((tuple(r) for r in T.trie(df).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def test_families_and_shared_turns(spark, monkeypatch):
    monkeypatch.setattr(T, "PART_ROWS", 50)
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant"]), r.choice(["ä", "hello", "", "x" * 40])) for c in range(60) for t in range(r.choice([1, 2, 3, 3, 9, 12])) if c % 7]
    rows += [(c, 0, "user", "hello") for c in range(100, 160)]  # a turn that most begin with
    assert run(spark, rows) == plain(rows)


def test_awkward_rows(spark):
    long_ = "y" * 300_000
    rows = [(None, 0, "user", "a"), (None, None, None, None), (1, None, None, None), (1, None, "user", "b"), (1, 0, "user", None), (2, 5, "user", long_), (2, 5, "user", long_), (2, 5, "user", long_ + "z"), (3, 1, "a", "b"), (3, 1, "a", "a"), (4, 0, "ab", "c"), (6, 0, "a", "bc"), (10, 0, None, ""), (11, 0, "", None)]
    rows += [(15, t, "user", str(t)) for t in range(40)]
    assert run(spark, rows) == plain(rows)


def test_a_conversation_without_turns_after_rebuilding_ends_at_the_root(spark):
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    got = run(spark, [(c, 0, "user", "gone"), (c, 1, "user", "gone too")])
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(None, 1, "user", "x")]) == []


def test_names_of_hot_pairs(spark, monkeypatch):
    from tessera.llm.common import Tables

    monkeypatch.setattr(T, "HOT_SHARE", 4)
    df = spark.createDataFrame([(k, "hot" if k % 2 else f"w{k % 30}") for k in range(200)], "k long, word string")
    got = T.named(df, ["word"], 200, Tables(spark)).collect()
    assert len(got) == 200
    names = {r["word"]: r["name"] for r in got}
    assert sorted(names.values()) == list(range(len(names))) and all(names[r["word"]] == r["name"] for r in got)
