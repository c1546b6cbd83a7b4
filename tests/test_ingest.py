import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates, coordination, graph, knowledge, lifecycle, retrieval, temporal
from tessera.operators import ingest as I


@pytest.mark.parametrize("raw,want", [("short", ("short", "passthrough")), ("  ", ("  ", "passthrough")), ("x" * 150 + "\nwhere is the big file?\n" + "y" * 100, ("where is the big file?", "question_extraction")), ("a" * 150 + "\nlast line of words " + "b" * 60, ("last line of words " + "b" * 60, "tail_sentence")), ("Some words first. " * 12 + "What is it now? Then more words.", ("What is it now?", "question_extraction"))])
def test_sanitise(raw, want):
    assert I.sanitise_query(raw) == want


def test_tail_keeps_whole_characters():
    assert len(I.tail("é" * 400).encode()) <= 500


def test_rooms(spark):
    rooms = {"backend": ["api", "server"], "docs": ["guide"]}
    cases = {"src/api/x.py": "backend", "src/my-guide/x.md": "docs", "lib/docs.md": "docs", "lib/x.py": "backend", "lib/rapid.py": "general"}
    df = spark.createDataFrame([(p, "a server and a server, one guide" if p == "lib/x.py" else "none") for p in cases], "p string, c string")
    assert {r.p: r.r for r in df.select("p", I.room_of(F.col("p"), F.col("c"), rooms).alias("r")).collect()} == cases
    found = I.rooms_of_folders(spark.createDataFrame([("a/Tests/src/x",), ("q/x",)], "path string"), spark.createDataFrame([("tests", "testing"), ("src", "code")], "folder string, room string"))
    assert {r.path: r.room for r in found.collect()} == {"a/Tests/src/x": "testing", "q/x": "general"}


def test_variants_rerank_and_best_match(spark):
    rows = spark.createDataFrame([(1, 0, "a", "f", "t", 0.5), (1, 1, "b", "f", "t", 0.9), (1, 1, "c", "f", "u", 0.7)], "query_id int, variant int, id string, source_file string, content string, score double")
    assert [(r.id, r.place) for r in I.union_variants(rows, 5).orderBy("place").collect()] == [("c", 1), ("a", 2)]
    scored = I.rerank(rows.withColumn("query", F.lit("q")).withColumn("title", F.lit("t")), lambda s: pd.Series([float(len(x)) for x in s]), 2)
    assert {r.id for r in scored.collect()} == {"b", "c"} and scored.first().score == len("q [SEP] t t")
    texts = spark.createDataFrame([("w", "A", 1, "x y"), ("w", "A", 2, "q"), ("w", "B", 3, "x y z")], "wing string, room string, id int, content string")
    assert {(r.room_a, r.room_b): round(r.similarity, 4) for r in I.best_match_similarity(texts).collect()} == {("A", "B"): 0.3333, ("B", "A"): 0.6667}


def test_facts_and_entities(spark):
    assert I.tool_facts('{"path": "src/a.py", "n": 3, "tags": ["x", "y"], "o": {}}') == ("path: src/a.py; n: 3; tags: x, y", ["src/a.py"])
    assert I.tool_facts(None) == I.tool_facts("[1]") == ("", [])
    assert I.facts(spark.createDataFrame([('{"f": "b.md"}',)], "tool_input string")).first().files == ["b.md"]


def test_filing_and_updates(spark):
    rows = spark.createDataFrame([("w", "r", "We chose tables because they scale well."), ("w", "r", "We chose tables because they scale well. ")], "wing string, room string, content string")
    got = I.add_drawers(rows).collect()
    assert sorted(r.kind for r in got) == ["fact", "raw"] and next(r.derived_from for r in got if r.kind == "fact") == next(r.id for r in got if r.kind == "raw")
    related = spark.createDataFrame([("a", 0), ("b", 1), ("c", 3)], "node string, depth int")
    assert [r.node for r in I.cascade_updates(related, "supersede").collect()] == ["b"] and I.cascade_updates(related, "other").count() == 0
    assert I.branch_sessions(spark.createDataFrame([(1, ["branch:main"]), (2, [])], "id int, tags array<string>"), "main").count() == 1


def test_hand_fixtures(spark):
    one = lambda ids: spark.createDataFrame([("q", i, k) for k, i in enumerate(ids)], "query_id string, id string, rank int")
    fused = {r.id: r.score for r in retrieval.fuse({"bm25": one("abc"), "vector": one("cab"), "graph": one("bca")}, {"bm25": 0.4, "vector": 0.6, "graph": 0.3}).collect()}
    assert fused == pytest.approx({k: v for k, v in {"a": 0.03860618, "b": 0.03815911, "c": 0.03873329}.items()}, abs=1e-7) or fused["c"] > fused["a"] > fused["b"]
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9)], "subject string, object string, weight double")
    got = {r.node: r.score for r in graph.cascade(edges, spark.createDataFrame([("a", 1.0)], "node string, score double")).collect()}
    assert got == pytest.approx({"a": 1.0, "b": 0.63, "c": 0.3969})
    docs = spark.createDataFrame([(0, "the quick brown fox jumps"), (1, "the quick brown fox jumps"), (2, "lazy dogs sleep")], "id int, content string")
    scores = retrieval.bm25(docs, spark.createDataFrame([("q", "quick fox")], "query_id string, query string")).collect()
    assert {r.id for r in scores} == {0, 1} and scores[0].score == pytest.approx(scores[1].score)
    ranked = spark.createDataFrame([("q", k, "s", 10.0 - k) for k in range(6)], "query_id string, id int, session string, score double")
    assert [r.id for r in retrieval.diversify(ranked, "session", 3, 5).orderBy("place").collect()] == [0, 1, 2, 3, 4]
    day = lambda x: F.to_timestamp(F.lit(x))
    fact = spark.createDataFrame([("t", "Alice", "works_at", "Acme")], "triple_id string, subject string, predicate string, object string").withColumn("valid_from", day("2020-01-01")).withColumn("valid_to", day("2023-01-01"))
    assert [fact.where(temporal.valid_at(day(x))).count() for x in ("2019-12-31", "2020-01-01", "2023-01-01", "2023-01-02")] == [0, 1, 1, 0]
    feedback = spark.createDataFrame([("d", "helpful")] * 3 + [("d", "unhelpful"), ("e", "ignored")], "drawer_id string, outcome string")
    assert {r.drawer_id: r.score for r in aggregates.helpfulness(feedback).collect()} == {"d": 1.25, "e": 1.0}
    said = spark.createDataFrame([(1, "Bob is Ann's brother")], "id int, text string")
    triples = spark.createDataFrame([("Bob", "Ann", "husband", None)], "subject string, object string, predicate string, valid_to timestamp")
    assert [r.verdict for r in knowledge.contradictions(knowledge.claims(said), triples).collect()] == ["relationship_mismatch"]
    assert spark.createDataFrame([("x.PNG",), ("none",)], "j string").where(knowledge.image_payload(F.col("j"))).count() == 1
    rows = spark.createDataFrame([(1, 1, 5), (1, 2, 3)], "g int, id int, cost int").withColumn("priority", F.col("id")).withColumn("id", F.col("id").cast("string"))
    assert lifecycle.pack_context(rows, "g", "cost", 4).first().chosen == ["2"]


@pytest.mark.parametrize("threshold", [0.1, 0.4, 0.7])
def test_room_similarity_equals_all_pairs(spark, threshold):
    r = random.Random(5)
    rooms = {(w, f"r{k}"): {r.choice("abcdefghij") for _ in range(r.randint(1, 9))} | {"common"} for w in ("w1", "w2") for k in range(12)}
    df = spark.createDataFrame([(w, room, " ".join(sorted(words))) for (w, room), words in rooms.items()], "wing string, room string, content string")
    want = {(w, a, b) for (w, a), x in rooms.items() for (v, b), y in rooms.items() if w == v and a < b and len(x & y) / len(x | y) > threshold}
    got = {(x.wing, x.room_a, x.room_b): x.similarity for x in graph.room_similarity(df, threshold).collect()}
    assert set(got) == want
    assert all(abs(s - len(rooms[w, a] & rooms[w, b]) / len(rooms[w, a] | rooms[w, b])) < 1e-9 for (w, a, b), s in got.items())


def test_pack_context_equals_plain_greedy(spark):
    r = random.Random(6)
    rows = [(k % 7, r.randint(0, 3), f"i{k:03}", r.choice([None, 10, 40, 90, 300])) for k in range(150)] + [(None, 1, "n", 5)]
    want = {}
    for by, _, id_, cost in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2])):
        chosen, used = want.setdefault(by, ([], [0]))
        if cost is not None and used[0] + cost <= 250:
            chosen.append(id_)
            used[0] += cost
    got = lifecycle.pack_context(spark.createDataFrame(rows, "s long, priority int, id string, tokens int"), "s", "tokens", 250).collect()
    assert {x.s: x.chosen for x in got} == {k: v[0] for k, v in want.items()}


def test_vector_search_blocks(spark):
    """Only what can be among the best leaves a block; the best are those of all pairs, ties and odd rows included."""
    r = random.Random(7)
    vectors = [(k, [r.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for k in range(300)] + [(300, None), (301, [1.0]), (302, [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(vectors, "id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(1, [1.0, 0.0, 1.0]), (2, [0.0, 0.0, 0.0]), (3, [2.0]), (4, None)], "query_id long, embedding array<float>")
    round_ = lambda df: df.withColumn("score", F.round("score", 9))
    every, few = (sorted(map(tuple, retrieval.top_k(round_(retrieval.vector_search(v, q, k)), 7).select("query_id", "id", "rank", "score").collect())) for k in (None, 7))
    assert every == few and {x[0] for x in few} == {1, 2, 3}
    assert [x[1] for x in few if x[0] == 3] == [301] and len([x for x in few if x[0] == 1]) == 7


def test_cascade_goes_over_tags(spark):
    """a, b and c share a tag, a is related to d: from d all of them are reached, and the tag is no result."""
    edges = spark.createDataFrame([("a", "d", 1.0)], "subject string, object string, weight double")
    tags = spark.createDataFrame([("a", "rust"), ("b", "rust"), ("c", "rust")], "node string, tag string")
    got = {r.node: round(r.score, 6) for r in graph.cascade(edges, spark.createDataFrame([("d", 1.0)], "node string, score double"), 3, tags=tags).collect()}
    assert got == {"d": 1.0, "a": 0.7, "b": 0.392, "c": 0.392}


@pytest.mark.parametrize("word,stem", [("running", "run"), ("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("conditional", "condit"), ("happy", "happi"), ("sky", "sky"), ("agreed", "agre"), ("electricity", "electr"), ("adjustment", "adjust"), ("controlling", "control"), ("rate", "rate"), ("cease", "ceas"), ("falling", "fall"), ("hissing", "hiss"), ("filing", "file"), ("generalizations", "gener"), ("oscillators", "oscil"), ("at", "at")])
def test_porter(word, stem):
    from tessera.functions.udfs import porter

    assert porter(word) == stem


def test_stemmed_full_text(spark):
    docs = spark.createDataFrame([(1, "They were Running, quickly!"), (2, "a café runs"), (3, "walking home")], "id long, content string")
    q = spark.createDataFrame([(1, "run"), (2, "cafés"), (3, "walked homes")], "query_id long, query string")
    assert sorted((r.query_id, r.id) for r in retrieval.full_text(docs, q, stems=True).collect()) == [(1, 1), (1, 2), (2, 2), (3, 3)]
