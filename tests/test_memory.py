import pandas as pd
import pytest

from tessera.memory import Memory


def embed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [float(t.count(c)) for c in "abcdefgh"])


@pytest.mark.parametrize("with_vectors", [True, False])
def test_life_of_a_memory(spark, tmp_path, with_vectors):
    m = Memory(spark, str(tmp_path / "memory"), embed if with_vectors else None)
    q = spark.createDataFrame([(1, "badge of the cab")], "query_id long, query string")
    assert m.search(q).count() == 0
    m.add(spark.createDataFrame([("d1", "a badge in the cab", "w1", "r1"), ("d2", "other words", "w1", "r2"), ("d3", "the bag", "w2", "r1")], "id string, content string, wing string, room string"))
    m.add(spark.createDataFrame([("d2", "cab and face", "w1", "r2")], "id string, content string, wing string, room string"))
    assert {r.id: r.content for r in m.table("drawers").collect()} == {"d1": "a badge in the cab", "d2": "cab and face", "d3": "the bag"}
    assert m.search(q, 1).first().id == "d1" and {r.id for r in m.search(q, 5, wing="w2").collect()} == {"d3"}
    assert m.search(q, 5, "overlap", room="r2").first().id == "d2"
    m.tag(spark.createDataFrame([("d1", "t"), ("d1", "t"), ("d2", "t")], "node string, tag string"))
    m.link(spark.createDataFrame([("d1", "relates", "d3", 0.5)], "subject string, predicate string, object string, weight double"))
    m.link(spark.createDataFrame([("d1", "relates", "d3", 0.9)], "subject string, predicate string, object string, weight double"))
    assert {(r.node, round(r.score, 4)) for r in m.cascade(spark.createDataFrame([("d3", 1.0)], "node string, score double")).collect()} == {("d3", 1.0), ("d1", 0.35), ("d2", 0.196)}
    assert {r.node for r in m.related(spark.createDataFrame([("d1",)], "node string")).collect()} == {"d1", "d3"}
    m.boost(spark.createDataFrame([("d3",)], "id string"), 0.8)
    assert [(r.id, r.importance, r.accesses) for r in m.fetch(["d3", "d1"]).collect()] == [("d3", 1.0, 1), ("d1", 0.5, 0)]
    assert {r.id for r in m.story(20).collect()} == {"d1", "d3"}
    m.delete(spark.createDataFrame([("d1",)], "id string"))
    assert {r.id for r in m.recent().collect()} == {"d2", "d3"} and m.table("links").count() == 0 and m.table("tags").count() == 1
    assert m.table("vectors").count() == (2 if with_vectors else 0)
    m.export(str(tmp_path / "out"))
    assert (tmp_path / "out" / "wing=w2" / "room=r1").exists()
