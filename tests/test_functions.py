"""Hand-computed values of column functions."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import decay as D
from tessera.functions import metrics, udfs
from tessera.functions import text as T
from tessera.functions import vectors as V


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("column,want", [
    (lambda: T.tokens(F.lit("The Quick  Brown\tFOX")), ["the", "quick", "brown", "fox"]),
    (lambda: T.tokens(F.lit("a, b")), ["a,", "b"]),
    (lambda: T.cjk_segments(F.lit("hello中文world")), ["hello", "中文", "world"]),
    (lambda: T.jaccard(T.tokens(F.lit("a b c")), T.tokens(F.lit("b c d"))), 0.5),
    (lambda: T.jaccard(T.tokens(F.lit("")), T.tokens(F.lit("b"))), 0.0),
    (lambda: T.has_cjk(F.lit("한글")), True),
    (lambda: T.dominant_script(F.lit("привет мир")), "cyrillic"),
    (lambda: T.language(F.lit("привет")), "ru"),
    (lambda: T.token_estimate(F.lit("")), 1),
    (lambda: T.token_estimate(F.lit("a b c d")), 5),
    (lambda: T.wing_name(F.lit("My Wing-One")), "my_wing_one"),
    (lambda: T.entity_id(F.lit("O'Neil Ann")), "oneil_ann"),
    (lambda: T.iso_temporal(F.lit("2025-06")), None),
    (lambda: T.iso_temporal(F.lit("2025-06-01")), "2025-06-01"),
    (lambda: T.iso_temporal(F.lit("2025-06-01T01:02:03+00:00")), "2025-06-01T01:02:03Z"),
    (lambda: T.iso_temporal(F.lit("")), ""),
    (lambda: T.quoted_and_capitalised(F.lit('about "big plan" and Alice')), ["big plan", "Alice"]),
    (lambda: T.contains_count(F.lit("Rust and rusty"), ["rust", "rust", "go"]), 2),
    (lambda: T.truncate_bytes(F.lit("aé日b"), 4), "aé"),
    (lambda: T.truncate_bytes(F.lit("abc"), 9), "abc"),
    (lambda: T.slices(F.lit("x" * 20)), []),
    (lambda: T.resolved(F.lit("It was FIXED today")), True),
    (lambda: T.normalised_blocker(F.lit("Cannot open /a/b 42")), "cannot open <path> <num>"),
    (lambda: T.strip_noise(F.lit("a\n\n\n\nb<system-reminder>x\ny</system-reminder>")), "a\n\nb"),
    (lambda: T.observation_type(F.lit("mcp__grep_tool"), F.lit("")), "search"),
    (lambda: T.observation_type(F.lit(None).cast("string"), F.lit("user_prompt")), "conversation"),
    (lambda: T.markdown_compress(F.lit("a  \n\n\n\nb")), "a\n\nb"),
])
def test_text(spark, column, want):
    assert one(spark, column()) == want


def test_decay(spark):
    assert one(spark, D.ebbinghaus(F.lit(1.0), F.lit(0.1), F.lit(10.0))) == pytest.approx(0.36787944)
    assert one(spark, D.half_life_score(F.lit(1.0), F.lit(30.0), F.lit(30.0), F.lit(0))) == pytest.approx(0.5)
    assert one(spark, D.half_life_score(F.lit(1.0), F.lit(30.0), F.lit(30.0), F.lit(9))) == pytest.approx(0.61512925)
    assert one(spark, D.periodic(F.lit(1.0), F.lit(65.0), F.lit(30.0))) == pytest.approx(0.81)
    assert one(spark, D.weekly(F.lit(0.1), F.lit(0.05), F.lit(15.0))) == pytest.approx(0.05)
    assert one(spark, D.tier(F.lit(0.71))) == "episodic"


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert one(spark, V.cosine(a, b)) == pytest.approx(0.96)
    assert one(spark, V.norm(V.l2_normalise(a))) == pytest.approx(1)
    assert one(spark, V.l2_normalise(F.array(F.lit(0.0)))) == [0.0]
    assert one(spark, V.cosine(a, F.array(F.lit(1.0)))) is None
    assert [one(spark, V.similarity(m, F.lit(x))) for m, x in (("cosine", 0.2), ("l2", 1.0), ("ip", -0.7))] == pytest.approx([0.8, 0.5, 0.7])


def test_metrics(spark):
    assert udfs.dcg([1, 0.5], 2) == pytest.approx(1.31546488)
    hits = spark.createDataFrame([("q", 3, 1, 1), ("q", 0, 0, 1), ("r", 0, 0, 0), ("s", 0, 0, 2)], "query_id string, rank int, relevance int, n_correct int")
    got = {r.query_id: r for r in metrics.ranked_metrics(hits, 5).collect()}
    assert (got["q"].recall_any, got["r"].recall_any, got["s"].recall_any) == (1.0, 1.0, 0.0)
    assert got["q"].ndcg == pytest.approx(1 / math.log2(5))
    assert one(spark, metrics.token_f1(F.lit("the red, fox"), F.lit("a red dog"))) == pytest.approx(0.5)


def test_redaction(spark):
    key = "AKIA" + "A1" * 8
    assert udfs.redact_secrets(f"key {key}") == ("key <REDACTED:AWS_AKID>", [("AWS_AKID", 4, 24)])
    assert udfs.redact_secrets(f"é {key}")[1] == [("AWS_AKID", 3, 23)]
    assert udfs.redact_secrets(f"password = {key}")[0] == "<REDACTED:PASSWORD_VAR>"
    assert udfs.redact_secrets("plain sk-short") == ("plain sk-short", [])
    assert udfs.redact_secrets(f"key {key}", [r"key AKIA\w+"])[1] == []
    row = spark.createDataFrame([(f"x {key}",), (None,)], "t string").select(udfs.redacted(F.col("t")).alias("r")).collect()
    assert row[0].r.text == "x <REDACTED:AWS_AKID>" and row[0].r.kinds == ["AWS_AKID"] and row[1].r.text is None


def test_ids_and_names(spark):
    assert udfs.fnv1a(b"a", 32) == 0xE40C292C and udfs.fnv1a(b"a", 64) == 0xAF63DC4C8601EC8C
    a, b = (one(spark, udfs.cluster_id(F.lit("w"), F.array(*map(F.lit, ids)))) for ids in (["x", "y"], ["y", "x"]))
    assert a == b and a.startswith("auto-w-") and len(a) == 15
    assert udfs.edit_distance("kitten", "sitting") == 3 and udfs.spell("serch", ["search", "fetch"]) == "search" and udfs.spell("Serch", ["search"]) == "Serch"


def test_memories(spark):
    text = "We decided on tables rather than files, and the reasons are plain.\n\n```\ncode because\n```\n\nshort\n\nThe build had an error and crashed, then it stopped working again."
    rows = spark.createDataFrame([(1, text), (2, None)], "id long, content string")
    got = udfs.memories(rows).collect()
    assert [(r.kind, r.segment) for r in got] == [("decision", 0), ("problem", 3)] or [r.kind for r in got] == ["decision", "problem"]
    assert udfs.marker_score("fail fail", [r"(?i)\b(fail|bug)\b"]) == 2


def test_dialect(spark):
    from tessera.functions import dialect as D

    said = "We chose Kafka because it scales well. I love Kafka_streams, and Ada hopes it is the core API!\nThe reason why is KeyValue."
    rows = spark.createDataFrame([(said,), ("",), (None,), ("  \n",), ("ab cd",)], "t string")
    got = [r[0] for r in rows.select(D.line("t", F.lit("w"), F.lit(""), F.lit("2024-01-02"), F.lit("/a/notes.tar.gz"))).collect()]
    assert got == ["w|?|2024-01-02|notes.tar\n0:KAF+ADA|api_kafka_streams_keyvalue|\"The reason why is KeyValue\"|love+hope|DECISION+CORE+TECHNICAL", "", "", "", "w|?|2024-01-02|notes.tar\n0:???|misc"]
    assert [r[0] for r in rows.select(D.entities("t", {"Ada": "A1", "kafka": "K1"})).collect()][0] == ["A1"]
    assert D.top_words(said, 4) == ["api", "kafka_streams", "keyvalue", "ada"]
    long_ = "é" * 30 + " decided"
    assert one(spark, D.key_sentence(F.lit(long_))) == "é" * 26 + "..." and one(spark, D.key_sentence(F.lit("short. No."))) == ""
    assert one(spark, D.ratio(F.lit("a b c d e f g"), F.lit("a b"))) == 4.5 and one(spark, D.line(F.lit("Some words here"))) == "0:???|words|\"Some words here\""
