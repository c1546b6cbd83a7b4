"""Queries over tables with odd rows give what DuckDB gives."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tessera.operators import clusters as CL
from tessera.operators import retrieval as R
from tessera.plans import registry
from tests.test_oracles import rows


def same(spark, folder, name, **tables):
    """The query's rows, which are those of its SQL."""
    con = duckdb.connect()
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df, found = registry.queries()[name](spark, str(folder)), con.execute(registry.oracle_sql()[name])
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows([d[0] for d in found.description], found.fetchall())
    return got


def documents(texts):
    return {"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts), "lang": ["en"] * len(texts), "source": ["src1"] * len(texts)}


def test_texts_without_segments(spark, tmp_path):
    assert len(same(spark, tmp_path, "script_segments", documents=documents(["", "", " \n", "\t ", "a 中文 b", "x"]))) == 6


def near_copies(seed, n):
    """Texts of which many are copies, in other orders too, or nearly so."""
    r = random.Random(seed)
    words, out = [f"w{int(r.expovariate(0.02))}" for _ in range(2000)], []
    while len(out) < n:
        base = [r.choice(words) for _ in range(r.choice([1, 2, 3, 8, 30]))]
        for _ in range(r.choice([1, 1, 2, 5])):
            text = [w if r.random() > 0.15 else r.choice(words) for w in base]
            r.shuffle(text)
            out.append(r.choice([" ", "  ", "\n"]).join(text))
    return out[:n]


def test_duplicate_check_shuffles_no_words(spark, tmp_path):
    texts = near_copies(1, 1200)
    for k in range(0, 1200, 100):
        texts[k] = texts[k + 1]
    texts[100], texts[200], texts[300], texts[400:450] = "", " ", None, [texts[400]] * 50
    assert len(same(spark, tmp_path, "duplicate_check", documents=documents(texts))) >= 8
    plan = registry.queries()["duplicate_check"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Join" not in plan


def test_most_similar_in_blocks(spark):
    texts = near_copies(2, 300)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, texts[0])], "id long, content string").repartition(5)
    queries = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "query_id long, query string")
    sets, want = [set(t.split()) for t in texts], {}
    for k, x in enumerate(sets):
        score, i = max(((round(len(x & y) / len(x | y), 9), -j) for j, y in enumerate(sets) if j != k))
        if score >= 0.4:
            want[k] = (-i, score)
    for block in (R.SET_BYTES, 2000):
        assert {r.query_id: (r.id, r.score) for r in R.most_similar(docs, queries, 0.4, block).collect()} == want
    assert R.most_similar(docs.limit(0), queries).count() == 0 and R.most_similar(docs, queries.limit(0)).count() == 0


def test_source_duplicates_stores_no_words(spark, tmp_path, monkeypatch):
    stored, plain = [], CL.settle
    monkeypatch.setattr(CL, "settle", lambda df: stored.extend(x.dataType.simpleString() for x in df.schema if x.name != "source" and x.name != "source_file") or plain(df))
    texts = near_copies(4, 600)
    texts[100], texts[200] = "", None
    for k in range(300, 330):  # thirty rows on is the same source
        texts[k] = " ".join(f"v{k * 7 % 11 + i}" for i in range(20))
        texts[k + 30], texts[k + 60] = texts[k] + " more", "more " + texts[k]
    assert {r[-1] for r in same(spark, tmp_path, "source_duplicates", documents=documents(texts))} == {"kept", "dropped", "short"}
    assert stored and not [x for x in stored if "string" in x]


def test_rooms_meet_at_their_words_once(spark, tmp_path):
    texts = near_copies(5, 400)
    texts[100], texts[200], texts[300] = "", None, "A a\nA"
    assert same(spark, tmp_path, "room_synonymy", documents=documents(texts))
    plan = registry.queries()["room_synonymy"](spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 3
