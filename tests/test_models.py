"""Model steps with functions in place of models, manifests and session databases."""

import sqlite3

import pandas as pd

from tessera.operators import models as M
from tessera.sources import chats, files


def test_query_variants(spark):
    q = spark.createDataFrame([(1, "where is it"), (2, "plain")], "query_id long, query string")
    model = lambda prompts: pd.Series([f"<query>{p} now</query> <query> {p} </query><query></query><query>{p} then</query>" if "where" in p else "nothing" for p in prompts])
    assert sorted(map(tuple, M.expand_with(q, model).collect())) == [(1, 0, "where is it"), (1, 1, "where is it now"), (1, 2, "where is it then"), (2, 0, "plain")]
    assert sorted(r.variant for r in M.expand_with(q).collect()) == [0, 0]


def test_graph_and_compression(spark):
    o = spark.createDataFrame([(1, "Ann", "met Bob"), (2, "t", "x"), (3, None, None)], "id long, title string, narrative string")
    model = lambda prompts: pd.Series(["<edge>Ann Lee | Knows | Bob</edge><edge>a||b</edge><title>T</title><narrative>N</narrative>" if "Ann" in p else "<edge>ann lee|knows|bob</edge>" for p in prompts])
    (edge,) = M.extract_graph(o, model).collect()
    assert (edge.subject, edge.predicate, edge.object, edge.times, edge.first_id) == ("ann_lee", "knows", "bob", 3, 1)
    assert M.extract_graph(o).count() == 0
    assert sorted((r.id, r.title, r.narrative, r.compressed) for r in M.compress_observations(o, model).collect()) == [(1, "T", "N", True), (2, "t", "x", False), (3, None, None, False)]


def test_consolidation(spark):
    s = spark.createDataFrame([("p", k, f"s{k}") for k in range(7)] + [("q", k, "t") for k in range(4)], "project string, ts int, text string")
    f = spark.createDataFrame([("p", "a", 2), ("p", "b", 1), ("q", "c", 3), ("q", "d", 2)], "project string, pattern string, frequency int")
    model = lambda prompts: pd.Series([f"<memory>{p.split(chr(10))[0]} of {p.count(chr(10)) + 1}</memory>" for p in prompts])
    got = sorted(map(tuple, M.consolidate(s, f, model, prompt_items=6).collect()))
    assert got == [("p", "semantic", "s6 of 6"), ("q", "procedural", "c of 2")]


def test_projects(spark):
    rows = [("/a/package.json", '{"name": "web"}'), ("/a/go.mod", "module example.com/x/tool\n"), ("/b/Cargo.toml", '[workspace]\nname = "no"\n[package]\nversion = "1"\nname = "core"\n'), ("/c/pyproject.toml", "[project]\nname = 'lib'"), ("/d/readme.md", "name = x"), ("/e/package.json", "{}")]
    got = {r.folder: (r.project, r.manifest) for r in files.projects(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got == {"/a": ("web", "package.json"), "/b": ("core", "Cargo.toml"), "/c": ("lib", "pyproject.toml")}


def test_session_databases(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "s.db")
    db.executescript("CREATE TABLE sessions (id INTEGER, dir TEXT, created_at TEXT, updated_at TEXT); CREATE TABLE messages (id INTEGER, session_id INTEGER, role TEXT, content TEXT); INSERT INTO sessions VALUES (2, '/x', '2024-01-01', ''), (1, '/y', '2024-01-02', ''); INSERT INTO messages VALUES (1, 1, 'human', ' q '), (2, 1, 'ai', 'a'), (3, 1, 'tool', 'z'), (4, 2, 'user', ''), (5, 2, 'bot', 'b')")
    db.commit()
    db.close()
    (tmp_path / "no.db").write_bytes(b"not a database")
    found = chats.session_databases(spark.read.format("binaryFile").load(str(tmp_path / "*.db"))).collect()
    assert sorted((r.session, r.turn, r.role, r.text) for r in found) == [("1", 0, "user", "q"), ("1", 1, "assistant", "a"), ("2", 0, "assistant", "b")]
