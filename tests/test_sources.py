import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import chats, files, stores


def test_ignore_rules(spark):
    rules = ["# comment", "*.log", "!keep.log", "build/", "/top.txt", "docs/**/tmp*"]
    cases = {"a.log": True, "x/b.log": True, "x/keep.log": False, "build/a.py": True, "x/build/a.py": True, "top.txt": True, "x/top.txt": False, "docs/a/b/tmp1": True, "docs/tmp2": True, "src/a.py": False}
    df = spark.createDataFrame([(k,) for k in cases], "p string").select("p", files.ignored(F.col("p"), rules).alias("i"))
    assert {r.p: r.i for r in df.collect()} == cases


def test_scan(spark, tmp_path):
    for name, text in {"a.md": "x", "b.exe": "x", "node_modules/c.js": "x", "d/e.py": "print()", "d/f.log.txt": "x", "yarn.lock": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = files.scan_project(spark, str(tmp_path), ["*.log.txt"]).collect()
    assert sorted(r.relative for r in got) == ["a.md", "d/e.py"] and {r.content for r in got} == {"x", "print()"}


def test_chunks(spark):
    text = ("line of text é\n" * 60 + "\n") * 4
    pieces = files.chunk_text(text)
    assert all(50 <= len(p.encode()) <= 800 for p in pieces) and pieces[0].startswith("line") and files.chunk_text("short") == []
    rows = spark.createDataFrame([(1, text), (2, None), (3, "x" * 3000)], "id long, content string")
    got = files.chunks(rows).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in got} == {1: len(pieces), 3: len(files.chunk_text("x" * 3000))}
    assert files.chunks(rows, most=2).count() == 0


def test_split_sessions_and_diaries(spark):
    text = "Session started A\nhi\nSession started B\nyo\nSession started (context restored)\nmore"
    got = files.split_sessions(spark.createDataFrame([(1, text)], "id long, content string")).orderBy("session").collect()
    assert [r.text.split("\n")[0] for r in got] == ["Session started A", "Session started B"]
    rows = spark.createDataFrame([("/d/2024-01-02 x.md", "y" * 60), ("/d/2024-01-03.md", "short"), ("/d/note.md", "y" * 60), ("/d/2024-01-04.md", "z" * 60)], "path string, content string")
    seen = spark.createDataFrame([("/d/2024-01-04.md", "z" * 60)], "path string, c string").select("path", F.sha2("c", 256).alias("hash"))
    assert [r.date for r in files.diaries(rows, seen).collect()] == ["2024-01-02"]


CHATS = {
    "session": "\n".join(json.dumps(x) for x in [{"type": "user", "message": {"role": "user", "content": "hi"}}, {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "yes"}, {"type": "tool_use", "name": "Bash", "input": {"a": 1}}]}}, {"type": "meta"}, "junk"]),
    "event": "\n".join(json.dumps(x) for x in [{"type": "session_meta"}, {"type": "event_msg", "payload": {"type": "user_message", "message": "q"}}, {"type": "event_msg", "payload": {"type": "agent_message", "message": "a"}}, {"type": "event_msg", "payload": {"type": "token_count"}}]),
    "messages": json.dumps({"messages": [{"role": "human", "content": "q"}, {"role": "assistant", "content": "a"}]}),
    "channel": json.dumps([{"type": "message", "user": "U1", "text": "q"}, {"type": "message", "user": "U2", "text": "a"}, {"type": "join"}]),
    "tree": json.dumps({"mapping": {"r": {"parent": None, "children": ["u"]}, "u": {"parent": "r", "message": {"author": {"role": "user"}, "content": {"parts": ["q"]}}, "children": ["a"]}, "a": {"parent": "u", "message": {"author": {"role": "assistant"}, "content": {"parts": ["a"]}}, "children": []}}}),
    "cli": "\n".join(json.dumps(x) for x in [{"type": "session_metadata"}, {"type": "user", "content": "q"}, {"type": "model", "content": "a"}]),
    "quoted": "> q\na\nb\n\n> q2\nc",
    "segment": json.dumps({"role": "user", "segments": [{"type": "text", "content": "q"}], "toolCalls": [{"name": "Run"}]}),
    "plain": "nothing special",
}


def test_formats_and_parsers(spark):
    df = spark.createDataFrame(list(CHATS.items()), "path string, content string")
    kinds = {r.path: r.k for r in df.select("path", chats.detect(F.col("content")).alias("k")).collect()}
    assert kinds == {"session": "session_jsonl", "event": "event_jsonl", "messages": "messages_json", "channel": "channel_json", "tree": "tree_json", "cli": "cli_jsonl", "quoted": "quoted_md", "segment": "segment_jsonl", "plain": "text"}
    got = {}
    for r in chats.normalise(df).orderBy("path", "turn").collect():
        got.setdefault(r.path, []).append((r.role, r.text))
    pair = [("user", "q"), ("assistant", "a")]
    assert got["event"] == got["messages"] == got["channel"] == got["tree"] == got["cli"] == pair
    assert got["session"][0] == ("user", "hi") and got["session"][1][1].startswith("yes\n[Tool Bash]")
    assert got["quoted"] == [("user", "q"), ("assistant", "a\nb"), ("user", "q2"), ("assistant", "c")]
    assert got["plain"] == [("user", "nothing special")] and got["segment"] == [("user", "q\n[Tool Run]")]
    transcript = {r.path: r.transcript for r in chats.render(chats.normalise(df)).collect()}
    assert transcript["quoted"] == "> q\n\na\nb\n\n> q2\n\nc"
    units = chats.exchanges(df.where("path = 'quoted'")).orderBy("unit").collect()
    assert [r.text for r in units] == ["> q\na b", "> q2\nc"]


def test_files_that_only_look_like_trees(spark):
    """One odd file neither fails the job nor loses the others."""
    odd = {"a": '{"mapping": {"r": {}}} trailing', "b": '{"mapping": 5}', "c": '[{"mapping": {"r": 1}}]', "tree": CHATS["tree"]}
    got = {}
    for r in chats.normalise(spark.createDataFrame(list(odd.items()), "path string, content string")).collect():
        got.setdefault(r.path, []).append((r.role, r.text))
    assert got["tree"] == [("user", "q"), ("assistant", "a")] and all(got[k] == [("user", odd[k])] for k in "abc")
    plan = chats.normalise(spark.createDataFrame(list(odd.items()), "path string, content string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") == 1


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "f1", "w"), (2, "b", "f2", "w")], "id long, content string, source_file string, wing string")
    new = spark.createDataFrame([(2, "B", "f2", "w"), (3, "c", "f3", "v")], rows.schema)
    ids = lambda df: sorted((r.id, r.content) for r in df.collect())
    assert ids(stores.import_rows(rows, new, "1.0", "merge")) == [(1, "a"), (2, "B"), (3, "c")]
    assert ids(stores.import_rows(rows, new, "1.0", "skip")) == [(1, "a"), (2, "b"), (3, "c")]
    assert ids(stores.import_rows(rows, new, "2.0", "replace")) == [(2, "B"), (3, "c")]
    with pytest.raises(ValueError):
        stores.import_rows(rows, new, "9")
    assert ids(stores.delete_rows(rows, new)) == [(1, "a")]
    page = stores.json_page(rows, "id", 0, 1).collect()
    assert len(page) == 1 and page[0].has_more and json.loads(page[0].json)["id"] == 1
    stores.markdown_export(rows.withColumn("filed_at", F.lit(1)), str(tmp_path / "md"))
    stores.tree_export(rows.withColumn("room", F.lit("r")), str(tmp_path / "tree"))
    assert (tmp_path / "md" / "source_file=f1").exists() and (tmp_path / "tree" / "wing=w" / "room=r").exists()
    note = rows.select(stores.front_matter("id", "wing").alias("x")).first().x
    assert note == "---\nid: 1\nwing: w\n---\n\na"
    stores.save_snapshot(rows, str(tmp_path / "snap"), 1)
    assert stores.load_snapshot(spark, str(tmp_path / "snap"), 1).count() == 2
    manifest = spark.createDataFrame([(1, 0, 1), (2, 0, 2)], "generation int, shard int, n_shards int")
    assert [r.generation for r in stores.latest_generation(manifest).collect()] == [1]
    vectors = spark.createDataFrame([([1.0, 2.0],)], "embedding array<double>")
    assert stores.checked_vectors(vectors, 2).count() == 1
    with pytest.raises(Exception, match="manifest has 3"):
        stores.checked_vectors(vectors, 3).collect()
    assert stores.corrupt_ids(spark.createDataFrame([("",), ("x",), (None,)], "id string")).count() == 2


def test_incremental(spark):
    found = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "source_file string, mtime double")
    held = spark.createDataFrame([("a", 1.0, 2, None), ("b", 9.0, 2, "general"), ("c", 3.0, 1, None)], "source_file string, mtime double, normalize_version int, extract_mode string")
    assert sorted(r.source_file for r in stores.already_mined(found, held).collect()) == ["b", "c"]
    assert sorted(r.source_file for r in stores.already_mined(found, held, "exchange", check_mtime=False).collect()) == ["b", "c"]
    msgs = spark.createDataFrame([("s", "u1", 1), ("s", "u2", 5), ("s", "u2", 5), ("t", "u1", 1)], "session_id string, uuid string, ts int")
    cursor = spark.createDataFrame([("s", 5)], "session_id string, cursor int")
    assert sorted(r.id for r in stores.sweep(msgs, cursor).collect()) == ["sweep_s_u2", "sweep_t_u1"]
