"""Chat transcripts: format detection and parsers that turn a file's text into (turn, role, text) rows.

JSON is parsed in the JVM (from_json with fixed schemas); each parser is a column of turns, so that files of all formats are read
once. Only the walk of a tree needs Python.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("event_jsonl", "segment_jsonl", "cli_jsonl", "session_jsonl", "tree_json", "channel_json", "messages_json", "quoted_md", "text")


def detect(content: Column) -> Column:
    """The format of a chat file by the keys of its first line or document; quoted markdown and plain text last."""
    first = F.regexp_extract(F.ltrim(content), r"^([^\n]*)", 1)
    has = lambda k: F.get_json_object(first, f"$.{k}").isNotNull()
    whole = lambda p: F.get_json_object(content, p).isNotNull()
    quotes = F.regexp_count(content, F.lit(r"(?m)^>"))
    return (
        F.when(F.get_json_object(first, "$.type") == "session_meta", "event_jsonl")
        .when(has("segments") | has("toolCalls"), "segment_jsonl")
        .when(F.get_json_object(first, "$.type") == "session_metadata", "cli_jsonl")
        .when(has("message") & F.get_json_object(first, "$.type").isin("user", "assistant"), "session_jsonl")
        .when(whole("$.mapping") | whole("$[0].mapping"), "tree_json")
        .when(F.get_json_object(content, "$[0].type") == "message", "channel_json")
        .when(whole("$.messages") | whole("$.chat_messages") | whole("$[0].role"), "messages_json")
        .when(quotes >= 2, "quoted_md")
        .otherwise("text")
    )


def flatten_content(c: Column) -> Column:
    """A message's content: a string, or blocks rendered one a line (text, tool use, tool result, others by type)."""
    blocks = F.from_json(c, "array<struct<type string, text string, name string, input string, content string>>")
    line = lambda b: (
        F.when(b["type"] == "text", b["text"]).when(b["type"] == "tool_use", F.concat(F.lit("[Tool "), F.coalesce(b["name"], F.lit("?")), F.lit("] "), F.substring(F.coalesce(b["input"], F.lit("")), 1, 200))).when(b["type"] == "tool_result", F.concat(F.lit("[Result] "), F.substring(F.coalesce(b["content"], F.lit("")), 1, 500))).otherwise(F.concat(F.lit("["), F.coalesce(b["type"], F.lit("unknown")), F.lit("]")))
    )
    return F.when(F.ltrim(c).startswith("["), F.array_join(F.transform(blocks, line), "\n")).otherwise(c)


TURNS = "array<struct<turn int, role string, text string>>"


def _turn(turn: Column, role: Column, text: Column) -> Column:
    return F.struct(turn.cast("int").alias("turn"), role.alias("role"), text.alias("text"))


def _said(turns: Column) -> Column:
    return F.filter(turns, lambda t: F.coalesce(t["text"], F.lit("")) != "")


def json_lines(content: Column, schema: str) -> Column:
    """The lines that are JSON, as (line, row)."""
    lines = F.transform(F.split(content, "\n"), lambda x, k: F.struct(k.alias("line"), F.from_json(x, schema).alias("row")))
    return F.filter(lines, lambda x: x["row"].isNotNull())


def _session(content: Column) -> Column:
    rows = F.filter(json_lines(content, "type string, message struct<role string, content string>"), lambda x: x["row"]["type"].isin("user", "assistant"))
    return _said(F.transform(rows, lambda x: _turn(x["line"], F.coalesce(x["row"]["message"]["role"], x["row"]["type"]), flatten_content(x["row"]["message"]["content"]))))


def _event(content: Column) -> Column:
    rows = json_lines(content, "type string, payload struct<type string, message string>")
    said = F.filter(rows, lambda x: (x["row"]["type"] == "event_msg") & x["row"]["payload"]["type"].isin("user_message", "agent_message"))
    turns = F.transform(said, lambda x: _turn(x["line"], F.when(x["row"]["payload"]["type"] == "user_message", "user").otherwise("assistant"), x["row"]["payload"]["message"]))
    return F.when(F.exists(rows, lambda x: F.coalesce(x["row"]["type"] == "session_meta", F.lit(False))), turns)


def _cli(content: Column) -> Column:
    rows = F.filter(json_lines(content, "type string, content string, text string"), lambda x: x["row"]["type"].isin("user", "model", "gemini", "assistant"))
    return F.transform(rows, lambda x: _turn(x["line"], F.when(x["row"]["type"] == "user", "user").otherwise("assistant"), F.coalesce(x["row"]["text"], flatten_content(x["row"]["content"]))))


def _segment(content: Column) -> Column:
    none = F.expr("array()").cast("array<string>")
    said = lambda r: F.array_join(F.coalesce(F.transform(F.filter(r["segments"], lambda g: g["type"] == "text"), lambda g: g["content"]), none), "\n")
    tools = lambda r: F.array_join(F.coalesce(F.transform(r["toolCalls"], lambda t: F.concat(F.lit("[Tool "), t["name"], F.lit("]"))), none), "\n")
    rows = json_lines(content, "role string, segments array<struct<type string, content string>>, toolCalls array<struct<name string>>")
    return _said(F.transform(rows, lambda x: _turn(x["line"], x["row"]["role"], F.concat_ws("\n", F.nullif(said(x["row"]), F.lit("")), F.nullif(tools(x["row"]), F.lit(""))))))


def _messages(content: Column) -> Column:
    one = "array<struct<role string, sender string, content string, text string>>"
    found = F.coalesce(F.from_json(F.get_json_object(content, "$.messages"), one), F.from_json(F.get_json_object(content, "$.chat_messages"), one), F.from_json(content, one))
    role = lambda m: F.when(F.lower(F.coalesce(m["role"], m["sender"])).isin("user", "human"), "user").otherwise("assistant")
    return _said(F.transform(found, lambda m, k: _turn(k, role(m), F.coalesce(m["text"], flatten_content(m["content"])))))


def _channel(content: Column) -> Column:
    found = F.filter(F.from_json(content, "array<struct<type string, user string, username string, text string>>"), lambda x: (x["type"] == "message") & (F.coalesce(x["text"], F.lit("")) != ""))
    name = lambda x: F.coalesce(x["user"], x["username"], F.lit(""))
    return F.transform(found, lambda m, k: _turn(k, F.when(name(m) == name(F.get(found, F.lit(0))), "user").otherwise("assistant"), m["text"]))


def walk_tree(content: str | None) -> list[tuple[int, str, str]] | None:
    """The turns of a tree of messages, from the root along each node's first child that has not been read; None if it is no such tree."""
    try:
        document = json.loads(content or "")
        nodes = (document[0] if isinstance(document, list) else document)["mapping"]
        at = next((k for k, n in nodes.items() if not n.get("parent")), None)
        seen, out = set(), []
        while at is not None and at not in seen:
            seen.add(at)
            message = nodes[at].get("message") or {}
            role = (message.get("author") or {}).get("role")
            text = "\n".join(p for p in (message.get("content") or {}).get("parts") or [] if isinstance(p, str)).strip()
            if role in ("user", "assistant") and text:
                out.append((len(out), role, text))
            at = next((c for c in nodes[at].get("children") or [] if c in nodes and c not in seen), None)
        return out
    except (ValueError, TypeError, KeyError, IndexError, AttributeError):
        return None


def _tree(content: Column) -> Column:
    @F.pandas_udf(TURNS)
    def run(contents: pd.Series) -> pd.Series:
        walked = [walk_tree(c) if c is not None else None for c in contents]
        return pd.Series([w if w is None else [{"turn": n, "role": r, "text": t} for n, r, t in w] for w in walked], dtype=object)

    return run(content)


def _quoted(content: Column) -> Column:
    """Lines that begin with ``> `` are the user's; other lines gather into the answer after them."""
    lines = F.filter(F.split(content, "\n"), lambda x: F.trim(x) != "")
    asks = lambda k: F.get(lines, k).startswith("> ")
    every = F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.size(lines) - 1)).otherwise(F.expr("array()").cast("array<int>"))
    starts = F.filter(every, lambda k: (k == 0) | (asks(k) != asks(k - 1)))
    until = lambda n: F.coalesce(F.get(starts, n + 1), F.size(lines))
    text = lambda k, n: F.array_join(F.transform(F.slice(lines, k + 1, until(n) - k), lambda x: F.regexp_replace(x, "^> ", "")), "\n")
    return F.transform(starts, lambda k, n: _turn(n, F.when(asks(k), "user").otherwise("assistant"), text(k, n)))


_PARSERS = {"event_jsonl": _event, "segment_jsonl": _segment, "cli_jsonl": _cli, "session_jsonl": _session, "tree_json": _tree, "channel_json": _channel, "messages_json": _messages, "quoted_md": _quoted}


def parsed(files: DataFrame, format_: str) -> DataFrame:
    """(path, turn, role, text) of files of one format.

    session_jsonl: user and assistant lines. event_jsonl: only user and agent messages, of files with a session header.
    messages_json: one document with messages or chat_messages, or an array of messages. channel_json: the speaker who comes
    first is the user, all others answer. tree_json: see ``walk_tree``; a document that is no tree has no turns.
    """
    return files.select("path", F.explode(_PARSERS[format_](F.col("content"))).alias("t")).select("path", "t.turn", "t.role", "t.text")


def session_jsonl(files: DataFrame) -> DataFrame:
    return parsed(files, "session_jsonl")


def event_jsonl(files: DataFrame) -> DataFrame:
    return parsed(files, "event_jsonl")


def cli_jsonl(files: DataFrame) -> DataFrame:
    return parsed(files, "cli_jsonl")


def segment_jsonl(files: DataFrame) -> DataFrame:
    return parsed(files, "segment_jsonl")


def messages_json(files: DataFrame) -> DataFrame:
    return parsed(files, "messages_json")


def channel_json(files: DataFrame) -> DataFrame:
    return parsed(files, "channel_json")


def tree_json(files: DataFrame) -> DataFrame:
    return parsed(files, "tree_json")


def quoted_markdown(files: DataFrame) -> DataFrame:
    return parsed(files, "quoted_md")


def normalise(files: DataFrame) -> DataFrame:
    """(path, turn, role, text) of all files, each by its own format, in one reading; plain text, and a tree that cannot be read, is one user turn."""
    kinds = files.select("path", "content", detect(F.col("content")).alias("format"))
    kinds = kinds.withColumn("tree", _tree(F.when(F.col("format") == "tree_json", F.col("content"))))
    plain = F.array(_turn(F.lit(0), F.lit("user"), F.col("content")))
    turns = F
    for name, parse in _PARSERS.items():
        turns = turns.when(F.col("format") == name, F.coalesce("tree", plain) if name == "tree_json" else parse(F.col("content")).cast(TURNS))
    return kinds.select("path", F.explode(turns.otherwise(plain)).alias("t")).select("path", "t.turn", "t.role", "t.text")


SPEAKERS = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant"}


def database_turns(content: bytes) -> list[tuple[str, int, str, str]]:
    """(session, turn, role, text) of a SQLite file with sessions and messages, sessions in order of their time; none if it is no such file."""
    import sqlite3

    try:
        with contextlib.closing(sqlite3.connect(":memory:")) as db:
            db.deserialize(content)
            rows = db.execute("SELECT s.id, m.role, m.content FROM sessions s JOIN messages m ON m.session_id = s.id ORDER BY s.created_at, s.id, m.id").fetchall()
    except sqlite3.Error:
        return []
    out, turn = [], {}
    for session, role, text in rows:
        speaker = SPEAKERS.get(role)
        if speaker and isinstance(text, str) and text.strip():
            turn[session] = turn.get(session, -1) + 1
            out.append((str(session), turn[session], speaker, text.strip()))
    return out


def session_databases(files: DataFrame) -> DataFrame:
    """(path, session, turn, role, text) of SQLite session files; ``files`` is (path, content: binary). A file is read as a whole where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, *t) for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True) for t in database_turns(content or b"")]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "session", "turn", "role", "text"])

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "path string, session string, turn int, role string, text string")


def render(turns: DataFrame, by: str = "path") -> DataFrame:
    """(by, transcript): user turns quoted, each followed by its answer, blank lines between. A transcript is one file's text."""
    line = F.when(F.col("role") == "user", F.concat(F.lit("> "), F.regexp_replace("text", "\n", "\n> "))).otherwise(F.col("text"))
    g = turns.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("t"))
    return g.select(by, F.array_join(F.transform("t", lambda x: x["line"]), "\n\n").alias("transcript"))


def exchanges(files: DataFrame, most_lines: int = 8, size: int = 800) -> DataFrame:
    """(path, unit, text): a quoted line and up to ``most_lines`` non-empty lines after it, cut at ``size`` characters."""
    turns = quoted_markdown(files)
    asked = turns.where("role = 'user'").select("path", F.col("turn").alias("unit"), F.col("text").alias("q"))
    answered = turns.where("role = 'assistant'").select("path", (F.col("turn") - 1).alias("unit"), F.array_join(F.slice(F.split("text", "\n"), 1, most_lines), " ").alias("a"))
    return asked.join(answered, ["path", "unit"], "left").select("path", "unit", F.substring(F.concat_ws("\n", F.concat(F.lit("> "), "q"), "a"), 1, size).alias("text"))
