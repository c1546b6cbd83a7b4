"""Chat ingestion over the supplied conversations: each is written in one of the known formats and read back by its parser."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans import base as B
from tessera.plans.registry import query
from tessera.sources import chats, files


def _turns(spark, d) -> DataFrame:
    """(path, id, turns): the turns of each conversation in order; a conversation is one file."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.col("role"), "text")))
    return B.table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("turns")).select(F.concat(F.lit("c"), "conv_id").alias("path"), F.col("conv_id").alias("id"), "turns")


def _lines(row, *before: str):
    return F.array_join(F.concat(F.array(*map(F.lit, before)).cast("array<string>"), F.transform("turns", lambda t: F.to_json(row(t)))), "\n")


def _said(t):
    return F.regexp_replace(t["text"], "\n", " ")


_session = lambda: _lines(lambda t: F.struct(t["role"].alias("type"), F.struct(t["role"].alias("role"), t["text"].alias("content")).alias("message")))
_event = lambda: _lines(
    lambda t: F.struct(F.lit("event_msg").alias("type"), F.struct(F.when(t["role"] == "user", "user_message").when(t["role"] == "assistant", "agent_message").otherwise("token_count").alias("type"), t["text"].alias("message")).alias("payload")),
    '{"type": "session_meta"}',
)
_cli = lambda: _lines(lambda t: F.struct(F.when(t["role"] == "assistant", "model").when(t["role"] == "user", "user").otherwise("info").alias("type"), t["text"].alias("content")), '{"type": "session_metadata"}')
_segment = lambda: _lines(lambda t: F.struct(t["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), t["text"].alias("content"))).alias("segments"), F.when(t["role"] == "assistant", F.array(F.struct(F.lit("Run").alias("name")))).alias("toolCalls")))
_messages = lambda: F.to_json(F.struct(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages")))
_channel = lambda: F.to_json(F.transform("turns", lambda t: F.struct(F.lit("message").alias("type"), t["role"].alias("user"), t["text"].alias("text"))))
_name = lambda k: F.concat(F.lit("n"), k.cast("string"))
_tree = lambda: F.to_json(F.struct(F.map_from_entries(F.transform("turns", lambda t, k: F.struct(
    _name(k).alias("key"),
    F.struct(F.when(k > 0, _name(k - 1)).alias("parent"), F.struct(F.struct(t["role"].alias("role")).alias("author"), F.struct(F.array(t["text"]).alias("parts")).alias("content")).alias("message"), F.when(k + 1 < F.size("turns"), F.array(_name(k + 1))).alias("children")).alias("value"),
))).alias("mapping")))
_quoted = lambda: F.array_join(F.transform("turns", lambda t: F.concat(F.when(t["role"] == "user", "> ").otherwise(""), _said(t))), "\n")
  # noqa: E731

def _parsed(spark, d, content, format_: str) -> DataFrame:
    return chats.parsed(_turns(spark, d).select("path", content.alias("content")), format_)


_FROM = "SELECT 'c' || conv_id AS path, {turn}::INT AS turn, {role} AS role, {text} AS text FROM conversations WHERE {which} AND text <> ''"


@query("chat_session_jsonl", _FROM.format(turn="turn", role="role", text="text", which="role IN ('user', 'assistant')"))
def chat_session_jsonl(spark, d):
    return _parsed(spark, d, _session(), "session_jsonl")


@query("chat_event_jsonl", _FROM.format(turn="turn + 1", role="role", text="text", which="role IN ('user', 'assistant')"))
def chat_event_jsonl(spark, d):
    return _parsed(spark, d, _event(), "event_jsonl")


@query("chat_cli_jsonl", _FROM.format(turn="turn + 1", role="role", text="text", which="role IN ('user', 'assistant')"))
def chat_cli_jsonl(spark, d):
    return _parsed(spark, d, _cli(), "cli_jsonl")


@query("chat_segment_jsonl", _FROM.format(turn="turn", role="role", text="text || CASE WHEN role = 'assistant' THEN chr(10) || '[Tool Run]' ELSE '' END", which="true"))
def chat_segment_jsonl(spark, d):
    return _parsed(spark, d, _segment(), "segment_jsonl")


@query("chat_messages_json", _FROM.format(turn="turn", role="CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END", text="text", which="true"))
def chat_messages_json(spark, d):
    return _parsed(spark, d, _messages(), "messages_json")


@query("chat_channel_json", _FROM.format(turn="turn", role="CASE WHEN role = first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 'user' ELSE 'assistant' END", text="text", which="true"))
def chat_channel_json(spark, d):
    return _parsed(spark, d, _channel(), "channel_json")


@query("chat_tree_json", _FROM.format(turn="row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1", role="role", text=r"regexp_replace(text, '^\s+|\s+$', '', 'g')", which="role IN ('user', 'assistant')"))
def chat_tree_json(spark, d):
    return _parsed(spark, d, _tree(), "tree_json")


_RUNS = r"""WITH c AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS role, replace(text, chr(10), ' ') AS said FROM conversations WHERE trim(text) <> ''),
n AS (SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS new FROM c),
g AS (SELECT *, sum(new::INT) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS unit FROM n),
r AS (SELECT 'c' || conv_id AS path, unit::INT AS turn, any_value(role) AS role, string_agg(said, chr(10) ORDER BY turn) AS text FROM g GROUP BY conv_id, unit)"""


@query("chat_quoted_markdown", _RUNS + " SELECT path, turn, role, text FROM r")
def chat_quoted_markdown(spark, d):
    return _parsed(spark, d, _quoted(), "quoted_md")


@query("exchange_units", _RUNS + """ SELECT q.path, q.turn AS unit, substr('> ' || q.text || coalesce(chr(10) || array_to_string(list_slice(string_split(a.text, chr(10)), 1, 8), ' '), ''), 1, 800) AS text
FROM r q LEFT JOIN r a ON a.path = q.path AND a.turn = q.turn + 1 WHERE q.role = 'user'""")
def exchange_units(spark, d):
    return chats.exchanges(_turns(spark, d).select("path", _quoted().alias("content")))


#: The format that a conversation is written in, by its number; those that begin with the system's turn cannot be told as sessions.
_KINDS = {0: ("event_jsonl", _event), 1: ("segment_jsonl", _segment), 2: ("cli_jsonl", _cli), 3: ("messages_json", _messages), 4: ("channel_json", _channel), 5: ("tree_json", _tree), 6: ("text", lambda: F.element_at("turns", -1)["text"])}


def _mixed(spark, d) -> DataFrame:
    content = F
    for k, (_, one) in _KINDS.items():
        content = content.when(F.col("id") % len(_KINDS) == k, one())
    return _turns(spark, d).select("path", content.alias("content"))


@query("chat_formats", "SELECT DISTINCT 'c' || conv_id AS path, CASE conv_id % 7 " + " ".join(f"WHEN {k} THEN '{name}'" for k, (name, _) in _KINDS.items()) + " END AS format FROM conversations")
def chat_formats(spark, d):
    return _mixed(spark, d).select("path", chats.detect(F.col("content")).alias("format"))


@query("chat_normalise", r"""WITH c AS (SELECT *, conv_id % 7 AS kind, first_value(role) OVER w AS first_role, last_value(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT * FROM c WHERE (kind IN (0, 2, 5) AND role IN ('user', 'assistant')) OR kind IN (1, 3, 4) OR (kind = 6 AND turn = last_turn))
SELECT 'c' || conv_id AS path, CASE WHEN kind = 6 THEN 'user' WHEN kind = 3 AND role <> 'user' THEN 'assistant' WHEN kind = 4 THEN CASE WHEN role = first_role THEN 'user' ELSE 'assistant' END ELSE role END AS role,
  CASE WHEN kind = 5 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') WHEN kind = 1 AND role = 'assistant' THEN text || chr(10) || '[Tool Run]' ELSE text END AS text FROM k""")
def chat_normalise(spark, d):
    """Files of seven formats, read at once."""
    return chats.normalise(_mixed(spark, d)).select("path", "role", "text")


@query("tool_rendering", "SELECT conv_id AS id, turn, text || chr(10) || '[Tool Bash] {\"turn\":' || turn || '}' || chr(10) || '[Result] ' || substr(text, 1, 500) || chr(10) || '[image]' AS text FROM conversations")
def tool_rendering(spark, d):
    c = B.table(spark, d, "conversations")
    none = F.lit(None).cast("string")
    blocks = F.array(
        F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), none.alias("name"), F.lit(None).cast("struct<turn long>").alias("input"), none.alias("content")),
        F.struct(F.lit("tool_use").alias("type"), none.alias("text"), F.lit("Bash").alias("name"), F.struct("turn").alias("input"), none.alias("content")),
        F.struct(F.lit("tool_result").alias("type"), none.alias("text"), none.alias("name"), F.lit(None).cast("struct<turn long>").alias("input"), F.col("text").alias("content")),
        F.struct(F.lit("image").alias("type"), none.alias("text"), none.alias("name"), F.lit(None).cast("struct<turn long>").alias("input"), none.alias("content")),
    )
    return c.select(F.col("conv_id").alias("id"), "turn", F.to_json(blocks).alias("content")).select("id", "turn", chats.flatten_content(F.col("content")).alias("text"))


@query("split_sessions", """WITH c AS (SELECT conv_id, conv_id // 10 AS id, 'Session started c' || conv_id || chr(10) || string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY conv_id) - 1)::INT AS session, text FROM c""")
def split_sessions(spark, d):
    """Ten conversations in a file, cut apart again."""
    one = _turns(spark, d).select("id", F.concat_ws("\n", F.concat(F.lit("Session started "), "path"), F.array_join(F.transform("turns", lambda t: t["text"]), "\n")).alias("text"))
    many = one.groupBy(F.expr("id div 10").alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "\n").alias("content"))
    return files.split_sessions(many.select(F.col("file").alias("id"), "content"))


@query("diary_days", """SELECT '/d/2024-01-' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') || ' ' || doc_id || '.md' AS path, '2024-01-' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') AS date, sha256(text) AS hash
FROM documents WHERE strlen(text) >= 50 AND NOT (doc_id % 3 = 0 AND doc_id % 2 = 0)""")
def diary_days(spark, d):
    """Diaries of which every third was seen before, and half of those with another text."""
    f = B.table(spark, d, "documents").select("doc_id", F.concat(F.lit("/d/2024-01-"), F.lpad((1 + F.col("doc_id") % 28).cast("string"), 2, "0"), F.lit(" "), "doc_id", F.lit(".md")).alias("path"), F.col("text").alias("content"))
    seen = f.where("doc_id % 3 = 0").select("path", F.sha2(F.when(F.col("doc_id") % 2 == 0, F.col("content")).otherwise(F.concat("content", F.lit("x"))), 256).alias("hash"))
    return files.diaries(f, seen).select("path", "date", "hash")
