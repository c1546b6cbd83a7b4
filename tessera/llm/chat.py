"""Chat formatting by assembling tokens.

Every segment (a turn's role, a turn's text) is encoded on its own; reserved ids are spliced in between, so no text can make
one. Positions and the loss mask come from prefix sums over the segments' lengths. Control strings that occur in a text are
escaped with one backslash after their first character (one more if there are some), which is undone in reading.

A conversation's turns are encoded where they lie, in parallel, then sorted within a hash partition and assembled as a
stream: what is held is one batch of rows, however long a conversation is.

Defined results: rows are ordered by turn, then role, then text; a null text or role is empty; repeated rows are turns of
their own; a null conv_id is a conversation; a very long
text is one segment; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template: <|turn|> role <|body|> text <|end|>, and the strings of other templates that are kept out of texts as well.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
CONTROLS = (TURN, BODY, END, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_rests = {first: "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True) if c[0] == first) for first in {c[0] for c in CONTROLS}}
_escape = re.compile("|".join(rf"(?P<h{i}>{re.escape(f)})(?P<b{i}>\\*)(?P<r{i}>{rest})" for i, (f, rest) in enumerate(sorted(_rests.items()))))


def escape(text: str) -> str:
    return _escape.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _escape.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


class ChatTokenizer:
    """A byte-level vocabulary with three reserved ids after its last one."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.coder = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        first = max(ranks.values()) + 1
        self.reserved = {TURN: first, BODY: first + 1, END: first + 2}
        self.names = {v: k for k, v in self.reserved.items()}
        self.first = first

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole segment, however long: it is cut nowhere but where the tokenizer's own pattern cuts."""
        return np.array(self.coder.encode_ordinary(text), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return self.coder.decode_bytes(ids.tolist()).decode("utf-8", "surrogatepass")

    def render(self, ids: np.ndarray) -> str:
        """The formatted string: reserved ids as their control strings, all else decoded."""
        at = np.flatnonzero(ids >= self.first)
        out, last = [], 0
        for k in at:
            out += [self.decode(ids[last:k]), self.names[int(ids[k])]]
            last = k + 1
        return "".join([*out, self.decode(ids[last:])])


_tokenizers: dict[str, ChatTokenizer] = {}


def tokenizer(path: str) -> ChatTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ChatTokenizer(path)
    return _tokenizers[path]


def assemble(t: ChatTokenizer, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a turn and their loss mask."""
    segments = [(np.array([t.reserved[TURN]], np.int32), 0), (t.encode(escape(role)), 0), (np.array([t.reserved[BODY]], np.int32), 0), (t.encode(escape(text)), int(role == "assistant")), (np.array([t.reserved[END]], np.int32), 0)]
    ends = np.cumsum([len(ids) for ids, _ in segments])
    steps = np.zeros(ends[-1] + 1, np.int8)
    for (ids, loss), end in zip(segments, ends, strict=True):
        if loss:
            np.add.at(steps, [end - len(ids), end], [1, -1])
    return np.concatenate([ids for ids, _ in segments]), np.cumsum(steps[:-1]).astype(bool)


def format_turns(conversations: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text_key, ids, loss): the formatted tokens of each turn, and its place in the order of ties.

    ``loss`` is the mask as runs: first masked token and their number.
    """
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            ids, loss = [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own, mask = assemble(t, role, text)
                at = np.flatnonzero(mask)
                ids.append(own.astype("<i4").tobytes())
                loss.append([int(at[0]), len(at)] if len(at) else [0, 0])
            flat = pa.array(np.array(loss, np.int32).reshape(-1, 2)[:, 0]), pa.array(np.array(loss, np.int32).reshape(-1, 2)[:, 1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(ids, pa.binary()), *flat], ["conv_id", "turn", "role", "tie", "ids", "loss_from", "loss_tokens"])

    return rows.mapInArrow(run, "conv_id long, turn long, role string, tie string, ids binary, loss_from int, loss_tokens int")


class _Digest:
    """A conversation as it is read back from its tokens, turn by turn."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.all, self.loss = conv_id, 0, hashlib.sha256(), hashlib.sha256()
        self.loss_chars = self.formatted_chars = self.tokens = self.loss_tokens = 0

    def add(self, t: ChatTokenizer, ids: np.ndarray, loss_from: int, loss_tokens: int) -> None:
        rendered = t.render(ids)
        role, text = rendered[len(TURN) : -len(END)].split(BODY, 1)
        self.all.update(f"{unescape(role)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))
        said = unescape(t.decode(ids[loss_from : loss_from + loss_tokens]))
        self.loss.update(said.encode("utf-8", "surrogatepass"))
        self.loss_chars += len(said)
        self.formatted_chars += len(rendered)
        self.turns, self.tokens, self.loss_tokens = self.turns + 1, self.tokens + len(ids), self.loss_tokens + loss_tokens

    def row(self):
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars, self.tokens, self.loss_tokens)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


def read_back(turns: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """One row for each conversation, taken from the tokens that ``format_turns`` made."""
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie").select("conv_id", "ids", "loss_from", "loss_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, open_one, done = tokenizer(path), None, []

        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], [x.split(" ")[0] for x in DIGEST.split(", ")])

        for batch in batches:
            done = []
            for conv_id, ids, loss_from, loss_tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_one is None or open_one.conv_id != conv_id:
                    if open_one is not None:
                        done.append(open_one.row())
                    open_one = _Digest(conv_id)
                open_one.add(t, np.frombuffer(ids, "<i4"), loss_from, loss_tokens)
            if done:
                yield out()
        if open_one is not None:
            done = [open_one.row()]
            yield out()

    return ordered.mapInArrow(run, DIGEST)


def with_probe(conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -1, whose texts are made of control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).union(probe)


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(role) + length(regexp_replace(text,
    '(<)(\\*)(\|endoftext\|>|\|im_start\|>|\|im_end\|>|\|turn\|>|\|body\|>|\|end\|>|</SYS>>|<SYS>>|/s>|s>)|(\[)(\\*)(/INST\]|INST\])', '\1\4\\\2\5\3\6', 'g')) + 23 AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
