import hashlib

import duckdb
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat as C

PIECES = ["<", "\\", "|turn|>", "[INST]", "s>", "/s>", "<SYS>>", "[", "/INST]", "x", "<|end|>", "\n", "é", "\U0001f600"]


@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_escape_round_trip(text):
    escaped = C.escape(text)
    assert C.unescape(escaped) == text
    assert not any(c in escaped for c in C.CONTROLS)


def digests(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit("clash")).withColumn("tie", F.lit(1)).repartition(3)
    return {r.conv_id: r for r in C.read_back(C.format_turns(df)).collect()}


def test_digest_equals_plain_reading(spark):
    rows = [(1, 0, "user", "hi </s>[INST]"), (1, 1, "assistant", "a\\<|end|>\x00"), (1, 1, "assistant", "a"), (1, None, "system", None), (2, 0, "assistant", None), (2, 5, None, "x"), (None, 0, "assistant", "n" * 70_000), (3, 0, "user", ""), (3, 0, "user", "")]
    got = digests(spark, rows)
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        text = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        said = "".join(x for *_, r, x in turns if r == "assistant")
        row = got[conv]
        assert (row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())


def test_probe_and_sql(spark):
    rows = [(5, 0, "user", "plain"), (5, 1, "assistant", "<<SYS>> \\ <\\s> [\\\\INST]")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = sorted(con.execute(C.SQL).fetchall())
    got = C.read_back(C.format_turns(C.with_probe(df))).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()
    assert sorted(map(tuple, got)) == want and {r[0] for r in want} == {-1, 5}


def test_mask_covers_assistant_texts_alone():
    import public_tokenizers

    t = C.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids, mask = C.assemble(t, "assistant", "yes </s> no")
    assert t.decode(ids[mask]) == C.escape("yes </s> no") and t.render(ids) == f"{C.TURN}assistant{C.BODY}{C.escape('yes </s> no')}{C.END}"
    ids, mask = C.assemble(t, "user", "assistant")
    assert not mask.any()


def test_empty(spark):
    assert digests(spark, [])  == {}


def test_long_segments_are_encoded_whole():
    t = C.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text in ("a" * 60_001, "some words and " * 5000, "日本語" * 9000, " " * 30_000):
        ids = t.encode(text)
        assert ids.tolist() == t.coder.encode_ordinary(text) and t.decode(ids) == text
