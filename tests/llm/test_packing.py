import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER, ENCODER = Tokenizer.from_file(PATH), P.WordEncoder(PATH)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=10))
@settings(max_examples=150, deadline=None)
def test_plan_is_best_fit_decreasing(histogram):
    capacity, places, ranks = 40, {}, {}
    for length, a, b, first, each, offset in P.plan(histogram, capacity):
        for r in range(a, b):
            ranks.setdefault(length, []).append(r)
            places.setdefault(first + (r - a) // each, []).append((offset + (r - a) % each * length, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    bins = []
    for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        fits = [(left, i) for i, left in enumerate(bins) if left >= length]
        if fits:
            bins[min(fits)[1]] -= length
        else:
            bins.append(capacity - length)
    assert len(places) == len(bins)


PIECES = ["a", "B", "é", "É", "ß", "İ", "Σ", "'s", "'", "don't", ".", ",", "..", "!", "#", "12", "3a", "_", " ", "\n", "\t", "<|", "endoftext", "|>", "|", "日", "́", "ﬁ", "½", "x,y", "|a|", "$5", "…", "\x1c", "\xa0", "\x85"]


@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
@settings(max_examples=600, deadline=None)
def test_words_encode_as_the_whole_text(text):
    assert ENCODER.encode([text])[0].tolist() == [*TOKENIZER.encode(text, add_special_tokens=False).ids, 1]


def test_pack_rows(docs_of, awkward):
    r = random.Random(3)
    rows = awkward + [(50 + k, " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randint(0, 400)))) for k in range(60)] + [(200, "same"), (201, "same"), (200, "same")]
    got = P.pack(docs_of(rows), capacity=256).collect()
    ids = [(i, np.array([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t in rows]
    want = sorted((repr(i), s // 256, s, len(x[s : s + 256]), zlib.crc32(x[s : s + 256].tobytes())) for i, x in ids for s in range(0, len(x), 256))
    assert sorted((repr(g.doc_id), g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
    sequences = {}
    for g in got:
        sequences.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) == -(-sum(g.length for g in got) // 256) or len(sequences) * 256 < 1.1 * sum(g.length for g in got)


def test_empty(docs_of):
    assert P.pack(docs_of(["x"]).limit(0)).count() == 0


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(P, "KEPT", 1000)
    e = P.WordEncoder(PATH)
    for k in range(4):
        text = " ".join(f"word{j}" for j in range(k, k + 9))
        assert e.encode([text, None])[0].tolist() == [*TOKENIZER.encode(text, add_special_tokens=False).ids, 1]


def test_memory_follows_bytes_and_not_the_number_of_words():
    """Many long texts without blanks are encoded whole, and what is kept of them stays below the bound."""
    r, e = random.Random(3), P.WordEncoder(PATH)
    for k in range(40):
        text = "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(20_000))
        got = e.encode([text])[0]
        assert e.held <= P.KEPT and e.flat.nbytes <= 2 * P.KEPT
        if k % 20 == 0:
            assert got.tolist() == [*TOKENIZER.encode(text, add_special_tokens=False).ids, 1]
