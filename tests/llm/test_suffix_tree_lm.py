"""The suffix tree against a plain one of dictionaries, and what it says of texts that it has not seen."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import suffix_tree_lm as S


def plain(rows, order=2, hot=1 << 60):
    """Contexts are tuples, () the root; '^' is a text's start (no word has it here)."""
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _ in rows]
    texts = [[*"".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split(), b""] for _, t in rows]
    uni = Counter(w for x, h in zip(texts, held, strict=True) if not h for w in x)
    n, v = sum(uni.values()), len(uni)
    root = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    counts: dict = {}
    for x, h in zip(texts, held, strict=True):
        padded = ["^", *x]
        for k in range(1, len(padded)):
            for m in range(1, min(order, k) + 1):
                if not h:
                    counts.setdefault(tuple(padded[k - m : k]), Counter())[padded[k]] += 1
    states: set = set()

    def prob(context, w, longest=order):
        for m in range(min(longest, len(context)), 0, -1):
            if (s := tuple(context[-m:])) in states:
                c = counts[s]
                return (c[w] + len(c) * prob(context, w, m - 1)) / (sum(c.values()) + len(c))
        return root(w)

    for m in range(1, order + 1):
        found = set()
        for s, c in counts.items():
            total, t = sum(c.values()), len(c)
            if len(s) == m and total >= S.MIN_COUNT:
                p = {w: math.exp(-round(-math.log(prob(s, w, m - 1)) * S.NATS) / S.NATS) for w in c}
                if total >= hot:
                    gain = sum(k * math.log(k / total / p[w]) for w, k in c.items())
                else:
                    gain = sum(k * (math.log((k - 1 + t * p[w]) / (total - 1 + t)) - math.log(p[w])) for w, k in c.items())
                if gain > S.GAIN:
                    found.add(s)
        states |= found
    out = []
    for (i, _), x, h in zip(rows, texts, held, strict=True):
        padded = ["^", *x]
        score = sum(math.log10(prob(padded[max(0, k - order) : k], padded[k])) for k in range(1, len(padded)))
        out.append((i, h, len(x), sum(uni[w] > 0 for w in x), n, sum(math.log10(root(w)) for w in x), score))
    return sorted(out, key=repr), states


def run(df, order=2, hot=S.HOT_COUNT):
    return sorted((tuple(r) for r in S.score(df, order, hot).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=repr)


def near(got, want):
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], atol=1e-5)


def corpus(n, seed=1):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    follow = {w: r.sample(words, 3) for w in words}
    out = []
    for i in range(n):
        w, text = r.choice(words), []
        for _ in range(r.choice([5, 20, 60])):
            text.append(w)
            w = r.choice(follow[w]) if r.random() < 0.8 else r.choice(words)
        out.append((i, " ".join(text)))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_the_plain_tree(docs_of, order, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_TOKENS", 500)
    rows = corpus(120)
    want, states = plain(rows, order)
    assert {len(s) for s in states} >= set(range(1, min(order, 2) + 1))
    near(run(docs_of(rows), order), want)


def test_hot_contexts_are_dealt_out(docs_of, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_TOKENS", 400)
    rows = [(i, t.replace("w1", "hot").replace("w2", "hot")) for i, t in corpus(100, 2)]
    near(run(docs_of(rows), hot=60), plain(rows, hot=60)[0])


def test_awkward_rows(docs_of, awkward):
    rows = [*awkward, (20, "A a ÄÄ a\x0ba\x0ca\x85b"), (21, "É É"), (22, "x" * 100_000)]
    near(run(docs_of(rows)), plain(rows)[0])


def test_empty_and_untrained(docs_of):
    assert run(docs_of([])) == []
    held = next(i for i in range(99) if S.held_out(i))
    near(run(docs_of([(held, "a b"), (held, None)])), [(held, True, 1, 0, 0, 0.0, 0.0), (held, True, 3, 0, 0, 0.0, 0.0)])


def test_unseen_texts_are_likelier_than_by_words_alone(spark):
    rows = S.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > 0.95 * rows[1]


def test_a_state_is_a_distribution():
    """With the unknown class, smoothed probabilities sum to one."""
    rows = corpus(60, 3)
    _, states = plain(rows)
    assert states
    c = Counter({"a": 5, "b": 2})
    parent = {"a": 0.2, "b": 0.1, "c": 0.6, None: 0.1}
    assert math.isclose(sum((c[w] + len(c) * p) / (sum(c.values()) + len(c)) for w, p in parent.items()), 1)


def test_packing_round_trip():
    r = np.random.default_rng(1)
    for x in (np.zeros(0, np.int64), np.array([0]), r.integers(0, 300, 1000), r.integers(0, 1 << 40, 1000)):
        assert (S.unpack(S.pack(x)) == x).all() and (S.unpack_steps(S.pack_steps(x)) == x).all()
    words = [b"", b"a", b"\xff\x00", b"b" * 1000]
    assert S.unpack_words(S.pack_words(words)) == words and S.unpack_words(S.pack_words([])) == []
