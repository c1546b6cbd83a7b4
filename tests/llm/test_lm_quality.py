import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lm_quality as L


def brute_grams(text, order=L.ORDER):
    padded = chr(0) * (order - 1) + " ".join((text or "").split())
    return [padded[k : k + order] for k in range(len(padded) - order + 1)]


def brute_model(texts, order=L.ORDER):
    """Interpolated modified Kneser-Ney over strings of characters, written down plainly."""
    counts = {order: Counter(g for t in texts for g in brute_grams(t, order))}
    for k in range(order, 1, -1):
        counts[k - 1] = Counter(g[1:] for g in counts[k])
    model = {}
    for k in range(1, order + 1):
        n = [sum(1 for c in counts[k].values() if c == j) for j in range(5)]
        if n[1] and n[2] and n[3]:
            y = n[1] / (n[1] + 2 * n[2])
            d = [0] + [max(0.05, min(j - 0.05, j - (j + 1) * y * n[j + 1] / n[j])) for j in (1, 2, 3)]
        else:
            d = [0, 0.5, 0.5, 0.5]
        total, cut = Counter(), Counter()
        for g, c in counts[k].items():
            total[g[:-1]] += c
            cut[g[:-1]] += d[min(c, 3)]
        model[k] = counts[k], d, total, cut
    size = len(counts[1]) + 1

    def p(g, k=order):
        if k == 0:
            return 1 / size
        c, d, total, cut = model[k]
        lower, h = p(g[1:], k - 1), g[:-1]
        if not total[h]:
            return lower
        left = c[g] - d[min(c[g], 3)] if g in c else 0
        return (left + cut[h] * lower) / total[h]

    return p


def test_scores_equal_brute_force(spark, docs_of, awkward):
    r = np.random.default_rng(3)
    rows = [(k, " ".join(r.choice(["the", "cat", "sat", "on", "mats", "é日", "語本漢字", "ქართული", "\U0001f600"], r.integers(3, 30)))) for k in range(60)] + [(100 + k, t) for k, (_, t) in enumerate(awkward) if t is None or len(t) < 10_000]
    labels = spark.createDataFrame([(k, 1, int(k >= 40)) for k in range(60)], "doc_id long, quality int, toxic int")
    scored = L.document_scores(docs_of(rows), labels).collect()
    held = {x.doc_id for x in scored if x.held_out and x.sort == "good"}
    assert 0 < len(held) < 40
    p = brute_model([t for i, t in rows if i < 40 and i not in held])
    q = brute_model([t for i, t in rows if 40 <= i < 60 and i not in {x.doc_id for x in scored if x.held_out}])
    by_id = dict(rows)
    assert len(scored) == len(rows)
    for x in scored:
        g = brute_grams(by_id[x.doc_id])
        assert x.n_chars == len(g)
        if len(g):
            assert x.perplexity == pytest.approx(math.exp(-sum(math.log(p(c)) for c in g) / len(g)), rel=1e-4)
            assert x.contrast == pytest.approx(sum(math.log(q(c)) - math.log(p(c)) for c in g) / len(g), abs=1e-4)
        else:
            assert x.perplexity is None and x.contrast is None


def test_keeps_clean_and_rejects_junk(spark, docs_of):
    r = np.random.default_rng(4)
    words = ["river", "stone", "mill", "and", "the", "old", "runs", "by", "green", "field"]
    rows = [(k, " ".join(r.choice(words, 80))) for k in range(200)] + [(500, "#$% @@ ^^ 99 ~~ " * 20), (501, "QZX JJKW VVX " * 20), (502, None)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(120)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in L.classify(docs_of(rows), labels).collect()}
    assert len(got) == len(rows) and not got[500].kept and not got[501].kept and got[502].kept
    assert sum(got[k].kept for k in range(200)) >= 198


def test_without_labels_or_documents(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [x.kept for x in L.classify(docs_of(["some text"]), none).collect()] == [True]
    assert L.classify(docs_of(["x"]).limit(0), none).count() == 0


def test_lookup_table():
    r = np.random.default_rng(1)
    g = np.unique(r.integers(0, 2**42, (5000, 2)) // [[1, 2**20]], axis=0)
    a, b = g[:, 0].copy(), g[:, 1].copy()
    s = L.Scores(a, b, np.arange(len(a), dtype=np.float32), -np.arange(len(a), dtype=np.float32))
    other = r.integers(0, 2**42, (2, 100))
    got = s.of(np.concatenate([a[10:20], a[10:12], other[0]]), np.concatenate([b[10:20], b[10:12], other[1]]))
    assert got[:, 0].tolist() == [*range(10, 20), 10, 11, *[0] * 100] and (got[:, 1] == -got[:, 0]).all()
    assert (s.of(a, b)[:, 0] == np.arange(len(a))).all()
    assert L.Scores(a[:0], b[:0], np.zeros(0, np.float32)).of(a[:5], b[:5]).sum() == 0


def test_stretches_of_long_texts_hold_the_same_n_grams(monkeypatch):
    texts = ["one text of some length", None, "", "x", "a longer text than the others are"]
    whole = [L.codes(L.blanked(t)) for t in texts]
    monkeypatch.setattr(L, "AT_ONCE", 7)
    parts = [(k, L.codes(*g)) for group in L.stretches(texts) for k, *g in group]
    assert all(sum(g[3] - g[2] for g in group) <= 7 for group in L.stretches(texts))
    for k, (a, b) in enumerate(whole):
        assert np.concatenate([np.zeros(0), *(x[0] for i, x in parts if i == k)]).tolist() == a.tolist()
        assert np.concatenate([np.zeros(0), *(x[1] for i, x in parts if i == k)]).tolist() == b.tolist()


def test_codes_are_whole_characters():
    a, b = L.codes("日本語 \U0001f600x")
    back = [[chr(x >> 21), chr(x & L.ONE), chr(y >> 42), chr(y >> 21 & L.ONE), chr(y & L.ONE)] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert ["".join(g) for g in back] == brute_grams("日本語 \U0001f600x")


def test_threshold_rejects_labelled_toxic_texts(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = L.classify(docs, labels).join(labels, "doc_id").where("lang = 'en'").collect()
    toxic, clean = [x for x in got if x.toxic], [x for x in got if x.quality and not x.toxic]
    assert sum(not x.kept for x in toxic) >= 0.8 * len(toxic)
    assert sum(not x.kept for x in clean) <= 0.1 * len(clean)


def test_every_row_comes_back_whatever_the_blocks(spark, docs_of, monkeypatch, tmp_path):
    """Null and repeated ids, one block or many, from files or not: a row for a row and the same scores."""
    rows = [(k, "the cat sat on the mat and ran") for k in range(20)] + [(None, "one text"), (None, "another longer text"), (None, "another longer text"), (3, "a second text of three"), (4, "the cat sat on the mat and ran"), (None, None)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    order = lambda x: (x.doc_id is None, x.doc_id or 0, x.n_chars, x.perplexity or 0.0)
    docs_of(rows).write.parquet(str(tmp_path / "docs"))
    one = sorted(L.document_scores(docs_of(rows), labels).collect(), key=order)
    monkeypatch.setattr(L, "BLOCK_ROWS", 5)
    monkeypatch.setattr(L, "PIECE_ROWS", 2)
    monkeypatch.setattr(L, "AT_ONCE", 16)
    monkeypatch.setattr(L, "HELD_GRAMS", 40)
    many = sorted(L.document_scores(spark.read.parquet(str(tmp_path / "docs")), labels).collect(), key=order)
    assert len(one) == len(many) == len(rows)
    for x, y in zip(one, many, strict=True):
        assert (x.doc_id, x.n_chars) == (y.doc_id, y.n_chars) and (x.perplexity or 0.0) == pytest.approx(y.perplexity or 0.0, rel=1e-9)


def test_contrast_finds_toxic_texts_of_common_n_grams(spark, docs_of):
    """Toxic texts made of the language's own syllables: no perplexity tells them, the contrast does."""
    r = np.random.default_rng(6)
    syllables = ["an", "der", "lich", "keit", "ung", "ver", "be", "ein"]
    word = lambda first: first + "".join(r.choice(syllables, 2))
    clean = lambda: " ".join(word(r.choice(syllables[:6])) for _ in range(120))
    toxic = lambda: " ".join(word("bebe" if r.random() < 0.25 else r.choice(syllables[:6])) for _ in range(120))
    rows = [(k, clean()) for k in range(300)] + [(300 + k, toxic()) for k in range(100)]
    labels = spark.createDataFrame([(k, 1, int(k >= 300)) for k in range(400) if k % 2], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.kept for x in L.classify(docs_of(rows), labels).collect()}
    assert sum(not got[k] for k in range(300, 400, 2)) >= 45 and sum(got[k] for k in range(0, 300, 2)) >= 135


def test_an_n_gram_is_one_row_for_both_models(spark, docs_of, monkeypatch):
    made, score = [], L.Model.score

    def watched(self, sets):
        out = score(self, sets)
        made.append((out.count(), sets[L.ORDER].select("a", "b").distinct().count()))
        return out

    monkeypatch.setattr(L.Model, "score", watched)
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(20)], "doc_id long, quality int, toxic int")
    L.document_scores(docs_of([(k, f"text {k} of some words") for k in range(30)]), labels)
    ((rows, grams),) = made
    assert rows == grams > 0
