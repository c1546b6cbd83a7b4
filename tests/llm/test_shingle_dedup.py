import corpus_pipeline
import numpy as np
import pytest

from tessera.llm import shingle_dedup as D


def brute_set(text):
    words = (text or "").encode().lower().split()
    return set(zip(*(words[k:] for k in range(5)))) if len(words) >= 5 else {tuple(words)}


def brute_labels(rows, least=0.8):
    """Smallest id of each id's component under 5-word Jaccard similarity of ``least`` or more."""
    label, sets = {i: i for i, _ in rows}, {i: brute_set(t) for i, t in rows}
    for i in sets:
        for j in sets:
            if j < i and label[i] != label[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = max(label[i], label[j]), min(label[i], label[j])
                label = {k: b if x == a else x for k, x in label.items()}
    return label


def near_copies(n=40):
    r, words = np.random.default_rng(8), [f"w{k}" for k in range(3000)]
    rows = []
    for k in range(n):
        text = [str(x) for x in r.choice(words, 200)]
        rows.append((10 * k, " ".join(text)))
        for m, edits in enumerate((1, 3, 4, 5, 9)):
            other = list(text)
            for at in r.choice(200, edits, replace=False):
                other[at] = "changed"
            rows.append((10 * k + 1 + m, " ".join(other)))
    return rows


@pytest.mark.parametrize("block", [D.BLOCK, 2])
def test_near_duplicates_equal_brute_force(docs_of, awkward, block):
    rows = near_copies() + [(1000 + i, t) for i, t in dict(awkward).items() if i is not None]
    want = brute_labels(rows)
    assert 40 < len(set(want.values())) < len(rows)
    assert {x.doc_id: x.component_id for x in D.near_duplicates(docs_of(rows), block).collect()} == want


def test_stage_drops_near_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    label = brute_labels([(x.doc_id, x.text) for x in docs.collect()])
    got = {x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert got == {i for i, first in label.items() if i == first} and 56 not in got


def test_keep_one_of_awkward_rows(docs_of, awkward):
    out = D.keep_one(docs_of(awkward))
    ids = [x.doc_id for x in out.collect() if x.doc_id is not None]
    assert 3 in ids and 4 not in ids and 0 in ids and 1 not in ids and len(ids) == len(set(ids))
    assert out.columns == docs_of(awkward).columns
    assert D.keep_one(docs_of(["x"]).limit(0)).count() == 0
