import re
import zlib

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import decontaminate, packing, pii, quality_rules
from tests.llm.test_decontaminate import brute_tiles
from tests.llm.test_pii import plain_base
from tests.llm.test_shingle_dedup import brute_labels

SF = "/root/testdata/sf0.001"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def brute_leaks(text, items, seed=6, coverage=0.6):
    """Does greedy string tiling, as written down, cover enough of any item?"""
    words = decontaminate.words_of(text)
    grams = {tuple(words[k : k + seed]) for k in range(len(words))}
    for item in items:
        own = decontaminate.words_of(item)
        width = min(seed, len(own))
        if own and any(tuple(own[k : k + seed]) in grams for k in range(len(own))) and sum(n for *_, n in brute_tiles(words, own, width)) >= coverage * len(own):
            return True
    return False


def brute_pipeline(rows, items):
    """Texts by doc_id before redaction: rules, Jaccard groups and tiles, each written down plainly."""
    rules = quality_rules.BASE_RULES + quality_rules.MORE_RULES
    kept = {i: t for i, t in rows if quality_rules.first_rejection(quality_rules.TextView(t), rules) is None}
    label = brute_labels(list(kept.items()))
    return {i: t for i, t in kept.items() if label[i] == i and not brute_leaks(t, items)}


def test_pipeline_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = brute_pipeline(rows, items)
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(kept) and 0 < len(kept) < len(rows)
    model = pii.train()
    want, lengths = set(), []
    for i, text in kept.items():
        (base, spans), = pii.all_spans(model, [text])
        assert base == plain_base(text)
        clean = pii.redact_text(text, spans)
        assert not plain_base(clean) and len(re.findall(r"\[(?:EMAIL|IP|CARD|PHONE)\]", clean)) >= bool(base)
        ids = [*TOKENIZER.encode(clean, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), packing.CAPACITY):
            part = ids[k : k + packing.CAPACITY]
            want.add((i, k // packing.CAPACITY, k, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
            lengths.append(len(part))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    sequences, bins = {}, []
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        ends = [0, *(a + n for a, n in sorted(own))]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= packing.CAPACITY
    for n in sorted(lengths, reverse=True):  # best fit, longest first
        fits = min((k for k in range(len(bins)) if bins[k] >= n), key=lambda k: bins[k], default=None)
        if fits is None:
            bins.append(packing.CAPACITY - n)
        else:
            bins[fits] -= n
    assert len(sequences) == len(bins)


def test_stages_return_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def written(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").withColumn("doc_id", F.lit("clash")).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_awkward_documents_through_all_stages(spark, docs_of, awkward, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and clashing names: what the rules keep comes out once."""
    prose = "the river runs by the old mill and the people of the town say that it has always done so, for as long as there have been bridges over it and boats upon it, which is longer than any of them can tell"
    docs = docs_of([*awkward, (20, prose), (20, prose), (21, prose), (None, prose + " again and again")]).withColumn("lang", F.when(F.col("doc_id") != 20, F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    rows = corpus_pipeline.run(spark, written(spark, tmp_path, docs)).collect()
    assert [r.doc_id for r in rows].count(20) == 1 and 21 not in {r.doc_id for r in rows}
    assert not {0, 1, 2, 7} & {r.doc_id for r in rows}
    assert all(0 < r.length <= packing.CAPACITY for r in rows)


@pytest.mark.parametrize("n", [0])
def test_empty_table(spark, docs_of, tmp_path, n):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, docs_of(["x"]).limit(n))).count() == 0
