"""The corpus pipeline: quality rules, near-dedup, decontamination, redaction of personal data, packing.

Every stage works on what its predecessor kept; ``run`` writes each stage's rows as Parquet in the shared folder and reads them
again, so a lost executor never costs more than the stage it was lost in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, packing, pii, quality_rules, shingle_dedup
from tessera.llm.common import new_path, table


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects (``quality_rules``), all columns.

    A null or wordless text is rejected; repeated rows and rows with null ids are judged each on its own.
    """
    return quality_rules.filter_quality(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar by 0.8 or more, that with the smallest doc_id.

    Copies leave one row; a row with a null doc_id goes if any other row of its group has an id; texts without words are one group.
    """
    return shingle_dedup.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item is contained in to six tenths of its words or more, its parts in any order.

    A null or empty text or item contains nothing.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; ``n_chars`` follows the text. A null text stays null."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; a null text is the closing id alone."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", apply_quality_rules),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("pii_redaction", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: SimHash and tokenisation have no counterpart in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


#: Rows that a task hands to Python at once. Texts are long; the default of 10 000 rows holds tens of megabytes several times over.
ARROW_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; what the last one wrote."""
    key, rows = ARROW_ROWS
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES:
            path = new_path(spark, f"pipeline-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
        return docs
    finally:
        spark.conf.set(key, before)
