"""The queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chat, decontaminate, html_text, lm_quality, packing, pii, prefix_trie, quality_rules, simhash, suffix_dedup, suffix_tree_lm, vector_codes, warc
from tessera.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and the verdicts of the base rules and of the cascade for every document."""
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity, contrast and verdict of every document, by models trained on the labelled ones."""
    return lm_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation and of the probe, read back from the tokens that they were formatted to."""
    turns = chat.format_turns(chat.with_probe(table(spark, sf_dir, "conversations")))
    return chat.read_back(turns).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark items, and how far."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archive that it was written to."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much personal data each document holds, and where."""
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document when repeated strings of 100 bytes are gone."""
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every document under the suffix tree and under single words."""
    return suffix_tree_lm.score(table(spark, sf_dir, "documents"))


def op13_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code, error and label's error of every vector, and the digest of the codebooks."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_quality_classifier, op3_simhash_near_dedup, op4_chat_formatting, op5_benchmark_decontamination, op6_warc, op7_pii, op8_html_extraction, op9_best_fit_packing, op10_suffix_array_dedup, op11_conversation_prefix_trie, op12_lm_scoring, op13_vector_code_compression)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.SQL, "op4_chat_formatting": chat.SQL, "op6_warc": warc.SQL, "op8_html_extraction": html_text.SQL, "op11_conversation_prefix_trie": prefix_trie.SQL, "op12_lm_scoring": suffix_tree_lm.SQL, "op13_vector_code_compression": vector_codes.SQL}
