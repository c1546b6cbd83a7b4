"""Retrieval quality: DCG, NDCG, recall and token F1, as aggregates over ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dcg_gain(relevance: Column, rank: Column) -> Column:
    """rank is 0-based."""
    return relevance / F.log2(rank + F.lit(2.0))


def ranked_metrics(hits: DataFrame, k: int) -> DataFrame:
    """Per query: recall_any, recall_all, ndcg at ``k`` from (query_id, rank (0-based), relevance, n_correct).

    A query without correct ids has recall 1. The ideal order is that of the relevances that were retrieved.
    """
    top = hits.where(F.col("rank") < k)
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "rank")) - 1
    per = top.withColumn("ideal", ideal).groupBy("query_id").agg(
        F.max("n_correct").alias("n_correct"),
        F.sum((F.col("relevance") > 0).cast("int")).alias("found"),
        F.sum(dcg_gain(F.col("relevance"), F.col("rank"))).alias("dcg"),
        F.sum(dcg_gain(F.col("relevance"), F.col("ideal"))).alias("idcg"),
    )
    return per.select(
        "query_id",
        F.when((F.col("n_correct") == 0) | (F.col("found") > 0), 1.0).otherwise(0.0).alias("recall_any"),
        F.when(F.col("found") >= F.col("n_correct"), 1.0).otherwise(0.0).alias("recall_all"),
        F.when(F.col("idcg") == 0, 0.0).otherwise(F.col("dcg") / F.col("idcg")).alias("ndcg"),
    )


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the distinct words, commas and articles left out."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(t), ",", ""), r"\s+"), lambda w: ~w.isin("", "a", "an", "the")))
    x, y = words(a), words(b)
    both = F.size(F.array_intersect(x, y))
    p, r = both / F.size(x), both / F.size(y)
    return F.when(both == 0, 0.0).otherwise(2 * p * r / (p + r))
