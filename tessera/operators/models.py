"""Steps that a language model takes part in: the model is the caller's function, what surrounds it is Spark's work.

A model takes a pandas Series of prompts and returns a Series of answers; it is called in Arrow batches where the rows lie. Without
one (``silent``) every step gives what it can say without a model. Answers are XML-like; what cannot be parsed says nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

Model = Callable[[pd.Series], pd.Series]


def silent(prompts: pd.Series) -> pd.Series:
    return pd.Series([None] * len(prompts), dtype=object)


def asked(model: Model, prompt: Column) -> Column:
    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return model(prompts)

    return run(prompt)


def tagged(answer: Column, tag: str) -> Column:
    """The trimmed contents of all ``<tag>`` elements of an answer."""
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(rf"(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>"), 1)
    return F.filter(F.transform(found, T.trimmed), lambda x: x != "")


def expand_with(queries: DataFrame, model: Model = silent, most: int = 5) -> DataFrame:
    """(query_id, variant, query): the query itself as variant 0, then at most ``most`` different reformulations of the model."""
    answered = queries.select("query_id", "query", asked(model, F.col("query")).alias("answer"))
    more = F.array_except(F.array_distinct(tagged(F.col("answer"), "query")), F.array("query"))
    forms = F.concat(F.array("query"), F.slice(more, 1, most))
    return answered.select("query_id", F.posexplode(forms).alias("variant", "query"))


def extract_graph(observations: DataFrame, model: Model = silent, confidence: float = 0.7) -> DataFrame:
    """(subject, predicate, object, confidence, source_ids): ``<edge>subject|predicate|object</edge>`` of the answers, each fact once with its sources.

    Ends are normalised as entity ids; an edge with an empty part is none.
    """
    answered = observations.select("id", asked(model, F.concat_ws("\n", "title", "narrative")).alias("answer"))
    parts = answered.select("id", F.explode(tagged(F.col("answer"), "edge")).alias("e")).select("id", F.split("e", r"\|").alias("p")).where("size(p) = 3")
    edges = parts.select("id", T.entity_id(T.trimmed(F.col("p")[0])).alias("subject"), F.lower(T.trimmed(F.col("p")[1])).alias("predicate"), T.entity_id(T.trimmed(F.col("p")[2])).alias("object"))
    named = edges.where("subject <> '' AND predicate <> '' AND object <> ''")
    return named.groupBy("subject", "predicate", "object").agg(F.count(F.lit(1)).alias("times"), F.min("id").alias("first_id")).withColumn("confidence", F.lit(confidence))


def compress_observations(raw: DataFrame, model: Model = silent) -> DataFrame:
    """(id, title, narrative, compressed): the model's title and narrative; what it does not say stays the observation's own."""
    answered = raw.select("id", "title", "narrative", asked(model, F.concat_ws("\n", "title", "narrative")).alias("answer"))
    said = lambda tag: F.get(tagged(F.col("answer"), tag), F.lit(0))
    return answered.select("id", F.coalesce(said("title"), "title").alias("title"), F.coalesce(said("narrative"), "narrative").alias("narrative"), said("narrative").isNotNull().alias("compressed"))


def consolidate(summaries: DataFrame, patterns: DataFrame, model: Model = silent, least_summaries: int = 5, least_patterns: int = 2, least_frequency: int = 2, prompt_items: int = 50) -> DataFrame:
    """(project, kind, content): semantic memories of projects with enough summaries, procedural ones of those with enough frequent patterns.

    ``summaries`` is (project, ts, text), ``patterns`` (project, pattern, frequency). A prompt holds the newest, or the most
    frequent, ``prompt_items`` of a project: that is the model's window, which groups are cut to before they are gathered.
    """

    def gathered(rows: DataFrame, order: Column, text: str, least: int, kind: str) -> DataFrame:
        from pyspark.sql import Window

        w = Window.partitionBy("project")
        ranked = rows.withColumn("_n", F.row_number().over(w.orderBy(order, text))).withColumn("_all", F.count(F.lit(1)).over(w))
        kept = ranked.where((F.col("_all") >= least) & (F.col("_n") <= prompt_items))
        prompt = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(text).alias("t")))), lambda x: x["t"]), "\n")
        return kept.groupBy("project").agg(prompt.alias("prompt")).withColumn("kind", F.lit(kind))

    both = gathered(summaries, F.desc("ts"), "text", least_summaries, "semantic").unionByName(gathered(patterns.where(F.col("frequency") >= least_frequency), F.desc("frequency"), "pattern", least_patterns, "procedural"))
    answered = both.select("project", "kind", asked(model, F.col("prompt")).alias("answer"))
    return answered.select("project", "kind", F.explode(tagged(F.col("answer"), "memory")).alias("content")).distinct()
