"""Filing rules: queries made safe, rooms by path and words, facts from tool calls, entity kinds, filed rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import dialect
from tessera.functions import text as T

#: Bytes of a query that pass untouched, that a cut-out must have, and that it may have.
SAFE_BYTES, LEAST_BYTES, MOST_BYTES = 200, 10, 500


def tail(text: str, most: int = MOST_BYTES) -> str:
    """The last ``most`` bytes, from a whole character on."""
    return text.encode()[-most:].decode("utf-8", "ignore").strip() if len(text.encode()) > most else text


def sanitise_query(raw: str) -> tuple[str, str]:
    """(query, method): a short query as it is; of a long one the last question, else the last line, else its end. Lines come before sentences."""
    if not raw.strip():
        return raw, "passthrough"
    raw = raw.strip()
    size = lambda s: len(s.encode())
    if size(raw) <= SAFE_BYTES:
        return raw, "passthrough"
    parts = lambda pattern: [p for p in map(str.strip, re.split(pattern, raw)) if p][::-1]
    lines = parts(r"\n")
    asked = [x for x in lines if re.search("[?？]\\s*[\"']?\\s*$", x)] or [x for x in parts(r"(?<=[.!?。！？])\s+|\n+") if "?" in x or "？" in x]
    for found, method in ((asked, "question_extraction"), (lines, "tail_sentence")):
        long = next((x for x in found if size(x) >= LEAST_BYTES), None)
        if long:
            return tail(long), method
    return tail(raw), "tail_truncation"


def _matches(part: Column, name: str) -> Column:
    """A path part and a room's name: one is the other, or a whole word of it."""
    word = re.escape(name.lower())
    return part.rlike(rf"(^|[-_. ]){word}($|[-_. ])")


def room_of(path: Column, content: Column, rooms: dict[str, Sequence[str]], head: int = 2000, fallback: str = "general") -> Column:
    """The first folder that names a room or one of its keywords, then the file's stem, then the room whose words come most often at the beginning."""
    low = F.lower(path)
    folders = F.split(F.regexp_replace(low, r"/?[^/]*$", ""), "/")
    stem = F.regexp_extract(low, r"([^/]+?)(\.[^./]*)?$", 1)
    pick = lambda part, keys: F.coalesce(*[F.when(F.coalesce(*[F.when(_matches(part, k), True) for k in keys(n)], F.lit(False)), n) for n in rooms])
    by_folder = F.try_element_at(F.filter(F.transform(folders, lambda p: pick(p, lambda n: [n, *rooms[n]])), lambda r: r.isNotNull()), F.lit(1))
    by_stem = pick(stem, lambda n: [n])
    begin = F.lower(F.substring(content, 1, head))
    counts = F.array(*[sum((F.regexp_count(begin, F.lit(re.escape(k.lower()))) for k in [n, *rooms[n]]), F.lit(0)) for n in rooms])
    by_words = F.when(F.array_max(counts) > 0, F.element_at(F.array(*map(F.lit, rooms)), F.array_position(counts, F.array_max(counts)).cast("int")))
    return F.coalesce(by_folder, by_stem, by_words, F.lit(fallback))


def rooms_of_folders(files: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(path, room): the room of the first folder that the dictionary (folder, room) knows; ``general`` without one."""
    parts = files.select("path", F.posexplode(F.split(F.lower("path"), "/")).alias("pos", "folder"))
    known = parts.join(dictionary.select(F.lower("folder").alias("folder"), "room").dropDuplicates(["folder"]), "folder")
    first = known.groupBy("path").agg(F.min_by("room", "pos").alias("room"))
    return files.join(first, "path", "left").withColumn("room", F.coalesce("room", F.lit("general")))


def union_variants(results: DataFrame, limit: int) -> DataFrame:
    """Results of several forms of a query: equal (source_file, content) once, the first variant's, then the best ``limit``."""
    first = F.row_number().over(Window.partitionBy("query_id", "source_file", "content").orderBy("variant", F.desc("score"), "id"))
    kept = results.withColumn("_n", first).where("_n = 1").drop("_n")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return kept.withColumn("place", place).where(F.col("place") <= limit)


def best_match_similarity(texts: DataFrame) -> DataFrame:
    """(wing, room_a, room_b, similarity): mean over the texts of A of the greatest word overlap with a text of B; not symmetric.

    Texts meet by shared words only; a text that shares no word with B counts as 0.
    """
    t = texts.select("wing", "room", "id", F.array_distinct(F.filter(F.split("content", r"\s+"), lambda w: w != "")).alias("w"))
    x = t.select("wing", "room", "id", F.size("w").alias("n"), F.explode("w").alias("word"))
    a, b = x.alias("a"), x.alias("b")
    both = a.join(b, (F.col("a.wing") == F.col("b.wing")) & (F.col("a.word") == F.col("b.word")) & (F.col("a.room") != F.col("b.room")))
    shared = both.groupBy(F.col("a.wing").alias("wing"), F.col("a.room").alias("room_a"), F.col("b.room").alias("room_b"), F.col("a.id").alias("id"), F.col("b.id").alias("other"), F.col("a.n").alias("an"), F.col("b.n").alias("bn")).agg(F.count(F.lit(1)).alias("s"))
    best = shared.groupBy("wing", "room_a", "room_b", "id").agg(F.max(F.col("s") / (F.col("an") + F.col("bn") - F.col("s"))).alias("best"))
    size = t.groupBy("wing", F.col("room").alias("room_a")).agg(F.count(F.lit(1)).alias("size"))
    return best.groupBy("wing", "room_a", "room_b").agg(F.sum("best").alias("sum")).join(size, ["wing", "room_a"]).select("wing", "room_a", "room_b", (F.col("sum") / F.col("size")).alias("similarity"))


def rerank(results: DataFrame, scorer: Callable[[pd.Series], pd.Series], top: int = 20) -> DataFrame:
    """A given scorer over ``query [SEP] title content`` for the first ``top`` of each query, in Arrow batches."""

    @F.pandas_udf("double")
    def score(pairs: pd.Series) -> pd.Series:
        return scorer(pairs)

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    head = results.withColumn("_p", place).where(F.col("_p") <= top).drop("_p")
    return head.withColumn("score", score(F.concat_ws(" ", "query", F.lit("[SEP]"), "title", "content")))


def cascade_updates(related: DataFrame, trigger: str, depth: int = 3, triggers: Sequence[str] = ("supersede", "invalidate", "contradict")) -> DataFrame:
    """(node, action): related nodes nearer than ``depth`` are invalidated, for updates of a type that spreads."""
    return related.where(F.lit(trigger in triggers) & (F.col("depth") > 0) & (F.col("depth") < depth)).select("node", F.lit("invalidate").alias("action"))


def add_drawers(rows: DataFrame) -> DataFrame:
    """Raw drawers with ids from their content, and for each a compressed fact that is derived from it."""
    raw = rows.withColumn("id", F.concat(F.lit("drawer_"), F.substring(T.content_hash("content"), 1, 24))).dropDuplicates(["id"]).select("id", "wing", "room", "content", F.lit("raw").alias("kind"), F.lit(None).cast("string").alias("derived_from"))

    facts = raw.select(F.concat("id", F.lit("_fact")).alias("id"), "wing", "room", dialect.line("content", F.col("wing"), F.col("room")).alias("content"), F.lit("fact").alias("kind"), F.col("id").alias("derived_from"))
    return raw.unionByName(facts)


def tool_facts(payload: str | None) -> tuple[str, list[str]]:
    """(facts, files) of a tool call's JSON: top-level values as ``key: value``, lists joined; names that look like files."""
    try:
        data = json.loads(payload or "")
    except ValueError:
        return "", []
    if not isinstance(data, dict):
        return "", []
    facts, files = [], []
    for key, value in data.items():
        if isinstance(value, (str, int, float)) and not isinstance(value, bool):
            facts.append(f"{key}: {value}")
        elif isinstance(value, list) and all(isinstance(x, str) for x in value):
            facts.append(f"{key}: {', '.join(value)}")
        for x in value if isinstance(value, list) else [value]:
            if isinstance(x, str) and re.fullmatch(r"[\w./-]*\w+\.\w{1,6}", x):
                files.append(x)
    return "; ".join(facts), sorted(set(files))


def facts(rows: DataFrame, payload: str = "tool_input") -> DataFrame:
    """``rows`` with ``facts`` and ``files``."""

    @F.pandas_udf("struct<facts string, files array<string>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        both = [tool_facts(t) for t in texts]
        return pd.DataFrame({"facts": [f for f, _ in both], "files": [x for _, x in both]})

    return rows.withColumn("_f", run(F.col(payload))).withColumn("facts", F.col("_f.facts")).withColumn("files", F.col("_f.files")).drop("_f")


def branch_sessions(sessions: DataFrame, branch: str) -> DataFrame:
    """Sessions that carry a branch's tag."""
    return sessions.where(F.array_contains("tags", f"branch:{branch}"))


