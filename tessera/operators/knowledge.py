"""Lessons, insights, observations, files, registries and the smaller stores' queries and updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


def save_lessons(existing: DataFrame, new: DataFrame, boost: float = 0.1) -> DataFrame:
    """Upsert by fingerprint of the text: a lesson that is known is reinforced, others are added. (fingerprint, content, confidence, reinforced)."""
    given = new.withColumn("fingerprint", T.content_hash("content")).groupBy("fingerprint").agg(F.min("content").alias("content"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("times"))
    both = existing.join(given.select("fingerprint", "times", F.col("confidence").alias("_c"), F.col("content").alias("_t")), "fingerprint", "full")
    known = F.col("content").isNotNull()
    more = F.coalesce("times", F.lit(0))
    return both.select("fingerprint", F.coalesce("content", "_t").alias("content"), F.when(known, F.least(F.lit(1.0), F.col("confidence") + boost * more)).otherwise(F.least(F.lit(1.0), F.col("_c") + boost * (more - 1))).alias("confidence"), F.when(known, F.col("reinforced") + more).otherwise(more - 1).cast("long").alias("reinforced"))


def strengthen(lessons: DataFrame, key: Column, boost: float = 0.1) -> DataFrame:
    """Rows that match gain ``boost`` confidence, at most 1, and a reinforcement; deleted ones do not change."""
    hit = key & ~F.coalesce(F.col("deleted"), F.lit(False))
    return lessons.withColumn("confidence", F.when(hit, F.least(F.lit(1.0), F.col("confidence") + boost)).otherwise(F.col("confidence"))).withColumn("reinforced", F.col("reinforced") + hit.cast("int"))


def decay_sweep(lessons: DataFrame, days: Column, rate: float) -> DataFrame:
    """A week's ``rate`` off for each whole week, not below .05; what is at .1 or less and was never reinforced is deleted softly."""
    new = F.greatest(F.lit(0.05), F.col("confidence") - rate * F.floor(days / 7))
    return lessons.withColumn("confidence", new).withColumn("deleted", F.coalesce(F.col("deleted"), F.lit(False)) | ((F.col("confidence") <= 0.1) & (F.col("reinforced") == 0)))


def link(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Typed edges (subject, predicate, object, weight) with an id of their own; an edge that exists is not added again."""
    named = new.withColumn("edge_id", F.concat(F.lit("me_"), "subject", F.lit("_"), "predicate", F.lit("_"), "object")).dropDuplicates(["edge_id"])
    return edges.unionByName(named.join(edges.select("edge_id"), "edge_id", "left_anti").select(*edges.columns))


def unlink(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("subject", "predicate", "object").distinct(), ["subject", "predicate", "object"], "left_anti").select(*edges.columns)


def tunnel_id(wing_a: Column, room_a: Column, wing_b: Column, room_b: Column) -> Column:
    """The same for both directions."""
    a, b = F.concat_ws("/", wing_a, room_a), F.concat_ws("/", wing_b, room_b)
    return F.substring(F.sha2(F.concat_ws("|", F.least(a, b), F.greatest(a, b)), 256), 1, 16)


def file_context(memories: DataFrame, path: str) -> DataFrame:
    """Memories whose files overlap the path by substring, either way, and their other files."""
    overlaps = lambda f: f.contains(path) | F.lit(path).contains(f)
    return memories.where(F.exists("files", overlaps)).withColumn("other_files", F.filter("files", lambda f: ~overlaps(f)))


def bug_memories(memories: DataFrame, path: str, terms: Sequence[str] = ("bug", "error", "fix")) -> DataFrame:
    """Memories of a file with a concept that contains a bug term."""
    named = F.exists("concepts", lambda c: F.lit(False) if not terms else sum((F.lower(c).contains(t).cast("int") for t in terms), F.lit(0)) > 0)
    return file_context(memories, path).where(named)


# What the parts of an observation add to its importance, which starts from a half and stays within 0 and 1.
HOOK_WEIGHTS = {"post_tool_use_failure": 0.3, "session_end": -0.1, "notification": 0.1}
TOOL_WEIGHTS = {"edit|write": 0.2, "delete|remove": 0.15, "error|fail": 0.2, "test|build": 0.1}
OUTPUT_WEIGHTS = {"error|exception|failed": 0.2, "success|completed": 0.05}
FILES_WEIGHT, MANY_FILES_WEIGHT, FACTS_WEIGHT = 0.1, 0.05, 0.1
# Points of an observation's quality. Lengths are in bytes.
FACT_POINTS, FACTS_POINTS, NARRATIVE_POINTS, LONG_POINTS, TITLE_POINTS, CONCEPT_POINTS, RATED_POINTS = 25, 10, 20, 5, 15, 15, 10


def importance(observations: DataFrame) -> DataFrame:
    """``score`` from tool, hook, output (strings), files and facts (arrays); what is null adds nothing."""
    worth = lambda hit, weight: F.when(hit, weight).otherwise(0.0)
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    parts = [worth(low("hook") == k, w) for k, w in HOOK_WEIGHTS.items()] + [worth(low("tool").rlike(k), w) for k, w in TOOL_WEIGHTS.items()] + [worth(low("output").rlike(k), w) for k, w in OUTPUT_WEIGHTS.items()]
    parts += [worth(n("files") > 0, FILES_WEIGHT), worth(n("files") > 2, MANY_FILES_WEIGHT), worth(n("facts") >= 3, FACTS_WEIGHT)]
    return observations.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum(parts, F.lit(0.5)))))


def quality(observations: DataFrame) -> DataFrame:
    """``quality``, 0 to 100, from facts, concepts (arrays), narrative, title and importance (1 to 10)."""
    points = lambda hit, n: F.when(hit, n).otherwise(0)
    long = lambda c: F.octet_length(F.coalesce(F.col(c), F.lit("")))
    q = points(F.size("facts") > 0, FACT_POINTS) + points(F.size("facts") >= 3, FACTS_POINTS) + points(long("narrative") >= 20, NARRATIVE_POINTS) + points(long("narrative") >= 50, LONG_POINTS)
    q += points(long("title").between(5, 120), TITLE_POINTS) + points(F.size("concepts") > 0, CONCEPT_POINTS) + points(F.col("importance").between(1, 10), RATED_POINTS)
    return observations.withColumn("quality", F.least(F.lit(100), q))


def origin(documents: DataFrame, brands: Sequence[str], text: str = "text") -> DataFrame:
    """AI dialogue or not, by brand names a thousand characters and turns a thousand characters; confidence up to .95."""
    per_k = lambda n: n * 1000.0 / F.greatest(F.lit(1), F.length(text))
    brand = per_k(F.regexp_count(F.lower(text), F.lit("|".join(brands))))
    turns = per_k(F.regexp_count(text, F.lit(r"(?m)^(User|Assistant|Human|AI):")))
    marked = documents.withColumn("brand_density", brand).withColumn("turn_density", turns)
    is_ai = (F.col("brand_density") >= 0.5) | (F.col("turn_density") >= 2)
    return marked.withColumn("origin", F.when(is_ai, "ai_dialogue").otherwise("document")).withColumn("confidence", F.when(is_ai, F.least(F.lit(0.95), 0.6 + 0.1 * (F.col("brand_density") + F.col("turn_density")))).otherwise(0.6))


def registry_lookup(words: DataFrame, people: DataFrame, projects: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(word, kind, name): people by name or alias first, then projects, then what was confirmed; else unknown."""
    alias = people.select(F.explode(F.concat(F.array("name"), "aliases")).alias("a"), F.col("name").alias("person")).select(F.lower("a").alias("key"), "person").groupBy("key").agg(F.min("person").alias("person"))
    p = projects.select(F.lower("name").alias("key"), F.col("name").alias("project")).dropDuplicates(["key"])
    c = confirmed.select(F.lower("name").alias("key"), F.col("kind").alias("confirmed")).dropDuplicates(["key"])
    joined = words.withColumn("key", F.lower("word")).join(alias, "key", "left").join(p, "key", "left").join(c, "key", "left")
    return joined.select("word", F.when(F.col("person").isNotNull(), "person").when(F.col("project").isNotNull(), "project").otherwise(F.coalesce("confirmed", F.lit("unknown"))).alias("kind"), F.coalesce("person", "project", "word").alias("name"))


def similar_names(words: DataFrame, names: DataFrame, most: int = 2) -> DataFrame:
    """(word, name, distance): registry names one or two edits away. Pairs meet under a deletion neighbourhood of one letter, or of two."""
    def variants(c: Column) -> Column:
        one = F.transform(F.sequence(F.lit(1), F.length(c)), lambda k: F.concat(F.substring(c, F.lit(1), k - 1), F.substring(c, k + 1, F.length(c))))
        two = F.flatten(F.transform(one, lambda x: F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(1), F.length(x)), lambda k: F.concat(F.substring(x, F.lit(1), k - 1), F.substring(x, k + 1, F.length(x))))).otherwise(F.array(x))))
        return F.array_distinct(F.concat(F.array(c), one, two) if most > 1 else F.concat(F.array(c), one))

    w = words.select("word").distinct().select("word", F.explode(variants(F.col("word"))).alias("v"))
    n = names.select("name").distinct().select("name", F.explode(variants(F.col("name"))).alias("v"))
    pairs = w.join(n, "v").select("word", "name").distinct()
    return pairs.withColumn("distance", F.levenshtein("word", "name")).where((F.col("distance") >= 1) & (F.col("distance") <= most))


def claims(texts: DataFrame) -> DataFrame:
    """(id, subject, role, object): ``X is Y's role``."""
    m = F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-z]+) is ([A-Z][a-z]+)'s ([a-z]+)\b"), 0)
    c = texts.select("id", F.explode(m).alias("m"))
    part = lambda k: F.regexp_extract("m", r"^([A-Z][a-z]+) is ([A-Z][a-z]+)'s ([a-z]+)$", k)
    return c.select("id", part(1).alias("subject"), part(3).alias("role"), part(2).alias("object"))


def contradictions(claimed: DataFrame, triples: DataFrame) -> DataFrame:
    """Claims that open facts of the same pair state otherwise (relationship_mismatch), or that only a closed fact states (stale_fact)."""
    f = triples.select("subject", "object", F.col("predicate").alias("fact"), F.col("valid_to").isNull().alias("open"))
    g = claimed.join(f, ["subject", "object"]).groupBy("id", "subject", "role", "object").agg(F.bool_or((F.col("fact") == F.col("role")) & F.col("open")).alias("holds"), F.bool_or((F.col("fact") == F.col("role")) & ~F.col("open")).alias("held"), F.bool_or((F.col("fact") != F.col("role")) & F.col("open")).alias("other"))
    verdict = F.when(F.col("holds"), None).when(F.col("held"), "stale_fact").when(F.col("other"), "relationship_mismatch")
    return g.withColumn("verdict", verdict).where("verdict IS NOT NULL").select("id", "subject", "role", "object", "verdict")


def image_payload(json: Column) -> Column:
    """Does a tool's JSON carry an image: a data URI, the magic of an encoded one, or a file name?"""
    return json.rlike(r"data:image/|iVBORw0KGgo|/9j/4AAQ|R0lGOD|UklGR|(?i)\.(png|jpe?g|gif|webp)\b")


def replay(log: DataFrame, start: int) -> DataFrame:
    """Events from a sequence number on; within a file that is sorted by it, row groups before are skipped."""
    return log.where(F.col("sequence") >= start).orderBy("sequence")


def compact(log: DataFrame, key: str) -> DataFrame:
    """The last event of each key."""
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), "sequence").alias("_l")).select(key, "_l.*")


def expire(rows: DataFrame, now: Column, active: str = "active", expired: str = "expired") -> DataFrame:
    """Checkpoints, sentinels and sketches whose time has come."""
    return rows.withColumn("status", F.when((F.col("status") == active) & (F.col("expires_at") <= now), expired).otherwise(F.col("status")))
