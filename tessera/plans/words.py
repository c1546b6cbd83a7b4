"""Text functions, filing rules, stores and streams over the supplied tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import udfs as U
from tessera.operators import coordination as C
from tessera.operators import graph as G
from tessera.operators import ingest as I
from tessera.operators import knowledge as K
from tessera.operators import lifecycle as L
from tessera.operators.settle import shared_dir
from tessera.plans import base as B
from tessera.plans.registry import query
from tessera.sources import files, stores
from tessera.streaming import stateful as S


def _docs(spark, d, *columns: str):
    return B.table(spark, d, "documents").selectExpr("doc_id AS id", *columns)


@query("token_profiles", r"WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS w FROM documents) SELECT id, len(w)::INT AS n, len(list_distinct(w))::INT AS n_distinct, coalesce(w[1], '') AS first FROM w")
def token_profiles(spark, d):
    w = _docs(spark, d, "text").select("id", T.tokens("text").alias("w"))
    return w.select("id", F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("n_distinct"), F.coalesce(F.get("w", F.lit(0)), F.lit("")).alias("first"))


@query("script_segments", r"""WITH c AS (SELECT doc_id AS id, text || CASE WHEN doc_id % 2 = 0 THEN ' 中文かなカナ한글' ELSE '' END AS text FROM documents),
s AS (SELECT id, regexp_extract_all(text, '\p{Han}+|\p{Hiragana}+|\p{Katakana}+|\p{Hangul}+|[^\s\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]+') AS s FROM c)
SELECT id, len(s)::INT AS n, s[len(s)] AS last, id % 2 = 0 AS has_cjk FROM s""")
def script_segments(spark, d):
    """Runs of one script; a text without any has no last one."""
    c = _docs(spark, d, "concat(text, if(doc_id % 2 = 0, ' 中文かなカナ한글', '')) AS text")
    s = c.select("id", T.cjk_segments("text").alias("s"), T.has_cjk("text").alias("has_cjk"))
    return s.select("id", F.size("s").alias("n"), F.try_element_at("s", F.lit(-1)).alias("last"), "has_cjk")


@query("redacted_secrets", r"""WITH c AS (SELECT doc_id AS id, text || ' key AKIA' || upper(substr(md5(doc_id::VARCHAR), 1, 16)) || ' then password: ' || md5(doc_id::VARCHAR) || ' end' AS text FROM documents)
SELECT id, regexp_replace(regexp_replace(text, 'AKIA[0-9A-Z]{16}', '<REDACTED:AWS_AKID>', 'g'), '(?i)(?:password|passwd|pwd)\s*[:=]\s*[''"]?[^\s''"<>]{8,}', '<REDACTED:PASSWORD_VAR>', 'g') AS text FROM c""")
def redacted_secrets(spark, d):
    c = _docs(spark, d, "concat(text, ' key AKIA', upper(substring(md5(cast(doc_id AS string)), 1, 16)), ' then password: ', md5(cast(doc_id AS string)), ' end') AS text")
    return c.select("id", U.redacted(F.col("text"))["text"].alias("text"))


@query("blocker_texts", r"""WITH c AS (SELECT doc_id AS id, lower(text || ' at /srv/x' || doc_id || '/y line ' || doc_id) AS text FROM documents),
w AS (SELECT id, list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), lambda w: CASE WHEN contains(w, '/') THEN '<path>' WHEN regexp_full_match(w, '[0-9]+') THEN '<num>' ELSE w END) AS w FROM c)
SELECT id, md5(array_to_string(w, ' ')) AS blocker FROM w""")
def blocker_texts(spark, d):
    """Blockers that differ in paths and numbers alone are one."""
    return _docs(spark, d, "concat(text, ' at /srv/x', doc_id, '/y line ', doc_id) AS text").select("id", F.md5(T.normalised_blocker("text")).alias("blocker"))


@query("cluster_ids", """WITH m AS (SELECT source AS scope, list_sort(list(doc_id::VARCHAR)) AS ids FROM documents GROUP BY source),
b AS (SELECT scope, flatten(list_transform(ids, lambda i: list_append(list_transform(string_split(i, ''), lambda c: ascii(c)::UBIGINT), 0::UBIGINT))) AS bytes FROM m)
SELECT scope, 'auto-' || scope || '-' || lpad(lower(to_hex(list_reduce(list_prepend(2166136261::UBIGINT, bytes), lambda h, x: (xor(h, x) * 16777619::UBIGINT) % 4294967296::UBIGINT))), 8, '0') AS cluster FROM b""")
def cluster_ids(spark, d):
    """A cluster is the documents of a source; members of one cluster are one row's list."""
    g = _docs(spark, d, "source").groupBy(F.col("source").alias("scope")).agg(F.collect_list(F.col("id").cast("string")).alias("ids"))
    return g.select("scope", U.cluster_id(F.col("scope"), F.col("ids")).alias("cluster"))


@query("resolution_flags", "SELECT doc_id AS id, doc_id % 3 = 0 AS resolved FROM documents WHERE NOT regexp_matches(lower(text), '(fixed|solved|resolved|works now|working now|done|figured|that worked|no longer)')")
def resolution_flags(spark, d):
    c = _docs(spark, d, "text", "concat(text, if(doc_id % 3 = 0, ' It was fixed.', ' It is fixedly open.')) AS more")
    return c.where("NOT lower(text) RLIKE '(fixed|solved|resolved|works now|working now|done|figured|that worked|no longer)'").select("id", T.resolved("more").alias("resolved"))


@query("observation_types", "SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'file_edit' WHEN 'view' THEN 'file_read' WHEN 'signup' THEN 'command_run' WHEN 'purchase' THEN 'conversation' ELSE 'error' END AS type FROM events")
def observation_types(spark, d):
    """Tools that tell their kind by name, and events that only the hook tells."""
    e = B.table(spark, d, "events").selectExpr("event_id AS id", "CASE event_type WHEN 'click' THEN 'Multi_Edit' WHEN 'view' THEN 'Read' WHEN 'signup' THEN 'bash' WHEN 'purchase' THEN '' END AS tool", "CASE event_type WHEN 'error' THEN 'on_error' WHEN 'purchase' THEN 'user_prompt' ELSE 'x' END AS hook")
    return e.select("id", T.observation_type(F.col("tool"), F.col("hook")).alias("type"))


@query("observation_fingerprints", "SELECT event_id AS id, sha256(user_id || event_type || coalesce(props, '')) AS fingerprint FROM events")
def observation_fingerprints(spark, d):
    e = B.table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), T.fingerprint(F.col("user_id"), F.col("event_type"), F.col("props")).alias("fingerprint"))


@query("drawer_ids", "SELECT doc_id AS id, 'drawer_' || source || '_' || lang || '_' || substr(sha256('f' || (doc_id % 30) || doc_id), 1, 24) AS drawer FROM documents")
def drawer_ids(spark, d):
    r = B.drawers(spark, d)
    return r.select("id", T.drawer_id(F.col("wing"), F.col("room"), F.col("source_file"), F.col("id")).alias("drawer"))


@query("byte_cuts", "SELECT doc_id AS id, substr(text, 1, list_max(list_filter(range(0, 65), lambda n: strlen(substr(text, 1, n::BIGINT)) <= 64))::BIGINT) AS text FROM documents")
def byte_cuts(spark, d):
    return _docs(spark, d, "text").select("id", T.truncate_bytes("text", 64).alias("text"))


@query("paragraph_blocks", r"""WITH b AS (SELECT doc_id AS id, string_split(text, chr(10)) AS rows, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS blocks FROM documents),
g AS (SELECT id, CASE WHEN len(blocks) <= 1 AND len(rows) > 20 THEN list_transform(range(0, ceil(len(rows) / 25.0)::BIGINT), lambda k: array_to_string(rows[k * 25 + 1 : k * 25 + 25], chr(10))) ELSE blocks END AS blocks FROM b)
SELECT id, len(blocks)::INT AS n, md5(array_to_string(blocks, '|')) AS digest FROM g""")
def paragraph_blocks(spark, d):
    return _docs(spark, d, "text").select("id", T.paragraphs("text").alias("b")).select("id", F.size("b").alias("n"), F.md5(F.array_join("b", "|")).alias("digest"))


@query("markdown_compressed", r"SELECT doc_id AS id, md5(regexp_replace(regexp_replace(replace(text, chr(10), '  ' || repeat(chr(10), 4)) || '  ', '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM documents")
def markdown_compressed(spark, d):
    return _docs(spark, d, "concat(replace(text, '\n', concat('  ', repeat('\n', 4))), '  ') AS text").select("id", F.md5(T.markdown_compress("text")).alias("digest"))


@query("folder_rooms", """WITH f AS (SELECT page_id, string_split(lower(url), '/') AS parts FROM pages), k AS (SELECT page_id, list_filter(parts, lambda p: p IN ('en', 'fr', 'de', 'es')) AS k FROM f)
SELECT page_id, coalesce(CASE k[1] WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' WHEN 'es' THEN 'spanish' END, 'general') AS room FROM k""")
def folder_rooms(spark, d):
    known = spark.createDataFrame([("EN", "english"), ("fr", "french"), ("de", "german"), ("es", "spanish")], "folder string, room string")
    return I.rooms_of_folders(B.table(spark, d, "pages").selectExpr("page_id", "url AS path"), known).select("page_id", "room")


_ROOM_WORDS = {"src1": [], "english": ["the"], "german": ["und"]}


@query("room_of_paths", """WITH c AS (SELECT doc_id AS id, source, lower(substr(text, 1, 2000)) AS t FROM documents),
n AS (SELECT id, source, len(regexp_extract_all(t, 'src1')) AS a, len(regexp_extract_all(t, 'english')) + len(regexp_extract_all(t, 'the')) AS b, len(regexp_extract_all(t, 'german')) + len(regexp_extract_all(t, 'und')) AS c FROM c)
SELECT id, CASE WHEN source = 'src1' THEN 'src1' WHEN greatest(a, b, c) = 0 THEN 'general' WHEN a = greatest(a, b, c) THEN 'src1' WHEN b = greatest(a, b, c) THEN 'english' ELSE 'german' END AS room FROM n""")
def room_of_paths(spark, d):
    return _docs(spark, d, "concat('/data/', source, '/note.md') AS path", "text").select("id", I.room_of(F.col("path"), F.col("text"), _ROOM_WORDS).alias("room"))


_DICTIONARY = ("there", "that", "with", "from", "onion", "station", "then")


@query("spell_fixes", "WITH w AS (SELECT DISTINCT regexp_replace(unnest(string_split(text, ' ')), '[^A-Za-z]', '', 'g') AS word FROM benchmark), dict AS (SELECT unnest([" + ", ".join(f"'{w}'" for w in _DICTIONARY) + """]) AS known),
best AS (SELECT word, arg_min(known, (levenshtein(word, known), known)) AS fixed FROM w, dict WHERE NOT regexp_matches(word, '^[A-Z]') AND word NOT IN (SELECT known FROM dict) AND levenshtein(word, known) <= CASE WHEN length(word) <= 7 THEN 2 ELSE 3 END GROUP BY word)
SELECT word, coalesce(fixed, word) AS fixed FROM w LEFT JOIN best USING (word)""")
def spell_fixes(spark, d):
    @F.pandas_udf("string")
    def fixed(words: pd.Series) -> pd.Series:
        return words.map(lambda w: U.spell(w, _DICTIONARY))

    words = B.table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("word")).select(F.regexp_replace("word", "[^A-Za-z]", "").alias("word")).distinct()
    return words.select("word", fixed("word").alias("fixed"))


@query("tool_call_facts", "SELECT event_id AS id, 'path: src/a' || event_id || '.py; kind: ' || event_type || '; tags: x, y' AS facts, 'src/a' || event_id || '.py' AS files FROM events")
def tool_call_facts(spark, d):
    e = B.table(spark, d, "events").select(F.col("event_id").alias("id"), F.to_json(F.struct(F.concat(F.lit("src/a"), "event_id", F.lit(".py")).alias("path"), F.col("event_type").alias("kind"), F.array(F.lit("x"), F.lit("y")).alias("tags"))).alias("tool_input"))
    return I.facts(e).select("id", "facts", F.array_join("files", ",").alias("files"))


@query("variant_union", """WITH r AS (SELECT doc_id AS id, doc_id % 5 AS query_id, doc_id % 3 AS variant, 'f' || (doc_id % 30) AS source_file, md5(text) AS content, (doc_id * 37 % 101)::DOUBLE AS score FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_file, content ORDER BY variant, score DESC, id) AS n FROM r)
SELECT query_id, id, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM f WHERE n = 1) WHERE place <= 20""")
def variant_union(spark, d):
    r = _docs(spark, d, "doc_id % 5 AS query_id", "doc_id % 3 AS variant", "concat('f', doc_id % 30) AS source_file", "md5(text) AS content", "cast(doc_id * 37 % 101 AS double) AS score")
    return I.union_variants(r, 20).select("query_id", "id", "place")


@query("best_match_rooms", r"""WITH t AS (SELECT item_id AS id, 'r' || (item_id % 4) AS room, list_distinct(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS w FROM benchmark),
p AS (SELECT a.room AS room_a, b.room AS room_b, a.id, max(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE) AS best FROM t a JOIN t b ON a.room <> b.room GROUP BY ALL)
SELECT room_a, room_b, round(avg(best), 6) AS similarity FROM p GROUP BY ALL HAVING sum(best) > 0""")
def best_match_rooms(spark, d):
    t = B.table(spark, d, "benchmark").selectExpr("item_id AS id", "'w' AS wing", "concat('r', item_id % 4) AS room", "text AS content")
    return I.best_match_similarity(t).select("room_a", "room_b", F.round("similarity", 6).alias("similarity"))


@query("cross_rerank", """WITH r AS (SELECT doc_id AS id, doc_id % 5 AS query_id, (doc_id * 37 % 101)::DOUBLE AS score, 'q' || (doc_id % 5) || ' [SEP] ' || source || ' ' || text AS pair FROM documents)
SELECT query_id, id, length(pair)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS p FROM r) WHERE p <= 20""")
def cross_rerank(spark, d):
    """The caller's scorer over query and text; here the pair's length stands in for a model."""
    r = _docs(spark, d, "doc_id % 5 AS query_id", "concat('q', doc_id % 5) AS query", "source AS title", "text AS content", "cast(doc_id * 37 % 101 AS double) AS score")
    return I.rerank(r, lambda pairs: pairs.str.len().astype("float64")).select("query_id", "id", "score")


@query("cascade_invalidation", B.sql("triples", """,
r AS (SELECT 'c7' AS node, 0 AS depth UNION SELECT object, depth + 1 FROM r JOIN triples ON node = subject WHERE depth < 3 AND confidence >= 0.5)
SELECT node, 'invalidate' AS action FROM (SELECT node, min(depth) AS depth FROM r GROUP BY node) WHERE depth > 0 AND depth < 3"""))
def cascade_invalidation(spark, d):
    return I.cascade_updates(G.follow(B.triples(spark, d), spark.createDataFrame([("c7",)], "node string"), 3, 0.5), "supersede")


@query("branch_sessions", "SELECT DISTINCT user_id AS session_id FROM events WHERE user_id % 3 = 1")
def branch_sessions(spark, d):
    s = B.table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.array(F.concat(F.lit("branch:b"), F.col("user_id") % 3), F.lit("x")).alias("tags")).distinct()
    return I.branch_sessions(s, "b1").select("session_id")


@query("memories_with_scores", "SELECT m.doc_id AS memory_id, CASE WHEN m.doc_id % 3 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS retention, CASE WHEN m.doc_id % 3 = 0 THEN m.doc_id % 60 ELSE 0 END AS accesses FROM documents m")
def memories_with_scores(spark, d):
    m = _docs(spark, d).select(F.col("id").alias("memory_id"))
    scores = B.memories(spark, d).where("memory_id % 3 = 0").withColumn("retention_strength", F.lit(0.5))
    return L.with_scores(m, scores).select("memory_id", F.col("retention_strength").alias("retention"), F.col("access_count").cast("long").alias("accesses"))


@query("memory_projection", "SELECT doc_id AS memory_id, md5(text) AS content, lang AS kind, source AS project, (doc_id % 100)::DOUBLE / 100 AS confidence FROM documents")
def memory_projection(spark, d):
    return B.memories(spark, d).select("memory_id", F.md5("content").alias("content"), "kind", "project", "confidence")


@query("image_payloads", "SELECT event_id AS id, event_id % 4 < 3 AS has_image FROM events")
def image_payloads(spark, d):
    e = B.table(spark, d, "events").selectExpr("event_id AS id", "CASE event_id % 4 WHEN 0 THEN '{\"src\": \"data:image/png;base64,xx\"}' WHEN 1 THEN '{\"f\": \"shot.JPEG\"}' WHEN 2 THEN '{\"d\": \"iVBORw0KGgoAAA\"}' ELSE props END AS payload")
    return e.select("id", K.image_payload(F.col("payload")).alias("has_image"))


@query("claim_conflicts", """WITH c AS (SELECT c_custkey AS id, 'Subj' || chr((97 + c_custkey % 26)::INT) AS subject, CASE c_custkey % 3 WHEN 0 THEN 'boss' WHEN 1 THEN 'friend' ELSE 'cousin' END AS role, 'Obj' || chr((97 + c_custkey % 25)::INT) AS object FROM customer)
SELECT id, subject, role, object, CASE WHEN role = 'friend' THEN 'stale_fact' ELSE 'relationship_mismatch' END AS verdict FROM c WHERE role <> 'boss'""")
def claim_conflicts(spark, d):
    """Claims in texts against facts: every pair has an open fact ``boss`` and a closed one ``friend``."""
    name = lambda head, n: F.concat(F.lit(head), F.chr(97 + F.col("c_custkey") % n))
    c = B.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), name("Subj", 26).alias("s"), name("Obj", 25).alias("o"), F.element_at(F.array(F.lit("boss"), F.lit("friend"), F.lit("cousin")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("r"))
    texts = c.select("id", F.concat_ws(" ", F.lit("They say that"), "s", F.lit("is"), F.concat("o", F.lit("'s")), "r").alias("text"))
    pairs = c.select(F.col("s").alias("subject"), F.col("o").alias("object")).distinct()
    facts = pairs.select("*", F.lit("boss").alias("predicate"), F.lit(None).cast("timestamp").alias("valid_to")).union(pairs.select("*", F.lit("friend"), B.now()))
    return K.contradictions(K.claims(texts), facts)


@query("deleted_rows", "SELECT doc_id AS id FROM documents WHERE doc_id % 7 <> 0")
def deleted_rows(spark, d):
    rows = _docs(spark, d)
    return stores.delete_rows(rows, rows.where("id % 7 = 0"))


@query("version_import", "SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE md5(text) END AS content FROM documents UNION ALL SELECT -1 - doc_id, 'new' FROM documents WHERE doc_id % 5 = 0")
def version_import(spark, d):
    """Rows of an export merged in: those with a known key replace it, others are added."""
    rows = _docs(spark, d, "md5(text) AS content")
    fifth = rows.where("id % 5 = 0")
    return stores.import_rows(rows, fifth.selectExpr("id", "'new' AS content").union(fifth.selectExpr("-1 - id", "'new'")), "1.1", "merge")


@query("front_matter_notes", "SELECT doc_id AS id, md5('---' || chr(10) || 'id: ' || doc_id || chr(10) || 'wing: ' || source || chr(10) || '---' || chr(10) || chr(10) || text) AS note FROM documents")
def front_matter_notes(spark, d):
    return B.drawers(spark, d).select("id", F.md5(stores.front_matter("id", "wing")).alias("note"))


@query("tree_export_round_trip", "SELECT source AS wing, lang AS room, count(*) AS n, min(md5(text)) AS first, max(md5(text)) AS last FROM documents GROUP BY ALL")
def tree_export_round_trip(spark, d):
    """Drawers written to wing and room folders, and read back from there (a line ends a row, so line ends are escaped)."""
    path = shared_dir(spark, "tree")
    stores.tree_export(B.drawers(spark, d).withColumn("content", F.to_json(F.struct("content"))), path)
    back = spark.read.format("text").load(path).select("wing", "room", F.get_json_object("value", "$.content").alias("content"))
    return back.groupBy("wing", "room").agg(F.count(F.lit(1)).alias("n"), F.min(F.md5("content")).alias("first"), F.max(F.md5("content")).alias("last"))


@query("markdown_export_round_trip", "SELECT 'f' || (doc_id % 30) AS source_file, count(*) AS n FROM documents GROUP BY ALL")
def markdown_export_round_trip(spark, d):
    path = shared_dir(spark, "markdown")
    stores.markdown_export(B.drawers(spark, d).withColumn("content", F.md5("content")).withColumn("filed_at", F.col("id")), path)
    return spark.read.format("text").load(path).where("value LIKE '## %'").groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))


@query("snapshot_round_trip", "SELECT doc_id AS id, md5(text) AS content FROM documents")
def snapshot_round_trip(spark, d):
    path = shared_dir(spark, "snapshot")
    stores.save_snapshot(_docs(spark, d, "md5(text) AS content"), path, 3)
    return stores.load_snapshot(spark, path, 3)


@query("whole_generations", "SELECT vec_id % 4 AS shard, count(*) AS n FROM embeddings GROUP BY ALL")
def whole_generations(spark, d):
    """Vector shards of three generations, the newest of them not whole: what is read is the second."""
    shards = B.table(spark, d, "embeddings").selectExpr("vec_id % 4 AS shard").groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    manifest = shards.select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("generation"), "shard", F.lit(4).alias("n_shards"), "n").where("generation < 3 OR shard < 2")
    return stores.latest_generation(manifest).where("generation = 2").select("shard", "n")


@query("corrupt_ids", "SELECT doc_id AS id FROM documents WHERE doc_id % 10 IN (0, 5)")
def corrupt_ids(spark, d):
    rows = _docs(spark, d, "CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 10 <> 5 THEN cast(doc_id AS string) END AS key")
    return stores.corrupt_ids(rows, "key").select("id")


@query("ignore_rules", r"WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/', '') AS p FROM pages) SELECT page_id, (regexp_matches(p, '^(?:.*/)?[^/]*\.html(?:/.*)?$') OR regexp_matches(p, '^(?:.*/)?fr/.*$')) AND NOT regexp_matches(p, '^(?:.*/)?1[^/]*\.html(?:/.*)?$') AS ignored FROM p")
def ignore_rules(spark, d):
    p = B.table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]*/", "").alias("p"))
    return p.select("page_id", files.ignored(F.col("p"), ["# pages", "*.html", "fr/", "!1*.html"]).alias("ignored"))


def _plain(name: str):
    """A time without zone, as the tables have it."""
    return F.col(name).cast("timestamp_ntz").alias(name)


@query("saturation_hours", """SELECT date_trunc('hour', ts) AS start, count(*) FILTER (event_type = 'view') AS messages, count(*) FILTER (event_type = 'click') AS actions, count(*) FILTER (event_type = 'error') AS blockers,
count(*) FILTER (event_type = 'view') / greatest(1, count(*) FILTER (event_type = 'click'))::DOUBLE AS chatter FROM events GROUP BY ALL""")
def saturation_hours(spark, d):
    e = B.table(spark, d, "events").selectExpr("ts", "CASE event_type WHEN 'view' THEN 'message' WHEN 'click' THEN 'action' WHEN 'error' THEN 'blocker' ELSE event_type END AS event_type")
    return S.saturation_windows(e).select(_plain("start"), "messages", "actions", "blockers", "chatter")


@query("sliding_type_counts", """WITH w AS (SELECT event_type, unnest(list_transform(range(0, 6), lambda k: time_bucket(INTERVAL 10 MINUTES, ts) - to_minutes((10 * k)::BIGINT))) AS start FROM events)
SELECT start, start + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n FROM w GROUP BY ALL""")
def sliding_type_counts(spark, d):
    return S.sliding_counts(B.table(spark, d, "events").select("ts", "event_type")).select(_plain("start"), _plain("end"), "event_type", "n")


@query("agent_sessions", """WITH e AS (SELECT user_id AS agent_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTES AS gap FROM events),
s AS (SELECT agent_id, ts, sum(coalesce(gap, true)::INT) OVER (PARTITION BY agent_id ORDER BY ts) AS k FROM e)
SELECT agent_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS "end", count(*) AS n FROM s GROUP BY agent_id, k""")
def agent_sessions(spark, d):
    return S.sessions(B.table(spark, d, "events").selectExpr("user_id AS agent_id", "ts")).select("agent_id", _plain("start"), _plain("end"), "n")


def _streamed(spark, d, columns: list[str], operator, mode: str):
    """The rows that a stream over the events gives until it has read them all, from its own table of results."""
    path, checkpoint = shared_dir(spark, "stream"), shared_dir(spark, "checkpoint")
    table = f"{d}/events.parquet"
    source = spark.readStream.schema(spark.read.parquet(table).schema).parquet(f"{table}*").selectExpr(*columns)
    out = operator(source).writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    out.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


@query("stream_access_log", "SELECT user_id AS memory_id, count(*) AS n, least(count(*), 20)::INT AS n_recent FROM events GROUP BY ALL")
def stream_access_log(spark, d):
    return _streamed(spark, d, ["user_id AS memory_id", "ts"], S.access_log, "update").groupBy("memory_id").agg(F.max("n").alias("n"), F.max_by("n_recent", "n").alias("n_recent"))


@query("stream_follow_ups", """WITH s AS (SELECT user_id AS agent_id, ts, event_id % 7 AS r, event_id % 5 AS q FROM events), w AS (SELECT *, lag(ts) OVER o AS pt, lag(r) OVER o AS pr, lag(q) OVER o AS pq FROM s WINDOW o AS (PARTITION BY agent_id ORDER BY ts, r, q))
SELECT agent_id, count(*) FILTER (pt IS NOT NULL AND epoch(ts) - epoch(pt) <= 86400 AND r NOT IN (pr, pq) AND q NOT IN (pr, pq)) AS follow_ups, count(*) AS n FROM w GROUP BY ALL""")
def stream_follow_ups(spark, d):
    found = _streamed(spark, d, ["user_id AS agent_id", "ts", "array(event_id % 7, event_id % 5) AS result_ids"], lambda s: S.follow_ups(s, 86400), "append")
    return found.groupBy("agent_id").agg(F.count_if("is_follow_up").alias("follow_ups"), F.count(F.lit(1)).alias("n"))


def _in_runs(spark, rows, operator):
    """What a stream gives that is stopped and taken up again: ``rows`` (with ``ts``) come six days at a time, as ``part`` says; two rows of a far day let all out."""
    last = rows.drop("part").where("false")
    far = [spark.sql(f"SELECT TIMESTAMP '2200-01-0{k} 00:00:00' AS ts") for k in (1, 2)]
    source, checkpoint, out = (shared_dir(spark, what) for what in ("parts", "checkpoint", "stream"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, S.ROCKSDB)
    try:
        for part in [*(rows.where(F.col("part") == k).drop("part") for k in range(6)), *(last.unionByName(f, allowMissingColumns=True) for f in far)]:  # thirty days, whatever the table's size
            part.write.mode("append").parquet(source)
            found = operator(spark.readStream.schema(last.schema).parquet(source))
            found.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(found.schema).parquet(f"{out}/*")


#: The part of its stream that an event comes in: that of its six days, or for a tenth of them the next.
_PART = "floor(datediff(ts, DATE '2024-01-01') / 6) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS part"


@query("stream_window_dedup", """WITH RECURSIVE e AS (SELECT user_id % 40 AS session_id, event_type AS h, ts FROM events),
f AS (SELECT session_id, h, min(ts) AS t FROM e GROUP BY ALL UNION ALL SELECT f.session_id, f.h, min(e.ts) FROM f JOIN e ON e.session_id = f.session_id AND e.h = f.h AND e.ts > f.t + INTERVAL 2 DAY GROUP BY f.session_id, f.h, f.t)
SELECT session_id, n, fresh FROM (SELECT session_id, count(*) AS n FROM e GROUP BY ALL) JOIN (SELECT session_id, count(*) AS fresh FROM f GROUP BY ALL) USING (session_id)""")
def stream_window_dedup(spark, d):
    """The rolling rule over a stream in several runs."""
    rows = B.table(spark, d, "events").selectExpr("user_id % 40 AS session_id", "event_type AS content", "ts", _PART)
    said = _in_runs(spark, rows, lambda s: S.dedup_rolling(s, seconds=2 * 86_400, late="13 days")).where("session_id IS NOT NULL")
    return said.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("fresh").alias("fresh"))


_SAYS = "CASE event_type WHEN 'click' THEN 'Hello, I am available' WHEN 'signup' THEN 'working on it' ELSE 'done' END AS content"
_UNCLAIMED = "SELECT user_id AS agent_id, count(*) AS n FROM events e WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'signup' AND c.user_id = e.user_id AND c.ts BETWEEN e.ts - INTERVAL 6 HOUR AND e.ts + INTERVAL 6 HOUR) GROUP BY user_id"


@query("unclaimed_introductions", _UNCLAIMED)
def unclaimed_introductions(spark, d):
    """Introductions that no claim of the same agent came near."""
    rows = B.table(spark, d, "events").selectExpr("user_id AS agent_id", _SAYS, "ts")
    return C.unclaimed_introductions(rows, "6 hours").groupBy("agent_id").agg(F.count(F.lit(1)).alias("n"))


@query("stream_unclaimed_introductions", _UNCLAIMED)
def stream_unclaimed_introductions(spark, d):
    """The same from a stream in several runs, by an outer join of the stream with itself; a tenth of the events come six days late."""
    rows = B.table(spark, d, "events").selectExpr("user_id AS agent_id", _SAYS, "ts", _PART)
    found = _in_runs(spark, rows, lambda s: C.unclaimed_introductions(s, "6 hours", "13 days"))
    return found.groupBy("agent_id").agg(F.count(F.lit(1)).alias("n"))


@query("stream_fingerprint_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_fingerprint_dedup(spark, d):
    return _streamed(spark, d, ["user_id", "event_type", "ts"], lambda s: S.dedup_fingerprint(s, "user_id", "event_type"), "append").select("user_id", "event_type")
