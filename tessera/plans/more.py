"""Listing, update and registry queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import aggregates as A
from tessera.operators import knowledge as K
from tessera.operators import lifecycle as L
from tessera.operators import retrieval as R
from tessera.plans import base as B
from tessera.plans.registry import query


@query("lesson_save", "WITH old AS (SELECT DISTINCT sha256(lang) AS fingerprint, lang AS content, 0.5::DOUBLE AS confidence, 1 AS reinforced FROM documents), new AS (SELECT sha256(source) AS fingerprint, min(source) AS content, 0.3::DOUBLE AS confidence, count(*) AS times FROM documents GROUP BY source UNION ALL SELECT sha256(lang), lang, 0.3, count(*) FROM documents GROUP BY lang) SELECT n.fingerprint, n.content, round(CASE WHEN o.content IS NOT NULL THEN least(1.0, o.confidence + 0.01 * times) ELSE least(1.0, n.confidence + 0.01 * (times - 1)) END, 6) AS confidence, (CASE WHEN o.content IS NOT NULL THEN o.reinforced + times ELSE times - 1 END)::BIGINT AS reinforced FROM new n LEFT JOIN old o USING (fingerprint)")
def lesson_save(spark, d):
    docs = B.table(spark, d, "documents")
    old = docs.select(F.col("lang").alias("content")).distinct().select(T.content_hash("content").alias("fingerprint"), "content", F.lit(0.5).alias("confidence"), F.lit(1).cast("long").alias("reinforced"))
    new = docs.select(F.col("source").alias("content"), F.lit(0.3).alias("confidence")).unionAll(docs.select("lang", F.lit(0.3)))
    return K.save_lessons(old, new, 0.01).withColumn("confidence", F.round("confidence", 6))


@query("lesson_decay_sweep", B.sql("memories", f", d AS (SELECT memory_id, greatest(0.05, confidence - 0.02 * floor((epoch({B.NOW}) - epoch(created_at)) / 86400.0 / 7)) AS c, memory_id % 3 AS r FROM memories) SELECT memory_id, round(c, 6) AS confidence, c <= 0.1 AND r = 0 AS deleted FROM d"))
def lesson_decay_sweep(spark, d):
    m = B.memories(spark, d).withColumn("reinforced", F.col("memory_id") % 3).withColumn("deleted", F.lit(False))
    return K.decay_sweep(m, L.days_since("created_at", B.now()), 0.02).select("memory_id", F.round("confidence", 6).alias("confidence"), "deleted")


@query("lesson_strengthen", B.sql("memories", " SELECT memory_id, round(CASE WHEN kind = 'en' AND memory_id % 5 <> 0 THEN least(1.0, confidence + 0.1) ELSE confidence END, 6) AS confidence FROM memories"))
def lesson_strengthen(spark, d):
    m = B.memories(spark, d).withColumn("reinforced", F.lit(0)).withColumn("deleted", F.col("memory_id") % 5 == 0)
    return K.strengthen(m, F.col("kind") == "en").select("memory_id", F.round("confidence", 6).alias("confidence"))


@query("typed_edges", B.sql("triples", ", e AS (SELECT DISTINCT subject, predicate, object FROM triples WHERE triple_id % 2 = 0 OR triple_id % 7 = 1) SELECT 'me_' || subject || '_' || predicate || '_' || object AS edge_id FROM e"))
def typed_edges(spark, d):
    t = B.triples(spark, d).select("triple_id", "subject", "predicate", "object", "weight")
    empty = t.limit(0).withColumn("edge_id", F.lit("")).drop("triple_id")
    first = K.link(empty, t.where("triple_id % 2 = 0").drop("triple_id"))
    return K.link(first, t.where("triple_id % 7 = 1").drop("triple_id")).select("edge_id")


@query("remove_links", B.sql("triples", " SELECT triple_id FROM triples WHERE (subject, predicate, object) NOT IN (SELECT (subject, predicate, object) FROM triples WHERE triple_id % 6 = 0)"))
def remove_links(spark, d):
    t = B.triples(spark, d)
    return K.unlink(t, t.where("triple_id % 6 = 0")).select("triple_id")


@query("explicit_tunnels", "WITH p AS (SELECT a.doc_id AS id, a.source || '/' || a.lang AS x, b.source || '/' || b.lang AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1) SELECT DISTINCT substr(sha256(least(x, y) || '|' || greatest(x, y)), 1, 16) AS tunnel_id FROM p")
def explicit_tunnels(spark, d):
    x = B.drawers(spark, d).select("id", "wing", "room")
    pairs = x.alias("a").join(x.alias("b"), F.col("b.id") == F.col("a.id") + 1)
    return pairs.select(K.tunnel_id(F.col("a.wing"), F.col("a.room"), F.col("b.wing"), F.col("b.room")).alias("tunnel_id")).distinct()


@query("file_context", B.sql("observations", " SELECT id, array_to_string(list_filter(files, lambda f: NOT (contains(f, 'f7') OR contains('f7', f))), ',') AS other_files FROM observations WHERE len(list_filter(files, lambda f: contains(f, 'f7') OR contains('f7', f))) > 0"))
def file_context(spark, d):
    return K.file_context(B.observations(spark, d), "f7").select("id", F.array_join("other_files", ",").alias("other_files"))


@query("bug_memories", B.sql("observations", " SELECT id FROM observations WHERE len(list_filter(files, lambda f: contains(f, 'f7') OR contains('f7', f))) > 0 AND len(list_filter(concepts, lambda c: contains(lower(c), 'error'))) > 0"))
def bug_memories(spark, d):
    return K.bug_memories(B.observations(spark, d), "f7", ("bug", "error")).select("id")


@query("observation_scores", """WITH o AS (SELECT event_id AS id, event_type AS tool, CASE event_id % 4 WHEN 0 THEN 'post_tool_use_failure' WHEN 1 THEN 'session_end' WHEN 2 THEN 'notification' ELSE 'other' END AS hook, event_id % 3 AS r, event_id % 5 AS files, event_id % 6 AS facts, event_id % 11 AS rated, event_id % 60 AS chars FROM events),
i AS (SELECT *, 0.5 + CASE hook WHEN 'post_tool_use_failure' THEN 0.3 WHEN 'session_end' THEN -0.1 WHEN 'notification' THEN 0.1 ELSE 0 END + CASE WHEN contains(tool, 'error') THEN 0.2 ELSE 0 END + CASE r WHEN 0 THEN 0.2 WHEN 1 THEN 0.05 ELSE 0 END
  + CASE WHEN files > 0 THEN 0.1 ELSE 0 END + CASE WHEN files > 2 THEN 0.05 ELSE 0 END + CASE WHEN facts >= 3 THEN 0.1 ELSE 0 END AS s FROM o)
SELECT id, round(greatest(0, least(1, s)), 6)::DOUBLE AS score, (CASE WHEN facts > 0 THEN 25 ELSE 0 END + CASE WHEN facts >= 3 THEN 10 ELSE 0 END + CASE WHEN chars >= 20 THEN 20 ELSE 0 END + CASE WHEN chars >= 50 THEN 5 ELSE 0 END
  + CASE WHEN length(tool) BETWEEN 5 AND 120 THEN 15 ELSE 0 END + CASE WHEN files > 0 THEN 15 ELSE 0 END + CASE WHEN rated BETWEEN 1 AND 10 THEN 10 ELSE 0 END)::INT AS quality FROM i""")
def observation_scores(spark, d):
    some = lambda n: f"transform(sequence(1, {n}), x -> cast(x AS string))"
    o = B.table(spark, d, "events").selectExpr(
        "event_id AS id", "event_type AS tool", "event_type AS title", "element_at(array('post_tool_use_failure', 'session_end', 'notification', 'other'), cast(event_id % 4 + 1 AS int)) AS hook",
        "element_at(array('An Exception came', 'completed', 'nothing'), cast(event_id % 3 + 1 AS int)) AS output", f"if(event_id % 5 = 0, array(), {some('greatest(1, event_id % 5)')}) AS files", f"if(event_id % 5 = 0, array(), {some('greatest(1, event_id % 5)')}) AS concepts",
        f"if(event_id % 6 = 0, array(), {some('greatest(1, event_id % 6)')}) AS facts", "repeat('x', cast(event_id % 60 AS int)) AS narrative", "event_id % 11 AS importance",
    )
    return K.quality(K.importance(o)).select("id", F.round("score", 6).alias("score"), "quality")


@query("corpus_origin", "WITH c AS (SELECT doc_id AS id, len(regexp_extract_all(lower(text), 'thst|eau')) * 1000.0 / greatest(1, length(text)) AS b, len(regexp_extract_all(text, '(?m)^(User|Assistant|Human|AI):')) * 1000.0 / greatest(1, length(text)) AS t FROM documents) SELECT id, CASE WHEN b >= 0.5 OR t >= 2 THEN 'ai_dialogue' ELSE 'document' END AS origin, round(CASE WHEN b >= 0.5 OR t >= 2 THEN least(0.95, 0.6 + 0.1 * (b + t)) ELSE 0.6 END, 5)::DOUBLE AS confidence FROM c")
def corpus_origin(spark, d):
    o = K.origin(B.table(spark, d, "documents"), ["thst", "eau"])
    return o.select(F.col("doc_id").alias("id"), "origin", F.round("confidence", 5).alias("confidence"))


@query("registry_lookup", "WITH w AS (SELECT DISTINCT n_name AS word FROM nation UNION SELECT r_name FROM region UNION SELECT 'nobody') SELECT word, CASE WHEN word IN (SELECT n_name FROM nation) THEN 'person' WHEN word IN (SELECT r_name FROM region) THEN 'project' ELSE 'unknown' END AS kind, word AS name FROM w")
def registry_lookup(spark, d):
    nation, region = B.table(spark, d, "nation"), B.table(spark, d, "region")
    words = nation.select(F.col("n_name").alias("word")).union(region.select("r_name")).union(spark.createDataFrame([("nobody",)], "word string")).distinct()
    people = nation.select(F.col("n_name").alias("name"), F.array().cast("array<string>").alias("aliases"))
    return K.registry_lookup(words, people, region.select(F.col("r_name").alias("name")), spark.createDataFrame([], "name string, kind string"))


@query("similar_names", "WITH n0 AS (SELECT DISTINCT split_part(text, ' ', 1) AS x FROM benchmark UNION SELECT DISTINCT split_part(text, ' ', 2) FROM benchmark), n AS (SELECT x FROM n0 WHERE regexp_matches(x, '^[A-Za-z]+$')) SELECT a.x AS word, b.x AS name, levenshtein(a.x, b.x)::INT AS distance FROM n a, n b WHERE levenshtein(a.x, b.x) BETWEEN 1 AND 2")
def similar_names(spark, d):
    """Names within two edits, met under their deletion variants."""
    b = B.table(spark, d, "benchmark").select(F.split("text", " ").alias("w"))
    names = b.select(F.col("w")[0].alias("name")).union(b.select(F.col("w")[1])).distinct().where(F.col("name").rlike("^[A-Za-z]+$"))
    return K.similar_names(names.withColumnRenamed("name", "word"), names)


@query("event_log_replay", "SELECT event_id AS sequence, event_type FROM events WHERE event_id >= 900")
def event_log_replay(spark, d):
    return K.replay(B.table(spark, d, "events").select(F.col("event_id").alias("sequence"), "event_type"), 900)


@query("event_log_compact", "SELECT user_id, max(event_id) AS sequence, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def event_log_compact(spark, d):
    return K.compact(B.table(spark, d, "events").select("user_id", F.col("event_id").alias("sequence"), "event_type"), "user_id")


@query("expired_checkpoints", "SELECT o_orderkey AS id, CASE WHEN o_orderdate <= TIMESTAMP '1998-01-01' THEN 'expired' ELSE 'active' END AS status FROM orders")
def expired_checkpoints(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("active").alias("status"), F.col("o_orderdate").alias("expires_at"))
    return K.expire(o, F.expr("TIMESTAMP '1998-01-01 00:00:00'")).select("id", "status")


@query("audit_filter", "SELECT event_id AS id FROM events WHERE event_type = 'purchase' AND ts >= (SELECT min(ts) FROM events) + to_days(1) ORDER BY ts DESC, event_id LIMIT 50")
def audit_filter(spark, d):
    e = B.table(spark, d, "events")
    start = e.agg(F.min("ts")).first()[0]
    return A.top_rows(e.where((F.col("event_type") == "purchase") & (F.col("ts") >= F.lit(start) + F.expr("INTERVAL 1 DAY"))), 50, F.desc("ts"), F.asc("event_id")).select(F.col("event_id").alias("id"))


@query("search_history_sweep", "SELECT event_id AS id FROM events WHERE event_type = 'view' AND ts >= (SELECT max(ts) FROM events) - to_days(3)")
def search_history_sweep(spark, d):
    e = B.table(spark, d, "events")
    last = e.agg(F.max("ts")).first()[0]
    return e.where((F.col("event_type") == "view") & (F.col("ts") >= F.lit(last) - F.expr("INTERVAL 3 DAYS"))).select(F.col("event_id").alias("id"))


@query("session_observations_by_project", B.sql("observations", ", s AS (SELECT DISTINCT session_id FROM observations WHERE project = 'p1') SELECT id, session_id FROM observations JOIN s USING (session_id)"))
def session_observations_by_project(spark, d):
    o = B.observations(spark, d)
    return o.join(o.where("project = 'p1'").select("session_id").distinct(), "session_id", "left_semi").select("id", "session_id")


@query("working_memory_eviction", B.sql("observations", ", s AS (SELECT session_id, id, tokens, round(0.5 * importance / 10.0 + 0.3 * (id % 10) / 10.0 + 0.2 * log2(id % 7 + 1) / 10, 9) AS score FROM observations), r AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS run FROM s) SELECT session_id, id FROM r WHERE run <= 1200"))
def working_memory_eviction(spark, d):
    from tessera.functions.decay import working_memory_score

    s = working_memory_score(F.col("importance") / 10.0, (F.col("id") % 10) / 10.0, F.col("id") % 7)
    o = B.observations(spark, d).withColumn("score", F.round(s, 9))
    return L.fit_prefix(o, "session_id", [F.desc("score"), F.asc("id")], "tokens", 1200).select("session_id", "id")


@query("flow_compression", B.sql("observations", ", k AS (SELECT * FROM observations WHERE importance >= 4 OR type IN ('decision', 'discovery', 'task')), r AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC ROWS UNBOUNDED PRECEDING) AS run FROM k) SELECT session_id, id FROM r WHERE run <= 2000"))
def flow_compression(spark, d):
    o = B.observations(spark, d).where("importance >= 4 OR type IN ('decision', 'discovery', 'task')")
    return L.fit_prefix(o, "session_id", [F.desc("ts"), F.desc("id")], "tokens", 2000).select("session_id", "id")


@query("memory_bridge", B.sql("memories", ", r AS (SELECT memory_id, 2 AS n, row_number() OVER (ORDER BY strength DESC, memory_id) AS k FROM memories WHERE is_latest AND project = 'src2') SELECT memory_id FROM r WHERE 2 * k <= 20"))
def memory_bridge(spark, d):
    """The strongest latest memories of a project, as long as 20 lines last."""
    m = B.memories(spark, d).where("is_latest AND project = 'src2'").orderBy(F.desc("strength"), "memory_id").limit(20).withColumn("lines", F.lit(2)).withColumn("g", F.lit(0))
    return L.fit_prefix(m, "g", [F.desc("strength"), F.asc("memory_id")], "lines", 20).select("memory_id")


@query("provenance_check", "WITH m AS (SELECT doc_id AS memory_id, (doc_id % 10)::DOUBLE / 10 AS strength, [doc_id + 1, doc_id + 2, doc_id * 3] AS refs FROM documents), r AS (SELECT memory_id, strength, unnest(refs) AS ref FROM m) SELECT memory_id, count(*) AS steps, count(d.doc_id) AS verified, round(count(d.doc_id) / count(*)::DOUBLE * any_value(strength), 6) AS confidence FROM r LEFT JOIN documents d ON d.doc_id = ref GROUP BY memory_id")
def provenance_check(spark, d):
    docs = B.table(spark, d, "documents").select("doc_id")
    m = docs.select(F.col("doc_id").alias("memory_id"), (F.col("doc_id") % 10 / 10.0).cast("double").alias("strength"), F.array(F.col("doc_id") + 1).alias("source_ids"), F.array(F.col("doc_id") + 2).alias("related_ids"), F.array(F.col("doc_id") * 3).alias("supersedes"))
    return L.provenance(m, docs.withColumnRenamed("doc_id", "id")).withColumn("confidence", F.round("confidence", 6))


@query("context_packing", B.sql("observations", ", o AS (SELECT session_id, id, tokens, importance, row_number() OVER (PARTITION BY session_id ORDER BY 10 - importance, id::VARCHAR) AS k FROM observations), r AS (SELECT session_id, 0 AS k, 0::BIGINT AS used, 0 AS n FROM (SELECT DISTINCT session_id FROM o) UNION ALL SELECT r.session_id, o.k, CASE WHEN used + tokens <= 1000 THEN used + tokens ELSE used END, CASE WHEN used + tokens <= 1000 THEN n + 1 ELSE n END FROM r JOIN o ON o.session_id = r.session_id AND o.k = r.k + 1) SELECT session_id, arg_max(n, k)::BIGINT AS chosen FROM r GROUP BY session_id"))
def context_packing(spark, d):
    o = B.observations(spark, d).select("session_id", (10 - F.col("importance")).alias("priority"), F.col("id").cast("string").alias("id"), "tokens")
    return L.pack_context(o, "session_id", "tokens", 1000).select("session_id", F.size("chosen").cast("long").alias("chosen"))


@query("diary_read", "SELECT doc_id AS id FROM documents WHERE lang = 'en' AND lower(source) = 'src3' ORDER BY doc_id DESC LIMIT 10")
def diary_read(spark, d):
    return B.drawers(spark, d).where((F.col("room") == "en") & (F.lower("wing") == "src3")).orderBy(F.desc("id")).limit(10).select("id")


@query("json_page", "SELECT doc_id AS id, true AS has_more FROM documents ORDER BY doc_id LIMIT 5 OFFSET 10")
def json_page(spark, d):
    from tessera.sources.stores import json_page as page

    p = page(B.drawers(spark, d).select("id", "wing"), "id", 10, 5)
    return p.select(F.get_json_object("json", "$.id").cast("long").alias("id"), "has_more")


@query("incremental_mine", "SELECT doc_id AS id FROM documents WHERE doc_id % 4 <> 0 OR doc_id % 3 = 0")
def incremental_mine(spark, d):
    from tessera.sources.stores import already_mined

    docs = B.table(spark, d, "documents")
    files = docs.select(F.col("doc_id").cast("string").alias("source_file"), F.col("n_chars").cast("double").alias("mtime"))
    held = docs.where("doc_id % 4 = 0").select(F.col("doc_id").cast("string").alias("source_file"), F.col("n_chars").cast("double").alias("mtime"), F.when(F.col("doc_id") % 3 == 0, 1).otherwise(2).alias("normalize_version"), F.lit(None).cast("string").alias("extract_mode"))
    return already_mined(files, held).select(F.col("source_file").cast("long").alias("id"))


@query("transcripts", "SELECT conv_id, sha256(string_agg(CASE WHEN role = 'user' THEN '> ' || replace(text, chr(10), chr(10) || '> ') ELSE text END, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def transcripts(spark, d):
    from tessera.sources.chats import render

    return render(B.table(spark, d, "conversations"), "conv_id").select("conv_id", F.sha2("transcript", 256).alias("digest"))


@query("message_sweep", "WITH m AS (SELECT conv_id AS session_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), c AS (SELECT session_id, max(turn) - 1 AS cursor FROM m WHERE session_id % 2 = 0 GROUP BY session_id) SELECT 'sweep_' || session_id || '_' || turn AS id FROM m LEFT JOIN c USING (session_id) WHERE cursor IS NULL OR turn >= cursor")
def message_sweep(spark, d):
    from tessera.sources import stores

    m = B.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("ts"), F.col("turn").cast("string").alias("uuid"))
    c = stores.cursors(m.where("cast(session_id AS long) % 2 = 0")).withColumn("cursor", F.col("cursor") - 1)
    return stores.sweep(m, c).select("id")


@query("noise_stripping", "SELECT doc_id AS id, length(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'))::INT AS n FROM documents")
def noise_stripping(spark, d):
    return B.drawers(spark, d).select("id", F.length(T.strip_noise("content")).alias("n"))


@query("reranked_by_source", "SELECT source AS wing, max(doc_id) AS id FROM documents GROUP BY source")
def reranked_by_source(spark, d):
    ranked = B.drawers(spark, d).select(F.lit(0).alias("query_id"), "id", F.col("id").cast("double").alias("score"), "wing")
    return R.max_per_source(ranked, "wing", 1).select("wing", "id")


@query("room_pairs_window", "SELECT lang AS room, array_to_string(list_sort(list(DISTINCT source)), ',') AS wings FROM documents GROUP BY lang")
def room_pairs_window(spark, d):
    return B.drawers(spark, d).groupBy("room").agg(F.array_join(F.sort_array(F.collect_set("wing")), ",").alias("wings"))


@query("latest_version_per_key", "SELECT o_custkey AS id, max(o_orderdate) AS at FROM orders GROUP BY o_custkey")
def latest_version_per_key(spark, d):
    o = B.table(spark, d, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return o.withColumn("p", place).where("p = 1").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("at"))
