"""Lifecycle, session, coordination and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import decay as D
from tessera.functions import text as T
from tessera.operators import coordination as C
from tessera.operators import lifecycle as L
from tessera.plans import base as B
from tessera.plans.registry import query

_DAYS = f"(epoch({B.NOW}) - epoch({{0}})) / 86400.0"
_RET = f"greatest(0, least(1, retention_strength * exp(-decay_rate * {_DAYS.format('last_accessed')})))"


def _scored(spark, d):
    return L.retention(B.memories(spark, d), B.now())


@query("ebbinghaus_retention", B.sql("memories", f", r AS (SELECT memory_id, {_RET} AS retention FROM memories) SELECT memory_id, round(retention, 6) AS retention, CASE WHEN retention >= 0.9 THEN 'working' WHEN retention >= 0.7 THEN 'episodic' WHEN retention >= 0.5 THEN 'semantic' WHEN retention >= 0.3 THEN 'procedural' ELSE 'archived' END AS tier FROM r"))
def ebbinghaus_retention(spark, d):
    return _scored(spark, d).select("memory_id", F.round("retention", 6).alias("retention"), "tier")


@query("half_life_score", B.sql("memories", f" SELECT memory_id, round(CASE WHEN is_latest THEN confidence * pow(2.0, -({_DAYS.format('created_at')}) / 30.0) * (1 + 0.1 * ln(access_count + 1)) ELSE 0 END, 6) AS score FROM memories"))
def half_life_score(spark, d):
    m = B.memories(spark, d)
    s = D.half_life_score(F.col("confidence"), L.days_since("created_at", B.now()), F.lit(30.0), F.col("access_count"), F.col("is_latest"))
    return m.select("memory_id", F.round(s, 6).alias("score"))


@query("decay_formulas", B.sql("memories", f" SELECT memory_id, round(greatest(0.1, strength * pow(0.9, floor({_DAYS.format('created_at')} / 30.0))), 6) AS periodic, round(greatest(0.05, confidence - 0.02 * floor({_DAYS.format('created_at')} / 7)), 6) AS weekly, CASE WHEN access_count >= 50 THEN 0.5 WHEN access_count >= 20 THEN 0.7 WHEN access_count >= 5 THEN 0.85 ELSE 1.0 END::DOUBLE AS multiplier FROM memories"))
def decay_formulas(spark, d):
    days = L.days_since("created_at", B.now())
    return B.memories(spark, d).select("memory_id", F.round(D.periodic(F.col("strength"), days, F.lit(30.0)), 6).alias("periodic"), F.round(D.weekly(F.col("confidence"), F.lit(0.02), days), 6).alias("weekly"), D.frequency_multiplier(F.col("access_count")).cast("double").alias("multiplier"))


@query("eviction_priority", B.sql("memories", f" SELECT memory_id, round(least(1.0, 0.4 * {_RET} + 0.3 * least(access_count / 100.0, 1.0) + 0.3 * exp(-0.1 * {_DAYS.format('last_accessed')}) + CASE WHEN is_latest THEN 0.1 ELSE 0 END), 6) AS priority FROM memories"))
def eviction_priority(spark, d):
    p = D.eviction_priority(F.col("retention"), F.col("access_count"), L.days_since("last_accessed", B.now()), F.col("is_latest"))
    return _scored(spark, d).select("memory_id", F.round(p, 6).alias("priority"))


for _strategy, _key in (("lru", "last_accessed"), ("lfu", "access_count"), ("lowest_retention", "round(retention, 9)"), ("oldest", "created_at")):

    @query(f"evict_{_strategy}", B.sql("memories", f", r AS (SELECT *, {_RET} AS retention FROM memories) SELECT memory_id FROM r WHERE retention < 0.9 ORDER BY {_key}, memory_id LIMIT 25"))
    def evict(spark, d, strategy=_strategy):
        s = _scored(spark, d)
        return L.eviction_candidates(s.withColumn("retention", F.round("retention", 9)) if strategy == "lowest_retention" else s, strategy, 25).select("memory_id")


@query("forget_verdicts", B.sql("memories", f", r AS (SELECT *, {_RET} AS retention FROM memories) SELECT memory_id, CASE WHEN forget_after <= {B.NOW} THEN 'expired' WHEN retention < 0.1 THEN 'low_retention' WHEN access_count = 0 AND {_DAYS.format('last_accessed')} > 90 THEN 'never_accessed' ELSE 'keep' END AS verdict FROM r"))
def forget_verdicts(spark, d):
    return L.forget(_scored(spark, d), B.now()).select("memory_id", "verdict")


@query("governance_filter", B.sql("memories", f" SELECT memory_id FROM memories WHERE {_DAYS.format('created_at')} >= 100 AND strength >= 0.5 AND kind = 'en' AND project = 'src7'"))
def governance_filter(spark, d):
    return B.memories(spark, d).where((L.days_since("created_at", B.now()) >= 100) & (F.col("strength") >= 0.5) & (F.col("kind") == "en") & (F.col("project") == "src7")).select("memory_id")


@query("recent_memories", B.sql("memories", " SELECT memory_id, confidence FROM memories ORDER BY confidence DESC, created_at DESC, memory_id LIMIT 20"))
def recent_memories(spark, d):
    return B.memories(spark, d).orderBy(F.desc("confidence"), F.desc("created_at"), "memory_id").limit(20).select("memory_id", "confidence")


@query("most_accessed", B.sql("memories", " SELECT memory_id, access_count FROM memories ORDER BY access_count DESC, memory_id LIMIT 10"))
def most_accessed(spark, d):
    return B.memories(spark, d).orderBy(F.desc("access_count"), "memory_id").limit(10).select("memory_id", "access_count")


@query("recently_accessed", B.sql("memories", " SELECT memory_id FROM memories ORDER BY last_accessed DESC, memory_id LIMIT 10"))
def recently_accessed(spark, d):
    return B.memories(spark, d).orderBy(F.desc("last_accessed"), "memory_id").limit(10).select("memory_id")


@query("evolve_memory", B.sql("memories", " SELECT memory_id::VARCHAR AS memory_id, version, is_latest AND NOT (memory_id % 10 = 3) AS is_latest FROM memories UNION ALL SELECT memory_id || '-v2', 2, true FROM memories WHERE is_latest AND memory_id % 10 = 3"))
def evolve_memory(spark, d):
    m = B.memories(spark, d).withColumn("memory_id", F.col("memory_id").cast("string")).withColumn("supersedes", F.array().cast("array<string>"))
    changes = B.memories(spark, d).where("memory_id % 10 = 3").select(F.col("memory_id").cast("string").alias("memory_id"), F.lit("new").alias("content"))
    return L.evolve(m, changes).select("memory_id", "version", "is_latest")


@query("upsert_drawers", "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END AS version FROM documents")
def upsert_drawers(spark, d):
    old = B.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(1).alias("version"))
    return L.upsert(old, old.where("id % 4 = 0").withColumn("version", F.lit(2)), "id", "version")


@query("story_packing", B.sql("drawers", ", t AS (SELECT * FROM drawers ORDER BY importance DESC, id LIMIT 15), s AS (SELECT room, id, length(substr(content, 1, 200)) AS n, sum(length(substr(content, 1, 200))) OVER (ORDER BY room, id ROWS UNBOUNDED PRECEDING) AS running FROM t) SELECT room, id, running::BIGINT AS running FROM s WHERE running <= 1500"))
def story_packing(spark, d):
    """The 15 most important drawers by room, as long as 1500 characters last."""
    top = B.drawers(spark, d).orderBy(F.desc("importance"), "id").limit(15).select(F.lit(0).alias("g"), "room", "id", F.length(F.substring("content", 1, 200)).cast("long").alias("n"))
    return L.fit_prefix(top, "g", [F.col("room"), F.col("id")], "n", 1500).select("room", "id", "running")


@query("sliding_window", B.sql("observations", """, e AS (SELECT * FROM observations WHERE importance >= 3 AND floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(ts)) <= 864000),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) AS k FROM e QUALIFY k <= 20), t AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT session_id, id FROM t WHERE run <= 1000"""))
def sliding_window(spark, d):
    last = B.table(spark, d, "events").agg(F.max("ts")).first()[0]
    return L.sliding_window(B.observations(spark, d), "session_id", F.lit(last), hours=240, tokens=1000).select("session_id", "id")


@query("timeline_anchor", B.sql("observations", """, a AS (SELECT ts AS t0, id AS i0 FROM observations WHERE contains(title, 'error') ORDER BY ts, id LIMIT 1)
SELECT id FROM (SELECT id FROM observations, a WHERE (ts, id) < (t0, i0) ORDER BY ts DESC, id DESC LIMIT 3) UNION ALL SELECT id FROM (SELECT id FROM observations, a WHERE (ts, id) >= (t0, i0) ORDER BY ts, id LIMIT 6)"""))
def timeline_anchor(spark, d):
    return L.around(B.observations(spark, d), F.col("title").contains("error"), 3, 5).select("id")


@query("session_list", "SELECT user_id AS session_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n FROM events GROUP BY user_id")
def session_list(spark, d):
    return B.table(spark, d, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count(F.lit(1)).alias("n"))


@query("observations_capped", B.sql("observations", " SELECT session_id, id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) AS k FROM observations) WHERE k <= 5"))
def observations_capped(spark, d):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("id")))
    return B.observations(spark, d).withColumn("k", k).where("k <= 5").select("session_id", "id")


@query("access_log", "WITH a AS (SELECT user_id AS memory_id, ts, event_id FROM events) SELECT memory_id, count(*) AS n, max(ts) AS last_at FROM a GROUP BY memory_id")
def access_log(spark, d):
    return B.table(spark, d, "events").groupBy(F.col("user_id").alias("memory_id")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_at"))


@query("unblocked_actions", B.sql("actions,action_edges", " SELECT action_id FROM actions a WHERE NOT EXISTS (SELECT 1 FROM action_edges e JOIN actions x ON x.action_id = e.depends_on WHERE e.action_id = a.action_id AND x.status NOT IN ('done', 'completed', 'cancelled'))"))
def unblocked_actions(spark, d):
    return C.unblocked(B.actions(spark, d), B.action_edges(spark, d)).select("action_id")


@query("action_frontier", B.sql("actions,action_edges,leases", f""",
f AS (SELECT * FROM actions a WHERE status NOT IN ('completed', 'done', 'cancelled', 'blocked') AND NOT EXISTS (SELECT 1 FROM action_edges e JOIN actions x ON x.action_id = e.depends_on WHERE e.action_id = a.action_id AND x.status NOT IN ('done', 'completed', 'cancelled'))
  AND NOT EXISTS (SELECT 1 FROM leases l WHERE l.action_id = a.action_id AND agent_id <> 'a1' AND expires_at > {B.NOW}))
SELECT action_id, round((5 - priority) * 10 + least((epoch({B.NOW}) - epoch(created_at)) / 3600.0 * 0.5, 20) + CASE WHEN status = 'in_progress' THEN 15 ELSE 0 END, 6)::DOUBLE AS score FROM f"""))
def action_frontier(spark, d):
    f = C.frontier(B.actions(spark, d), B.action_edges(spark, d), B.leases(spark, d), "a1", B.now())
    return f.select("action_id", F.round("score", 6).cast("double").alias("score"))


@query("completion_propagation", B.sql("actions,action_edges", ", a2 AS (SELECT action_id, CASE WHEN action_id % 4 = 0 THEN 'blocked' ELSE status END AS status FROM actions) SELECT action_id FROM a2 WHERE status = 'blocked' AND action_id IN (SELECT e.action_id FROM action_edges e JOIN a2 x ON x.action_id = e.depends_on GROUP BY e.action_id HAVING bool_and(x.status IN ('done', 'completed', 'cancelled')))"))
def completion_propagation(spark, d):
    a = B.actions(spark, d).withColumn("status", F.when(F.col("action_id") % 4 == 0, "blocked").otherwise(F.col("status")))
    return C.completed_by(a, B.action_edges(spark, d)).select("action_id")


@query("active_leases", B.sql("leases", f" SELECT action_id, agent_id FROM leases WHERE expires_at > {B.NOW}"))
def active_leases(spark, d):
    return C.active_leases(B.leases(spark, d), B.now()).select("action_id", "agent_id")


_HELD = ["event_id AS reservation_id", "concat_ws('/', 'src', concat('m', event_id % 6), CASE WHEN event_id % 4 > 0 THEN concat('f', event_id % 9, CASE WHEN event_id % 2 = 0 THEN '.rs' ELSE '.py' END) END) AS path", "concat('a', user_id % 5) AS agent_id", "event_id % 3 = 0 AS exclusive", "ts AS expires_at"]
_WANTED = ["CASE event_id % 5 WHEN 0 THEN concat('src/m', event_id % 7, '/f', event_id % 9, '.rs') WHEN 1 THEN concat('src/m', event_id % 7) WHEN 2 THEN concat('src/*/f', event_id % 9, '.*') WHEN 3 THEN concat('src/m', event_id % 7, '/f?.py/deeper') ELSE concat('docs/m', event_id % 7) END AS path", "concat('a', user_id % 5) AS agent_id", "event_id % 2 = 0 AS exclusive"]


@query("reservation_conflicts", f"""WITH h AS (SELECT {', '.join(_HELD)}, string_split(path, '/') AS hp FROM events WHERE event_type = 'click' AND event_id % 7 <> 3),
w AS (SELECT *, string_split(path, '/') AS wp FROM (SELECT DISTINCT {', '.join(_WANTED)} FROM events WHERE event_type = 'signup')),
j AS (SELECT w.path, w.agent_id, w.exclusive, reservation_id, CASE WHEN h.agent_id = w.agent_id THEN 'same_agent' ELSE 'conflict' END AS verdict, h.agent_id AS holder
  FROM w JOIN h ON (h.agent_id = w.agent_id OR h.exclusive OR w.exclusive) AND len(list_filter(range(1, least(len(hp), len(wp)) + 1), lambda i: NOT hp[i] GLOB wp[i])) = 0)
SELECT path, agent_id, exclusive, verdict, holder FROM j QUALIFY row_number() OVER (PARTITION BY path, agent_id, exclusive ORDER BY reservation_id) = 1""")
def reservation_conflicts(spark, d):
    """Files, folders and globs wanted against files and folders held: the first reservation in the way."""
    e = B.table(spark, d, "events")
    held = e.where("event_type = 'click'").selectExpr(*_HELD, "event_id % 7 <> 3 AS active")
    return C.conflicts(held, e.where("event_type = 'signup'").selectExpr(*_WANTED)).select("path", "agent_id", "exclusive", "verdict", "holder")


@query("action_list", B.sql("actions", " SELECT action_id, priority FROM actions WHERE project = 'p3' AND status = 'pending' ORDER BY priority, created_at DESC, action_id LIMIT 50"))
def action_list(spark, d):
    return B.actions(spark, d).where("project = 'p3' AND status = 'pending'").orderBy("priority", F.desc("created_at"), "action_id").limit(50).select("action_id", "priority")


@query("next_action", B.sql("actions,action_edges", " SELECT action_id FROM actions a WHERE project = 'p3' AND status <> 'done' AND NOT EXISTS (SELECT 1 FROM action_edges e JOIN actions x ON x.action_id = e.depends_on WHERE e.action_id = a.action_id AND x.status NOT IN ('done', 'completed', 'cancelled')) ORDER BY priority DESC, created_at, action_id LIMIT 1"))
def next_action(spark, d):
    a = B.actions(spark, d)
    return C.unblocked(a, B.action_edges(spark, d)).where("project = 'p3' AND status <> 'done'").orderBy(F.desc("priority"), "created_at", "action_id").limit(1).select("action_id")


_SAID = "CASE event_type WHEN 'error' THEN concat('cannot open /x/', event_id, ' ', user_id % 3) WHEN 'click' THEN 'Hello, I am new here' WHEN 'signup' THEN CASE WHEN user_id % 4 = 0 THEN 'Working on it' ELSE 'not mine' END ELSE CASE WHEN event_id % 5 = 0 THEN 'That is the same task again' ELSE 'done' END END"


@query("saturation_report", f"""WITH e AS (SELECT event_id, ts, user_id, user_id % 30 AS thread_id, CASE event_type WHEN 'error' THEN 'blocker' WHEN 'click' THEN 'message' WHEN 'signup' THEN 'claim' ELSE 'action' END AS event_type, {_SAID} AS content FROM events),
r AS (SELECT e.* FROM e WHERE ts > (SELECT max(ts) FROM events) - to_hours(240))
SELECT 'new_actions' AS detector, '' AS subject, count(*) AS n FROM r WHERE event_type = 'action' UNION ALL SELECT 'messages', '', count(*) FROM r WHERE event_type = 'message' UNION ALL SELECT 'claims', '', count(*) FROM r WHERE event_type = 'claim'
UNION ALL SELECT 'repeated_blocker', 'cannot open <path> <num>', count(*) FROM r WHERE event_type = 'blocker' HAVING count(*) >= 2
UNION ALL SELECT 'stale_thread', thread_id::VARCHAR, count(*) FROM r GROUP BY thread_id HAVING max(ts) < (SELECT max(ts) FROM events) - to_minutes(600)
UNION ALL SELECT 'duplicate_work', user_id::VARCHAR, count(*) FROM r WHERE contains(lower(content), 'same task') GROUP BY user_id
UNION ALL SELECT 'stale_introduction', user_id::VARCHAR, count(*) FROM r WHERE contains(content, 'Hello') AND user_id NOT IN (SELECT user_id FROM r WHERE content = 'Working on it') GROUP BY user_id HAVING count(*) >= 2""")
def saturation_report(spark, d):
    events = B.table(spark, d, "events")
    last = events.agg(F.max("ts")).first()[0]
    e = events.selectExpr("ts", "user_id AS agent_id", "user_id % 30 AS thread_id", "CASE event_type WHEN 'error' THEN 'blocker' WHEN 'click' THEN 'message' WHEN 'signup' THEN 'claim' ELSE 'action' END AS event_type", f"{_SAID} AS content")
    return C.saturation(e, F.lit(last), 240, 600)


@query("content_hashes", "SELECT doc_id AS id, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS hash, 'drawer_' || source || '_' || lang || '_' || substr(sha256('f' || (doc_id % 30) || '0'), 1, 24) AS drawer_id FROM documents")
def content_hashes(spark, d):
    return B.drawers(spark, d).select("id", T.content_hash("content").alias("hash"), T.drawer_id(F.col("wing"), F.col("room"), F.col("source_file"), F.lit(0)).alias("drawer_id"))


@query("token_estimates", "SELECT doc_id AS id, greatest(1, floor(len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) * 1.3))::BIGINT AS tokens FROM documents")
def token_estimates(spark, d):
    return B.drawers(spark, d).select("id", T.token_estimate("content").alias("tokens"))


@query("script_and_language", "SELECT doc_id AS id, CASE WHEN length(regexp_replace(text, '[^A-Za-zÀ-ɏ]', '', 'g')) * 2 > length(text) THEN 'latin' ELSE 'other' END AS script, 'en' AS language FROM documents")
def script_and_language(spark, d):
    return B.drawers(spark, d).select("id", T.dominant_script("content").alias("script"), T.language("content").alias("language"))


@query("bounded_slices", "WITH t AS (SELECT doc_id AS id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS x FROM documents) SELECT id, CASE WHEN length(x) <= 30 THEN 0 ELSE ceil(length(x) / 800.0) END::BIGINT AS slices, CASE WHEN length(x) <= 30 THEN '' ELSE substr(x, 801, 800) END AS second FROM t")
def bounded_slices(spark, d):
    s = T.slices("content")
    return B.drawers(spark, d).select("id", F.size(s).cast("long").alias("slices"), F.coalesce(F.try_element_at(s, F.lit(2)), F.lit("")).alias("second"))


@query("sentiment", "WITH w AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) SELECT id, sign(len(list_intersect(w, ['the', 'and', 'der'])) - len(list_intersect(w, ['of', 'to', 'die', 'und'])))::INT AS sentiment FROM w")
def sentiment(spark, d):
    return B.drawers(spark, d).select("id", T.sentiment("content", ("the", "and", "der"), ("of", "to", "die", "und")).alias("sentiment"))


@query("name_normalisers", "SELECT c_custkey AS id, regexp_replace(lower(c_name), '[ -]', '_', 'g') AS wing, replace(replace(lower(c_name), ' ', '_'), '''', '') AS entity FROM customer")
def name_normalisers(spark, d):
    return B.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.wing_name("c_name").alias("wing"), T.entity_id("c_name").alias("entity"))


@query("temporal_sanitiser", "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, NULL::VARCHAR AS month, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS instant FROM orders")
def temporal_sanitiser(spark, d):
    o = B.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), T.iso_temporal(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), T.iso_temporal(F.date_format("o_orderdate", "yyyy-MM")).alias("month"), T.iso_temporal(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).alias("instant"))


@query("topic_rooms", "WITH c AS (SELECT doc_id AS id, contains(lower(substr(text, 1, 3000)), 'thst')::INT + contains(lower(substr(text, 1, 3000)), 'erin')::INT AS a, contains(lower(substr(text, 1, 3000)), 'eau')::INT + contains(lower(substr(text, 1, 3000)), 'tion')::INT AS b FROM documents) SELECT id, CASE WHEN greatest(a, b) = 0 THEN 'general' WHEN a >= b THEN 'first' ELSE 'second' END AS room FROM c")
def topic_rooms(spark, d):
    return B.drawers(spark, d).select("id", T.topic_room("content", {"first": ("thst", "erin"), "second": ("eau", "tion")}).alias("room"))
