"""Counts, profiles, patterns, set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import clusters as CL
from tessera.plans import base as B
from tessera.plans.registry import query


@query("count_by_wing", "SELECT source AS wing, count(*) AS n FROM documents GROUP BY source")
def count_by_wing(spark, d):
    return A.by_wing(B.drawers(spark, d))


@query("count_by_room", "SELECT lang AS room, count(*) AS n FROM documents WHERE source = 'src3' GROUP BY lang")
def count_by_room(spark, d):
    return A.by_room(B.drawers(spark, d), "src3")


@query("taxonomy", "SELECT source AS wing, lang AS room, count(*) AS n FROM documents GROUP BY ALL")
def taxonomy(spark, d):
    return A.taxonomy(B.drawers(spark, d))


@query("status", "SELECT 'wing' AS kind, source AS name, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'room', lang, count(*) FROM documents GROUP BY lang UNION ALL SELECT 'total', '', count(*) FROM documents")
def status(spark, d):
    return A.status(B.drawers(spark, d))


@query("filtered_count", "SELECT count(*) AS n FROM documents WHERE source = 'src1' AND lang = 'en'")
def filtered_count(spark, d):
    return B.drawers(spark, d).where("wing = 'src1' AND room = 'en'").agg(F.count(F.lit(1)).alias("n"))


@query("tag_counts", B.sql("observations", " SELECT tag, count(*) AS n FROM (SELECT unnest(concepts) AS tag FROM observations) GROUP BY tag"))
def tag_counts(spark, d):
    return A.tag_counts(B.observations(spark, d), "concepts")


@query("helpfulness", "WITH f AS (SELECT l.doc_id AS drawer_id, CASE WHEN quality = 1 THEN 'helpful' ELSE 'unhelpful' END AS outcome FROM labels l UNION ALL SELECT doc_id, CASE WHEN toxic = 1 THEN 'unhelpful' ELSE 'other' END FROM labels), g AS (SELECT drawer_id, count(*) FILTER (outcome = 'helpful') AS h, count(*) FILTER (outcome = 'unhelpful') AS u FROM f GROUP BY drawer_id) SELECT drawer_id, round(CASE WHEN h + u = 0 THEN 1.0 ELSE 0.5 + h / (h + u)::DOUBLE END, 6) AS score FROM g")
def helpfulness(spark, d):
    labels = B.table(spark, d, "labels")
    f = labels.selectExpr("doc_id AS drawer_id", "CASE WHEN quality = 1 THEN 'helpful' ELSE 'unhelpful' END AS outcome").unionAll(labels.selectExpr("doc_id", "CASE WHEN toxic = 1 THEN 'unhelpful' ELSE 'other' END"))
    return A.helpfulness(f).withColumn("score", F.round("score", 6))


@query("feedback_list", "SELECT doc_id AS drawer_id, CASE WHEN quality = 1 THEN 'helpful' ELSE 'unhelpful' END AS outcome FROM labels")
def feedback_list(spark, d):
    return B.table(spark, d, "labels").selectExpr("doc_id AS drawer_id", "CASE WHEN quality = 1 THEN 'helpful' ELSE 'unhelpful' END AS outcome")


@query("co_change_patterns", B.sql("observations", ", p AS (SELECT DISTINCT session_id, least(files[1], files[2]) AS file_a, greatest(files[1], files[2]) AS file_b FROM observations) SELECT file_a, file_b, count(*) AS sessions FROM p GROUP BY ALL HAVING count(*) >= 2"))
def co_change_patterns(spark, d):
    return A.co_changes(B.observations(spark, d), 2)


@query("error_repeats", B.sql("observations", ", e AS (SELECT * FROM observations WHERE type = 'error'), f AS (SELECT title, unnest(files) AS f FROM e) SELECT title, count(*) AS n, (SELECT array_to_string(list_sort(list(DISTINCT f)), ',') FROM f WHERE f.title = e.title) AS files FROM e GROUP BY title HAVING count(*) >= 2"))
def error_repeats(spark, d):
    return A.error_repeats(B.observations(spark, d).where("type = 'error'")).withColumn("files", F.array_join("files", ","))


@query("concept_index", B.sql("observations", " SELECT DISTINCT unnest(concepts) AS concept, id FROM observations"))
def concept_index(spark, d):
    return A.concept_index(B.observations(spark, d))


@query("file_history", B.sql("observations", ", e AS (SELECT session_id, ts, unnest(files) AS path FROM observations) SELECT path, count(*) AS entries, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT session_id) AS sessions FROM e GROUP BY path"))
def file_history(spark, d):
    return A.file_history(B.observations(spark, d))


@query("most_active_files", B.sql("observations", ", e AS (SELECT unnest(files) AS path FROM observations) SELECT path, count(*) AS entries FROM e GROUP BY path ORDER BY entries DESC, path LIMIT 10"))
def most_active_files(spark, d):
    return A.file_history(B.observations(spark, d)).select("path", "entries").orderBy(F.desc("entries"), "path").limit(10)


@query("signal_threads", "SELECT user_id % 50 AS thread_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS senders FROM events GROUP BY 1")
def signal_threads(spark, d):
    return A.signal_threads(B.table(spark, d, "events").selectExpr("user_id % 50 AS thread_id", "event_type AS from_agent"))


@query("reservation_heatmap", "WITH r AS (SELECT 'p' || (event_id % 17) AS path, 'a' || (user_id % 9) AS agent_id, event_type <> 'error' AS active, event_id % 2 = 0 AS exclusive FROM events) SELECT path, count(*) FILTER (active) AS active, count(*) FILTER (active AND exclusive) AS exclusive, count(*) FILTER (active AND NOT exclusive) AS shared, count(DISTINCT agent_id) AS agents FROM r GROUP BY path")
def reservation_heatmap(spark, d):
    r = B.table(spark, d, "events").selectExpr("concat('p', event_id % 17) AS path", "concat('a', user_id % 9) AS agent_id", "event_type <> 'error' AS active", "event_id % 2 = 0 AS exclusive")
    return A.reservation_heatmap(r)


def _facets(spark, d):
    docs = B.table(spark, d, "documents")
    return docs.selectExpr("doc_id AS target_id", "'lang' AS dimension", "lang AS value").unionAll(docs.selectExpr("doc_id", "'source'", "source"))


_FACETS = "WITH facets AS (SELECT doc_id AS target_id, 'lang' AS dimension, lang AS value FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents)"


@query("facet_stats", _FACETS + " SELECT dimension, value, count(*) AS n FROM facets GROUP BY ALL")
def facet_stats(spark, d):
    return A.facet_stats(_facets(spark, d))


@query("facet_dimensions", _FACETS + " SELECT dimension, count(*) AS n FROM facets GROUP BY dimension")
def facet_dimensions(spark, d):
    return _facets(spark, d).groupBy("dimension").agg(F.count(F.lit(1)).alias("n"))


@query("facet_query", "SELECT doc_id AS target_id FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2')")
def facet_query(spark, d):
    return A.facet_query(_facets(spark, d), ["lang:en"], ["source:src1", "source:src2"])


@query("facet_get", _FACETS + " SELECT dimension, value FROM facets WHERE target_id = 5")
def facet_get(spark, d):
    return _facets(spark, d).where("target_id = 5").select("dimension", "value")


@query("cluster_centroids", "WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings), m AS (SELECT label, p, avg(x::DOUBLE) AS m FROM e GROUP BY ALL), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, round(sum(m * p), 4) AS weighted, any_value(n) AS n FROM m JOIN n USING (label) GROUP BY label")
def cluster_centroids(spark, d):
    c = A.centroids(B.table(spark, d, "embeddings"))
    return c.select("label", F.round(F.aggregate(F.transform("centroid", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 4).alias("weighted"), "n")


_MEMBERS = "SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN user_id % 90 ELSE user_id % 600 END AS cluster_id, CASE WHEN event_id % 2 = 0 THEN event_id % 97 ELSE event_id % 977 END AS member_id FROM events"
_OVERLAPS = """s AS (SELECT cluster_id, count(*) AS z FROM m GROUP BY ALL), b AS (SELECT x.cluster_id AS a, y.cluster_id AS b, count(*) AS n FROM m x JOIN m y ON x.member_id = y.member_id AND x.cluster_id < y.cluster_id GROUP BY ALL),
o AS (SELECT a, b, n / least(p.z, q.z)::DOUBLE AS overlap FROM b JOIN s p ON p.cluster_id = a JOIN s q ON q.cluster_id = b WHERE n > {0} * least(p.z, q.z) + 1e-9)"""


def _members(spark, d):
    return B.table(spark, d, "events").selectExpr("CASE WHEN user_id % 3 = 0 THEN user_id % 90 ELSE user_id % 600 END AS cluster_id", "CASE WHEN event_id % 2 = 0 THEN event_id % 97 ELSE event_id % 977 END AS member_id")


@query("cluster_overlap", f"WITH m AS ({_MEMBERS}), {_OVERLAPS.format(0.1)} SELECT a, b, round(overlap, 6) AS overlap FROM o")
def cluster_overlap(spark, d):
    """All pairs of clusters that share more than a tenth of the smaller one's members, equal ones too."""
    return CL.overlapping(_members(spark, d), 0.1).withColumn("overlap", F.round("overlap", 6))


@query("clusters_refined", f"""WITH m AS ({_MEMBERS}), {_OVERLAPS.format(0.1)}, f AS (SELECT b AS cluster_id, min(a) AS absorbed_by FROM o GROUP BY b),
g AS (SELECT cluster_id, member_id FROM m UNION SELECT absorbed_by, member_id FROM f JOIN m USING (cluster_id)),
x AS (SELECT cluster_id, member_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM g JOIN embeddings ON vec_id = member_id),
c AS (SELECT cluster_id, sum(a * a) AS square FROM (SELECT cluster_id, i, avg(v) AS a FROM x GROUP BY ALL) GROUP BY cluster_id)
SELECT cluster_id, absorbed_by, n AS size, round(square, 6) AS square FROM (SELECT cluster_id, count(*) AS n FROM g GROUP BY ALL) LEFT JOIN f USING (cluster_id) LEFT JOIN c USING (cluster_id)""")
def clusters_refined(spark, d):
    """Clusters merged in the order of their ids, with the squared length of their new centroids."""
    vectors = B.table(spark, d, "embeddings").select(F.col("vec_id").alias("member_id"), "embedding")
    square = F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x)
    return CL.refine(_members(spark, d), vectors, 0.1).select("cluster_id", "absorbed_by", "size", F.round(square, 6).alias("square"))


@query("source_duplicates", """WITH RECURSIVE d AS (SELECT doc_id AS id, 'f' || (doc_id % 30) AS source_file, strlen(coalesce(text, '')) AS z, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '')) AS w FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY z DESC, id) AS r, count(*) OVER (PARTITION BY source_file) >= 5 AND z >= 20 AND len(w) > 0 AS looked FROM d),
e AS MATERIALIZED (SELECT y.id, list(x.id) AS before FROM n x JOIN n y USING (source_file) WHERE x.looked AND y.looked AND x.r < y.r AND least(len(x.w), len(y.w)) >= 0.85 * greatest(len(x.w), len(y.w))
  AND 1 - len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)))::DOUBLE < 0.15 GROUP BY y.id),
g AS (SELECT source_file, 0 AS r, []::BIGINT[] AS kept FROM (SELECT DISTINCT source_file FROM n) UNION ALL
  SELECT g.source_file, n.r, CASE WHEN n.looked AND NOT list_has_any(coalesce(before, []), kept) THEN list_append(kept, n.id) ELSE kept END FROM g JOIN n ON n.source_file = g.source_file AND n.r = g.r + 1 LEFT JOIN e ON e.id = n.id),
k AS (SELECT unnest(kept) AS id FROM (SELECT source_file, kept FROM g QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY r DESC) = 1))
SELECT n.id, source_file, CASE WHEN z < 20 THEN 'short' WHEN NOT looked OR k.id IS NOT NULL THEN 'kept' ELSE 'dropped' END AS status FROM n LEFT JOIN k ON k.id = n.id""")
def source_duplicates(spark, d):
    """What the greedy rule keeps of every source, longest first."""
    return CL.within_source(B.drawers(spark, d))


@query("duplicate_stats", "SELECT 'f' || (doc_id % 30) AS source_file, count(*) AS n, CASE WHEN count(*) > 20 THEN floor(0.4 * count(*)) ELSE 0 END::BIGINT AS estimate FROM documents GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, source_file LIMIT 15")
def duplicate_stats(spark, d):
    return A.duplicate_stats(B.drawers(spark, d)).orderBy(F.desc("n"), "source_file").limit(15)


@query("project_profile", B.sql("observations", ", e AS (SELECT project, 'concept' AS kind, unnest(concepts) AS name FROM observations UNION ALL SELECT project, 'file', unnest(files) FROM observations), c AS (SELECT project, kind, name, count(*) AS n FROM e GROUP BY ALL) SELECT project, kind, name, n, (row_number() OVER (PARTITION BY project, kind ORDER BY n DESC, name))::INT AS place FROM c QUALIFY place <= 10"))
def project_profile(spark, d):
    return A.project_profile(B.observations(spark, d), 10)


@query("metadata_filter", "SELECT event_id AS id FROM events WHERE event_type = 'click' AND (event_id % 13)::VARCHAR = '4'")
def metadata_filter(spark, d):
    """Equality on arbitrary keys; a missing key is an empty string."""
    from tessera.sources.stores import metadata_equals

    rows = B.table(spark, d, "events").select(F.col("event_id").alias("id"), F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), (F.col("event_id") % 13).cast("string")).alias("metadata"))
    return rows.where(metadata_equals({"type": "click", "k": "4"})).select("id")


@query("importance_scan", "SELECT doc_id AS id, (doc_id % 10)::DOUBLE / 10 AS importance FROM documents WHERE source = 'src2' ORDER BY importance DESC, id LIMIT 15")
def importance_scan(spark, d):
    return B.drawers(spark, d).where("wing = 'src2'").select("id", "importance").orderBy(F.desc("importance"), "id").limit(15)


@query("timeline_text_filter", B.sql("observations", " SELECT id FROM observations WHERE contains(lower(title), 'sign') OR id::VARCHAR = '77'"))
def timeline_text_filter(spark, d):
    return B.observations(spark, d).where(F.lower("title").contains("sign") | (F.col("id").cast("string") == "77")).select("id")


@query("ids_in_order", "SELECT t.pos, doc_id AS id, lang AS room FROM documents JOIN (SELECT unnest([5, 3, 999999, 8]) AS i, unnest([0, 1, 2, 3]) AS pos) t ON doc_id = i")
def ids_in_order(spark, d):
    ids = spark.createDataFrame([(k, i) for k, i in enumerate([5, 3, 999999, 8])], "pos int, id long")
    return B.drawers(spark, d).join(ids, "id").select("pos", "id", "room").orderBy("pos")


@query("fuzzy_rooms", "WITH r AS (SELECT DISTINCT source || '-' || lang AS room FROM documents), s AS (SELECT room, CASE WHEN contains(room, 'src1-en') THEN 2 WHEN contains(room, 'src1') OR contains(room, 'en') THEN 1 ELSE 0 END AS score FROM r) SELECT room, score::INT AS score FROM s WHERE score > 0 ORDER BY score DESC, room LIMIT 10")
def fuzzy_rooms(spark, d):
    whole, parts = "src1-en", ["src1", "en"]
    r = B.drawers(spark, d).select(F.concat_ws("-", "wing", "room").alias("room")).distinct()
    score = F.when(F.col("room").contains(whole), 2).when(F.expr(" OR ".join(f"contains(room, '{p}')" for p in parts)), 1).otherwise(0)
    return r.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "room").limit(10)


@query("agent_scope", "SELECT event_id AS id FROM events WHERE user_id % 9 = 4")
def agent_scope(spark, d):
    return B.table(spark, d, "events").where("user_id % 9 = 4").select(F.col("event_id").alias("id"))


@query("word_set_operations", "WITH w AS (SELECT a.item_id AS id, list_distinct(string_split(a.text, ' ')) AS x, list_distinct(string_split(b.text, ' ')) AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1) SELECT id, len(list_intersect(x, y)) AS both, len(list_distinct(list_concat(x, y))) AS either FROM w")
def word_set_operations(spark, d):
    b = B.table(spark, d, "benchmark")
    w = b.alias("a").join(b.alias("b"), F.col("b.item_id") == F.col("a.item_id") + 1).select(F.col("a.item_id").alias("id"), F.split("a.text", " ").alias("x"), F.split("b.text", " ").alias("y"))
    return w.select("id", F.size(F.array_intersect("x", "y")).cast("long").alias("both"), F.size(F.array_union("x", "y")).cast("long").alias("either"))
