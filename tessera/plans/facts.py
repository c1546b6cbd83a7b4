"""Knowledge-graph, temporal and room-graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import temporal as X
from tessera.plans import base as B
from tessera.plans.registry import query

WHEN = "TIMESTAMP '1998-01-01 00:00:00'"
LATER = "TIMESTAMP '1998-06-01 00:00:00'"
_VALID = "(valid_from IS NULL OR valid_from <= {0}) AND (valid_to IS NULL OR valid_to >= {0})"


def _when(text=WHEN):
    return F.expr(text)


@query("kg_stats", B.sql("triples,entities", " SELECT count(*) AS triples, count(*) FILTER (valid_to IS NULL) AS current, count(*) FILTER (valid_to IS NOT NULL) AS expired, array_to_string(list_sort(list(DISTINCT predicate)), ',') AS predicates, (SELECT count(*) FROM entities) AS entities FROM triples"))
def kg_stats(spark, d):
    return X.stats(B.triples(spark, d), B.entities(spark, d)).withColumn("predicates", F.array_join("predicates", ","))


@query("entity_as_of", B.sql("triples,entities", f""",
f AS (SELECT * FROM triples WHERE {_VALID.format(WHEN)} AND (t_expired IS NULL OR t_expired > {WHEN}))
SELECT triple_id, predicate, name, 'outgoing' AS direction FROM f JOIN entities ON object = entity_id WHERE subject = 'c7'
UNION ALL SELECT triple_id, predicate, name, 'incoming' FROM f JOIN entities ON subject = entity_id WHERE object = 'c7'"""))
def entity_as_of(spark, d):
    return X.entity_as_of(B.triples(spark, d), B.entities(spark, d), "c7", _when()).select("triple_id", "predicate", "name", "direction")


@query("entity_current_out", B.sql("triples,entities", " SELECT triple_id, predicate, name FROM triples JOIN entities ON object = entity_id WHERE subject = 'c7'"))
def entity_current_out(spark, d):
    return X.entity_as_of(B.triples(spark, d), B.entities(spark, d), "c7", direction="outgoing").select("triple_id", "predicate", "name")


@query("bitemporal_facts", B.sql("triples", f" SELECT triple_id, object FROM triples WHERE subject = 'c8' AND {_VALID.format(WHEN)} AND t_created <= {LATER} AND (t_expired IS NULL OR t_expired >= {LATER})"))
def bitemporal_facts(spark, d):
    return X.bitemporal(B.triples(spark, d), "c8", _when(), _when(LATER)).select("triple_id", "object")


@query("predicate_query", B.sql("triples,entities", f" SELECT triple_id, s.name AS subject_name, o.name AS object_name FROM triples JOIN entities s ON subject = s.entity_id JOIN entities o ON object = o.entity_id WHERE predicate = 'P' AND {_VALID.format(WHEN)}"))
def predicate_query(spark, d):
    return X.by_predicate(B.triples(spark, d), B.entities(spark, d), "P", _when()).select("triple_id", "subject_name", "object_name")


@query("entity_timeline", B.sql("triples", " SELECT triple_id, valid_from FROM triples WHERE subject = 'c11' OR object = 'c11' ORDER BY valid_from NULLS FIRST, triple_id LIMIT 100"))
def entity_timeline(spark, d):
    return X.timeline(B.triples(spark, d), "c11").select("triple_id", "valid_from")


@query("transaction_timeline", B.sql("triples", f" SELECT triple_id, valid_from FROM triples WHERE (subject = 'c11' OR object = 'c11') AND t_created <= {WHEN} AND (t_expired IS NULL OR t_expired >= {WHEN}) ORDER BY valid_from NULLS FIRST, triple_id LIMIT 100"))
def transaction_timeline(spark, d):
    return X.timeline(B.triples(spark, d), "c11", known=_when()).select("triple_id", "valid_from")


@query("range_endpoints", B.sql("triples", f" SELECT DISTINCT subject, predicate, object FROM triples WHERE subject = 'c14' AND (({_VALID.format(WHEN)}) OR ({_VALID.format(LATER)}))"))
def range_endpoints(spark, d):
    return X.range_endpoints(B.triples(spark, d), "c14", _when(), _when(LATER)).select("subject", "predicate", "object")


@query("range_overlap", B.sql("triples", f" SELECT triple_id FROM triples WHERE subject = 'c14' AND valid_from <= {LATER} AND (valid_to IS NULL OR valid_to >= {WHEN})"))
def range_overlap(spark, d):
    return X.range_overlap(B.triples(spark, d), "c14", _when(), _when(LATER)).select("triple_id")


@query("close_conflicts", B.sql("triples", " SELECT triple_id, CASE WHEN valid_to IS NULL THEN lead(valid_from) OVER (PARTITION BY subject, predicate ORDER BY valid_from, triple_id) ELSE valid_to END AS valid_to FROM triples"))
def close_conflicts(spark, d):
    return X.close_conflicts(B.triples(spark, d)).select("triple_id", "valid_to")


@query("add_triples", B.sql("triples", f""",
old AS (SELECT * FROM triples WHERE triple_id % 2 = 0), new AS (SELECT * FROM triples WHERE triple_id % 50 = 1),
good AS (SELECT * FROM new WHERE (subject, predicate, object) NOT IN (SELECT (subject, predicate, object) FROM old WHERE valid_to IS NULL)),
one AS (SELECT DISTINCT subject, predicate, object FROM good), st AS (SELECT subject, predicate, min(valid_from) AS e FROM good GROUP BY ALL)
SELECT subject, predicate, object, CASE WHEN valid_to IS NULL THEN e ELSE valid_to END AS valid_to FROM old LEFT JOIN st USING (subject, predicate)
UNION ALL SELECT subject, predicate, object, max(valid_to) FROM good GROUP BY ALL"""))
def add_triples(spark, d):
    """Rows with odd ids of the fifties join the even ones."""
    t = B.triples(spark, d)
    return X.add_triples(t.where("triple_id % 2 = 0"), t.where("triple_id % 50 = 1"), B.now()).select("subject", "predicate", "object", "valid_to")


@query("invalidate_facts", B.sql("triples", f" SELECT triple_id, CASE WHEN valid_to IS NULL AND (subject, predicate, object) IN (SELECT (subject, predicate, object) FROM triples WHERE triple_id % 9 = 0) THEN {B.NOW} ELSE valid_to END AS valid_to FROM triples"))
def invalidate_facts(spark, d):
    t = B.triples(spark, d)
    return X.invalidate(t, t.where("triple_id % 9 = 0"), B.now()).select("triple_id", "valid_to")


@query("top_degrees", B.sql("triples", ", e AS (SELECT subject AS node FROM triples UNION ALL SELECT object FROM triples WHERE object <> subject) SELECT node, count(*) AS degree FROM e GROUP BY node ORDER BY degree DESC, node LIMIT 500"))
def top_degrees(spark, d):
    return G.degrees(B.triples(spark, d)).orderBy(F.desc("degree"), "node").limit(500)


@query("bfs_expansion", B.sql("triples", """,
b AS (SELECT subject AS a, object AS b FROM triples UNION SELECT object, subject FROM triples),
r AS (SELECT 'c7' AS node, 0 AS depth UNION SELECT b, depth + 1 FROM r JOIN b ON node = a WHERE depth < 2)
SELECT node, min(depth)::INT AS depth FROM r GROUP BY node"""))
def bfs_expansion(spark, d):
    return G.expand(B.triples(spark, d), spark.createDataFrame([("c7",)], "node string"), 2)


@query("related_relations", B.sql("triples", """,
r AS (SELECT 'c7' AS node, 0 AS depth UNION SELECT object, depth + 1 FROM r JOIN triples ON node = subject WHERE depth < 3 AND confidence >= 0.5)
SELECT node, min(depth)::INT AS depth FROM r GROUP BY node"""))
def related_relations(spark, d):
    return G.follow(B.triples(spark, d), spark.createDataFrame([("c7",)], "node string"), 3, 0.5)


@query("cascade_retrieval", B.sql("triples", """,
b AS (SELECT a, b, max(weight) AS weight FROM (SELECT subject AS a, object AS b, weight FROM triples UNION ALL SELECT object, subject, weight FROM triples) GROUP BY a, b),
r0 AS (SELECT 'c7' AS node, 1.0::DOUBLE AS score), r1 AS (SELECT node, max(score) AS score FROM (SELECT * FROM r0 UNION ALL SELECT b, score * weight * 0.7 FROM r0 JOIN b ON node = a) GROUP BY node),
r2 AS (SELECT node, max(score) AS score FROM (SELECT * FROM r1 UNION ALL SELECT b, score * weight * 0.7 FROM r1 JOIN b ON node = a) GROUP BY node)
SELECT node, round(score, 6) AS score FROM r2"""))
def cascade_retrieval(spark, d):
    s = G.cascade(B.triples(spark, d), spark.createDataFrame([("c7", 1.0)], "node string, score double"), 2)
    return s.select("node", F.round("score", 6).alias("score"))


@query("cascade_tags", B.sql("triples", """,
b AS (SELECT a, b, max(weight) AS weight FROM (SELECT subject AS a, object AS b, weight FROM triples UNION ALL SELECT object, subject, weight FROM triples) GROUP BY a, b), h AS (SELECT DISTINCT subject AS node, predicate || length(subject) AS tag FROM triples),
r0 AS (SELECT 'c7' AS node, 1.0::DOUBLE AS score), t0 AS (SELECT y.node, score * 0.8 * 0.7 AS score FROM r0 JOIN h x USING (node) JOIN h y ON x.tag = y.tag AND x.node <> y.node),
r1 AS (SELECT node, max(score) AS score FROM (SELECT * FROM r0 UNION ALL SELECT b, score * weight * 0.7 FROM r0 JOIN b ON node = a UNION ALL SELECT * FROM t0) GROUP BY node), t1 AS (SELECT y.node, max(score) * 0.8 * 0.7 AS score FROM r1 JOIN h x USING (node) JOIN h y ON x.tag = y.tag AND x.node <> y.node GROUP BY y.node),
r2 AS (SELECT node, max(score) AS score FROM (SELECT * FROM r1 UNION ALL SELECT b, score * weight * 0.7 FROM r1 JOIN b ON node = a UNION ALL SELECT * FROM t1) GROUP BY node)
SELECT node, round(score, 6) AS score FROM r2"""))
def cascade_tags(spark, d):
    """A cascade that also goes over shared tags."""
    t = B.triples(spark, d)
    tags = t.select(F.col("subject").alias("node"), F.concat("predicate", F.length("subject")).alias("tag"))
    return G.cascade(t, spark.createDataFrame([("c7", 1.0)], "node string, score double"), 2, tags=tags).select("node", F.round("score", 6).alias("score"))


_ROOMS = "drawers2 AS (SELECT 'r' || (doc_id % 23) AS room, 'w' || ((doc_id * 7) % 10 + (doc_id % 3)) AS wing, 'h' || (doc_id % 3) AS hall, '2024-01-' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') AS date, text AS content FROM documents)"
_NODES = f"WITH RECURSIVE {_ROOMS}, nodes AS (SELECT room, list_sort(list(DISTINCT wing)) AS wings, list_sort(list(DISTINCT hall)) AS halls, list_sort(list(DISTINCT date)) AS ds, count(*) AS n FROM drawers2 GROUP BY room)"


def _rooms(spark, d):
    return B.table(spark, d, "documents").selectExpr("concat('r', doc_id % 23) AS room", "concat('w', (doc_id * 7) % 10 + (doc_id % 3)) AS wing", "concat('h', doc_id % 3) AS hall", "concat('2024-01-', lpad(cast(1 + doc_id % 28 AS string), 2, '0')) AS date", "text AS content")


@query("room_nodes", _NODES + " SELECT room, array_to_string(wings, ',') AS wings, array_to_string(halls, ',') AS halls, array_to_string(ds[greatest(1, len(ds) - 4):], ',') AS dates, n FROM nodes")
def room_nodes(spark, d):
    return G.room_nodes(_rooms(spark, d)).select("room", *[F.array_join(c, ",").alias(c) for c in ("wings", "halls", "dates")], "n")


@query("find_tunnels", _NODES + " SELECT room, n FROM nodes WHERE len(wings) >= 2 AND list_contains(wings, 'w3') ORDER BY n DESC, room LIMIT 50")
def find_tunnels(spark, d):
    return G.tunnels(G.room_nodes(_rooms(spark, d)), "w3").select("room", "n")


@query("tunnel_edges", _NODES + ", p AS (SELECT room, halls, unnest(wings) AS a, wings FROM nodes), q AS (SELECT room, halls, a, unnest(wings) AS b FROM p) SELECT room, a AS wing_a, b AS wing_b, unnest(halls) AS hall FROM q WHERE a < b")
def tunnel_edges(spark, d):
    return G.tunnel_edges(G.room_nodes(_rooms(spark, d)))


@query("graph_stats", _NODES + " SELECT count(*) AS rooms, count(*) FILTER (len(wings) >= 2) AS tunnels, sum(len(wings))::BIGINT AS wing_links, max(n) AS largest FROM nodes")
def graph_stats(spark, d):
    n = G.room_nodes(_rooms(spark, d))
    return n.agg(F.count(F.lit(1)).alias("rooms"), F.count_if(F.size("wings") >= 2).alias("tunnels"), F.sum(F.size("wings")).cast("long").alias("wing_links"), F.max("n").alias("largest"))


@query("topic_tunnels", f"WITH {_ROOMS}, t AS (SELECT DISTINCT wing, lower(upper(room)) AS topic FROM drawers2), p AS (SELECT x.wing AS wing_a, y.wing AS wing_b, x.topic FROM t x JOIN t y ON x.topic = y.topic AND x.wing < y.wing) SELECT wing_a, wing_b, topic, substr(sha256(wing_a || '|' || wing_b || '|' || topic), 1, 16) AS tunnel_id FROM p QUALIFY count(*) OVER (PARTITION BY wing_a, wing_b) >= 2")
def topic_tunnels(spark, d):
    return G.topic_tunnels(_rooms(spark, d).select("wing", F.upper("room").alias("topic")), 2)


@query("room_traversal", _NODES + """, l AS (SELECT room, unnest(wings) AS wing FROM nodes),
r AS (SELECT 'r1' AS room, 0 AS hop UNION SELECT b.room, hop + 1 FROM r JOIN l a ON a.room = r.room JOIN l b ON b.wing = a.wing WHERE hop < 2)
SELECT room, min(hop)::INT AS hop, any_value(n) AS n FROM r JOIN nodes USING (room) GROUP BY room ORDER BY hop, n DESC, room LIMIT 50""")
def room_traversal(spark, d):
    return G.room_traversal(G.room_nodes(_rooms(spark, d)), "r1", 2).select("room", "hop", "n")


@query("room_synonymy", f"""WITH {_ROOMS}, w AS (SELECT DISTINCT wing, room, unnest(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')) AS word FROM drawers2),
z AS (SELECT wing, room, count(*) AS size FROM w GROUP BY ALL), s AS (SELECT a.wing, a.room AS room_a, b.room AS room_b, count(*) AS b FROM w a JOIN w b ON a.wing = b.wing AND a.word = b.word AND a.room < b.room GROUP BY ALL)
SELECT s.wing, room_a, room_b, round(b / (x.size + y.size - b)::DOUBLE, 6) AS similarity FROM s JOIN z x ON x.wing = s.wing AND x.room = room_a JOIN z y ON y.wing = s.wing AND y.room = room_b WHERE b / (x.size + y.size - b)::DOUBLE > 0.1""")
def room_synonymy(spark, d):
    return G.room_similarity(_rooms(spark, d), 0.1).withColumn("similarity", F.round("similarity", 6))


_ROUND = """r{1} AS (SELECT b.room, 0.15 * base + 0.85 * coalesce(got, 0) AS rank FROM base b LEFT JOIN (
  SELECT s.room, sum(inflow - out) AS got FROM (SELECT r.room, wing, rank / degree AS out FROM r{0} r JOIN deg USING (room) JOIN l ON l.room = r.room WHERE degree > 0) s
  JOIN (SELECT wing, sum(rank / degree) AS inflow FROM r{0} r JOIN deg USING (room) JOIN l ON l.room = r.room WHERE degree > 0 GROUP BY wing) USING (wing) GROUP BY s.room) g USING (room))"""


@query("personalised_pagerank", _NODES + """, l AS (SELECT room, unnest(wings) AS wing FROM nodes), sz AS (SELECT wing, count(*) AS size FROM l GROUP BY wing), deg AS (SELECT room, sum(size - 1)::DOUBLE AS degree FROM l JOIN sz USING (wing) GROUP BY room),
base AS (SELECT room, CASE WHEN room IN ('r1', 'r2') THEN 0.5 ELSE 0.0 END::DOUBLE AS base FROM nodes), r0 AS (SELECT room, base AS rank FROM base), """ + ", ".join(_ROUND.format(k, k + 1) for k in range(5)) + " SELECT room, round(rank, 6) AS rank FROM r5")
def personalised_pagerank(spark, d):
    """Five rounds from two rooms."""
    nodes = G.room_nodes(_rooms(spark, d)).select("room", "wings")
    return G.pagerank(nodes, spark.createDataFrame([("r1", 1.0), ("r2", 1.0)], "room string, mass double"), rounds=5).withColumn("rank", F.round("rank", 6))
