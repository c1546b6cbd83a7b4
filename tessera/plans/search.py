"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import metrics, vectors
from tessera.functions import text as T
from tessera.operators import graph as G
from tessera.operators import retrieval as R
from tessera.operators import text_index as TI
from tessera.operators import vector_index as VI
from tessera.operators.settle import settle, shared_dir
from tessera.plans import base as B
from tessera.plans.registry import query

_BM25 = """,
dl AS (SELECT id, count(*) AS dl FROM words GROUP BY id),
stats AS (SELECT (SELECT count(*) FROM drawers) AS n, (SELECT count(*) FROM words) / (SELECT count(*) FROM drawers)::DOUBLE AS avgdl),
qt AS (SELECT query_id, term, count(*) AS qtf FROM qwords GROUP BY ALL),
tf AS (SELECT id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm25 AS (SELECT query_id, id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (id), stats GROUP BY ALL)"""
_TOPK = """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM {0})"""


def _rounded(df, digits=9):
    """Scores to a fixed number of digits, so that equal ones tie alike whatever the order of summation."""
    return df.withColumn("score", F.round("score", digits))


def _index(spark, d):
    """The stored index of the drawers' texts; made by the first query that asks for it."""
    return TI.of_table(B.drawers(spark, d).select("id", "content"), f"{d}/documents.parquet")


@query("bm25_search", B.sql("drawers,words,queries,qwords", _BM25 + _TOPK.format("bm25") + " SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM ranked WHERE rank < 10"))
def bm25_search(spark, d):
    """Top 10 of BM25 for every query."""
    return _index(spark, d).search(B.queries(spark, d), 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("full_text_all_terms", B.sql("drawers,words,queries,qwords", _BM25 + """,
need AS (SELECT query_id, count(*) AS need FROM qt GROUP BY ALL),
held AS (SELECT query_id, id, count(*) AS held FROM qt JOIN tf USING (term) GROUP BY ALL)
SELECT query_id, id, round(score, 6) AS score FROM bm25 JOIN held USING (query_id, id) JOIN need USING (query_id) WHERE held = need"""))
def full_text_all_terms(spark, d):
    return _index(spark, d).search(B.queries(spark, d), None, "all").select("query_id", "id", F.round("score", 6).alias("score"))


@query("text_index_life", B.sql("drawers,words,queries,qwords", _BM25.replace("FROM drawers)", "FROM drawers WHERE id % 10 <> 7)").replace("FROM words", "FROM words WHERE id % 10 <> 7 AND true").replace("AND true WHERE", "AND") + _TOPK.format("bm25") + " SELECT stage, query_id, id, rank::INT AS rank, round(score, 4) AS score FROM ranked, (VALUES ('deltas'), ('merged')) AS t(stage) WHERE rank < 10"))
def text_index_life(spark, d):
    """An index that is begun with outdated texts of a tenth of the drawers, gets the right ones and loses another tenth, searched before and after its merge."""
    docs = B.drawers(spark, d).select("id", "content")
    index = TI.TextIndex(spark, shared_dir(spark, "text-index"), "bigint")
    index.add(docs.withColumn("content", F.when(F.col("id") % 10 == 3, F.concat(F.lit("out of date the "), "content")).otherwise(F.col("content"))))
    index.add(docs.where("id % 10 = 3"))
    index.delete(docs.where("id % 10 = 7").select("id"))
    before = index.search(B.queries(spark, d), 10).withColumn("stage", F.lit("deltas"))
    index.merge()
    both = before.unionByName(index.search(B.queries(spark, d), 10).withColumn("stage", F.lit("merged")))
    return both.select("stage", "query_id", "id", "rank", F.round("score", 4).alias("score"))


@query("naive_overlap_search", B.sql("drawers,words,queries,qwords", """,
dw AS (SELECT DISTINCT id, term FROM words), qw AS (SELECT DISTINCT query_id, term FROM qwords),
dn AS (SELECT id, count(*) AS dn FROM dw GROUP BY id), qn AS (SELECT query_id, count(*) AS qn FROM qw GROUP BY query_id),
j AS (SELECT query_id, id, count(*) AS b FROM dw JOIN qw USING (term) GROUP BY ALL),
s AS (SELECT query_id, id, b / (dn + qn - b)::DOUBLE AS score FROM j JOIN dn USING (id) JOIN qn USING (query_id))""" + _TOPK.format("(SELECT * FROM s WHERE score > 0.05)") + " SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM ranked WHERE rank < 10"))
def naive_overlap_search(spark, d):
    return _index(spark, d).search(B.queries(spark, d), 10, "overlap").select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("contains_strategy", B.sql("drawers", """,
c AS (SELECT id, (contains(lower(content), 'thst'))::INT + (contains(lower(content), 'eau'))::INT + (contains(lower(content), 'sch'))::INT AS hits FROM drawers)
SELECT id, hits::DOUBLE AS score FROM c WHERE hits > 0"""))
def contains_strategy(spark, d):
    return R.contains_strategy(B.drawers(spark, d), ["thst", "eau", "sch"])


_VECTORS = """WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS id, list_dot_product(embedding::DOUBLE[], qe::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(qe::DOUBLE[], qe::DOUBLE[]))) AS score FROM embeddings, q)"""


def _vectors(spark, d):
    return B.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _query_vectors(spark, d):
    return _vectors(spark, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")


@query("vector_search", _VECTORS + _TOPK.format("s") + " SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM ranked WHERE rank < 10")
def vector_search(spark, d):
    """Exact cosine neighbours of the stated query set, every vector whose id is divisible by 100."""
    return R.top_k(_rounded(R.vector_search(_vectors(spark, d), _query_vectors(spark, d), 10)), 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("vector_index_recall", _VECTORS + _TOPK.format("s") + " SELECT count(DISTINCT query_id) AS queries, count(*) AS neighbours, true AS nine_in_ten_found, true AS one_in_ten_scored FROM ranked WHERE rank < 10")
def vector_index_recall(spark, d):
    """Every vector in an index that is written and read back; the stated query set's exact neighbours, how many of them it finds, and how many rows it scores for them."""
    vectors_, queries_ = _vectors(spark, d), _query_vectors(spark, d)
    rows, model, centres = VI.build(vectors_, shared_dir(spark, "cells"))
    exact = R.top_k(_rounded(R.vector_search(vectors_, queries_, 10)), 10).select("query_id", "id")
    found = VI.search(rows, model, centres, queries_, 10).select("query_id", "id", F.lit(1).alias("hit"))
    scored = VI.estimates(rows, model, centres, queries_, model.cells, model.depth).agg(F.count(F.lit(1)).alias("scored"))
    hits = exact.join(found, ["query_id", "id"], "left").agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("hits"))
    every = vectors_.agg(F.count(F.lit(1)).alias("n"))
    return hits.crossJoin(F.broadcast(scored)).crossJoin(F.broadcast(every)).select("queries", "neighbours", (F.col("hits") >= 0.9 * F.col("neighbours")).alias("nine_in_ten_found"), (F.col("scored") <= 0.1 * F.col("n") * F.col("queries")).alias("one_in_ten_scored"))


@query("vector_normalise", "SELECT vec_id AS id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, round(1.0, 5) AS unit_norm FROM embeddings")
def vector_normalise(spark, d):
    v = _vectors(spark, d)
    return v.select("id", F.round(vectors.norm(F.col("embedding")), 5).alias("norm"), F.round(vectors.norm(vectors.l2_normalise(F.col("embedding"))), 5).alias("unit_norm"))


@query("distance_to_similarity", "SELECT vec_id AS id, round(greatest(0, least(1, 1 - x)), 6) AS cosine, round(1 / (1 + x), 6) AS l2, round(greatest(0, least(1, -x)), 6) AS ip FROM (SELECT vec_id, embedding[1]::DOUBLE * 3 AS x FROM embeddings)")
def distance_to_similarity(spark, d):
    x = _vectors(spark, d).select("id", (F.col("embedding")[0].cast("double") * 3).alias("x"))
    return x.select("id", *[F.round(vectors.similarity(m, F.col("x")), 6).alias(m) for m in ("cosine", "l2", "ip")])


@query("vector_with_manifest", _VECTORS + " SELECT query_id, count(*) AS n, round(max(score), 6) AS best FROM s WHERE id <> query_id GROUP BY query_id")
def vector_with_manifest(spark, d):
    """Best other neighbour, after the check that all vectors have the manifest's size."""
    from tessera.sources.stores import checked_vectors

    held = checked_vectors(_vectors(spark, d), dims=64)
    s = R.vector_search(held, _query_vectors(spark, d)).where("id <> query_id")
    return s.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 6).alias("best"))


def _graph(spark, d):
    """Graph evidence: a document whose number is a query's, or next to it."""
    q = B.queries(spark, d)
    return q.select("query_id", F.explode(F.array(F.col("query_id"), F.col("query_id") + 1)).alias("id")).withColumn("score", F.when(F.col("id") == F.col("query_id"), 1.0).otherwise(0.5))


_HYBRID = _BM25 + """,
vq AS (SELECT item_id AS query_id, embedding AS qe FROM benchmark JOIN embeddings ON vec_id = item_id),
vs AS (SELECT query_id, vec_id AS id, round(list_dot_product(embedding::DOUBLE[], qe::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(qe::DOUBLE[], qe::DOUBLE[]))), 9) AS score FROM embeddings, vq WHERE vec_id IN (SELECT id FROM drawers)),
gs AS (SELECT item_id AS query_id, item_id AS id, 1.0 AS score FROM benchmark UNION ALL SELECT item_id, item_id + 1, 0.5 FROM benchmark),
streams AS (SELECT 'bm25' AS s, 0.7 AS w, query_id, id, round(score, 9) AS score FROM bm25 UNION ALL SELECT 'vector', 0.6, query_id, id, score FROM vs UNION ALL SELECT 'graph', 0.3, query_id, id, score FROM gs WHERE id IN (SELECT id FROM drawers)),
cut AS (SELECT *, row_number() OVER (PARTITION BY s, query_id ORDER BY score DESC, id) - 1 AS rank FROM streams QUALIFY rank < 30),
tw AS (SELECT query_id, sum(w) AS total FROM (SELECT DISTINCT query_id, s, w FROM cut) GROUP BY query_id),
f AS (SELECT query_id, id, round(sum(w / total / (25 + rank)), 9) AS score FROM cut JOIN tw USING (query_id) GROUP BY query_id, id),
m AS (SELECT f.*, session, wing, room, row_number() OVER (PARTITION BY query_id, session ORDER BY score DESC, id) > 3 AS late FROM f JOIN drawers USING (id)),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY late, score DESC, id) AS place FROM m)"""


def _hybrid(spark, d, **options):
    vectors_ = _vectors(spark, d).select("id", "embedding")
    qv = B.queries(spark, d).join(vectors_.withColumnRenamed("id", "query_id"), "query_id").select("query_id", "embedding")
    docs = B.drawers(spark, d)
    streams = {"bm25": _index(spark, d).search(B.queries(spark, d), 30), "vector": R.top_k(_rounded(R.vector_search(vectors_.join(docs.select("id"), "id", "left_semi"), qv, 30)), 30), "graph": R.top_k(_graph(spark, d).join(docs.select("id"), "id", "left_semi"), 30)}
    return _rounded(R.fuse(streams)).join(docs.select("id", "session", "wing", "room"), "id")


@query("hybrid_search", B.sql("drawers,words,queries,qwords", _HYBRID + " SELECT query_id, id, session, place::INT AS place, round(score, 6) AS score FROM p WHERE place <= 10"))
def hybrid_search(spark, d):
    """The flagship: BM25, exact vectors and graph evidence, fused by reciprocal rank, at most three of a session first."""
    return R.diversify(_hybrid(spark, d), "session", 3, 10).select("query_id", "id", "session", F.col("place").cast("int").alias("place"), F.round("score", 6).alias("score"))


@query("max_per_source", B.sql("drawers,words,queries,qwords", _HYBRID + " SELECT query_id, id, wing FROM (SELECT *, row_number() OVER (PARTITION BY query_id, wing ORDER BY score DESC, id) AS n FROM m) WHERE n <= 2"))
def max_per_source(spark, d):
    return R.max_per_source(_hybrid(spark, d), "wing", 2).select("query_id", "id", "wing")


@query("search_rerank", B.sql("drawers,words,queries,qwords", _BM25 + """,
dw AS (SELECT DISTINCT id, term FROM words), qw AS (SELECT DISTINCT query_id, term FROM qwords),
dn AS (SELECT id, count(*) AS dn FROM dw GROUP BY id), qn AS (SELECT query_id, count(*) AS qn FROM qw GROUP BY query_id),
j AS (SELECT query_id, id, count(*) AS b FROM dw JOIN qw USING (term) GROUP BY ALL),
s AS (SELECT query_id, id, b / (dn + qn - b)::DOUBLE AS sim FROM j JOIN dn USING (id) JOIN qn USING (query_id) WHERE b / (dn + qn - b)::DOUBLE > 0.05),
r AS (SELECT query_id, id, round(0.7 * sim + 0.3 * coalesce(score, 0) / (coalesce(score, 0) + 1), 9) AS score FROM s LEFT JOIN bm25 USING (query_id, id))""" + _TOPK.format("r") + " SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM ranked WHERE rank < 10"))
def search_rerank(spark, d):
    """Word overlap reranked by BM25."""
    return _index(spark, d).search(B.queries(spark, d), 10, "blend").select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("duplicate_check", """WITH d AS (SELECT doc_id AS id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM documents),
q AS (SELECT id AS query_id, w FROM d WHERE id % 100 = 0),
s AS (SELECT query_id, id, len(list_intersect(d.w, q.w)) AS b, len(d.w) + len(q.w) AS t FROM d, q WHERE d.id <> q.query_id),
r AS (SELECT query_id, id, b / (t - b)::DOUBLE AS score FROM s WHERE b > 0)
SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS n FROM r WHERE score > 0.05) WHERE n = 1 AND score >= 0.5""")
def duplicate_check(spark, d):
    """For every document whose id is divisible by 100, the most similar other one, if half of the words agree."""
    docs = B.texts(spark, d)
    q = B.drawers(spark, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("content").alias("query"))
    return R.most_similar(docs, q, 0.5).select("query_id", "id", F.round("score", 6).alias("score"))


@query("retrieval_metrics", B.sql("drawers,words,queries,qwords", _BM25 + _TOPK.format("bm25") + """,
h AS (SELECT query_id, rank, (id % 5 = query_id % 5)::INT AS rel FROM ranked WHERE rank < 10),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) - 1 AS ideal FROM h),
g AS (SELECT query_id, max(rel) AS any_, sum(rel) >= 2 AS all_, sum(rel / log2(rank + 2)) AS dcg, sum(rel / log2(ideal + 2)) AS idcg FROM i GROUP BY query_id)
SELECT count(*) AS n, round(avg(any_), 6) AS recall_any, round(avg(all_::INT), 6) AS recall_all, round(avg(CASE WHEN idcg = 0 THEN 0 ELSE dcg / idcg END), 6) AS ndcg FROM g"""))
def retrieval_metrics(spark, d):
    ranked = R.top_k(_rounded(R.bm25(B.texts(spark, d), B.queries(spark, d))), 10)
    hits = ranked.select("query_id", "rank", (F.col("id") % 5 == F.col("query_id") % 5).cast("int").alias("relevance"), F.lit(2).alias("n_correct"))
    m = metrics.ranked_metrics(hits, 10)
    return m.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall_any", "recall_all", "ndcg")])


@query("query_expansion", """WITH syn AS (SELECT unnest(['the', 'the', 'of', 'of']) AS term, unnest(['a', 'an', 'from', 'by']) AS member),
q AS (SELECT item_id AS query_id, text AS query FROM benchmark),
w AS (SELECT query_id, list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda x: x <> '') AS ws FROM q),
m AS (SELECT query_id, list_sort(list(DISTINCT member)) AS more FROM (SELECT query_id, unnest(ws) AS term FROM w) JOIN syn USING (term) GROUP BY query_id)
SELECT query_id, concat_ws(' ', query, array_to_string(list_filter(coalesce(more, []), lambda x: NOT list_contains(ws, x)), ' ')) AS query FROM q JOIN w USING (query_id) LEFT JOIN m USING (query_id)""")
def query_expansion(spark, d):
    synonyms = spark.createDataFrame([("the", "a"), ("the", "an"), ("of", "from"), ("of", "by")], "term string, member string")
    return R.expand_queries(B.queries(spark, d), synonyms)


@query("lesson_recall", f"""WITH l AS (SELECT doc_id AS id, text, (doc_id % 100)::DOUBLE / 100 AS confidence, (doc_id % 200)::DOUBLE AS days FROM documents),
s AS (SELECT id, confidence * (contains(lower(text), 'the')::INT + contains(lower(text), 'und')::INT) / 2.0 / (1 + 0.01 * days) AS score FROM l)
SELECT id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY round(score, 9) DESC, id LIMIT 20""")
def lesson_recall(spark, d):
    lessons = B.table(spark, d, "documents").selectExpr("doc_id AS id", "text", "cast(doc_id % 100 AS double) / 100 AS confidence", f"{B.NOW} - make_dt_interval(cast(doc_id % 200 AS int)) AS reinforced_at")
    s = _rounded(R.weighted_recall(lessons, ["the", "und"], B.now(), F.col("text")))
    return s.orderBy(F.desc("score"), "id").limit(20).select("id", F.round("score", 6).alias("score"))


@query("related_by_keywords", "SELECT doc_id AS id, round((contains(lower(text), 'thst')::INT + contains(lower(text), 'eau')::INT) / 2.0, 6) AS score FROM documents WHERE contains(lower(text), 'thst') OR contains(lower(text), 'eau')")
def related_by_keywords(spark, d):
    return R.related_by_keywords(B.drawers(spark, d), ["thst", "eau", "of"]).select("id", F.round("score", 6).alias("score"))


@query("follow_up_searches", """WITH s AS (SELECT event_id AS id, user_id AS agent_id, event_type AS project, ts, [event_id % 7, event_id % 5] AS r FROM events),
w AS (SELECT *, lag(r) OVER o AS pr, lag(ts) OVER o AS pt FROM s WINDOW o AS (PARTITION BY agent_id, project ORDER BY ts, id))
SELECT id, coalesce(floor(epoch(ts)) - floor(epoch(pt)) <= 86400 AND NOT list_has_any(r, pr), false) AS is_follow_up FROM w""")
def follow_up_searches(spark, d):
    s = B.table(spark, d, "events").selectExpr("event_id AS id", "user_id AS agent_id", "event_type AS project", "ts", "array(event_id % 7, event_id % 5) AS result_ids")
    return R.follow_ups(s, 86400).select("id", "is_follow_up")


@query("token_f1", """WITH p AS (SELECT a.item_id AS id, a.text AS x, b.text AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
w AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(replace(lower(x), ',', ''), '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the'))) AS x, list_distinct(list_filter(regexp_split_to_array(replace(lower(y), ',', ''), '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the'))) AS y FROM p)
SELECT id, round(CASE WHEN len(list_intersect(x, y)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) END, 6) AS f1 FROM w""")
def token_f1(spark, d):
    b = B.table(spark, d, "benchmark")
    pairs = b.alias("a").join(b.alias("b"), F.col("b.item_id") == F.col("a.item_id") + 1)
    return pairs.select(F.col("a.item_id").alias("id"), F.round(metrics.token_f1(F.col("a.text"), F.col("b.text")), 6).alias("f1"))


@query("room_prior_search", B.sql("drawers,words,queries,qwords", _BM25 + _TOPK.format("(SELECT b.* FROM bm25 b JOIN drawers USING (id) WHERE wing = 'src1' AND room = 'en')") + " SELECT query_id, id, rank::INT AS rank FROM ranked WHERE rank < 5"))
def room_prior_search(spark, d):
    """A search within a wing and room: statistics over all drawers, the filter before the cut."""
    docs = B.drawers(spark, d)
    inside = docs.where("wing = 'src1' AND room = 'en'").select("id")
    s = _rounded(R.bm25(B.texts(spark, d), B.queries(spark, d))).join(inside, "id", "left_semi")
    return R.top_k(s, 5).select("query_id", "id", "rank")


_PUSH = """t{1} AS (SELECT sd, room, sum(got) AS rest FROM (SELECT x.sd, l.room, x.inflow AS got FROM (SELECT sd, wing, sum(0.85 * rest / degree) AS inflow FROM t{0} JOIN deg USING (room) JOIN l USING (room) GROUP BY sd, wing) x JOIN l USING (wing)
  UNION ALL SELECT sd, room, -0.85 * rest / degree FROM t{0} JOIN deg USING (room) JOIN l USING (room)) GROUP BY sd, room HAVING sum(got) > 1e-15)"""
_ROUNDS = 8


@query("search_with_rooms", B.sql("drawers,words,queries,qwords", _HYBRID + """,
cand AS (SELECT query_id, id, score, place FROM p WHERE place <= 30), cw AS (SELECT query_id, id, term FROM cand JOIN words USING (id)), cl AS (SELECT cand.query_id, cand.id, coalesce(dl.dl, 0) AS dl FROM cand LEFT JOIN dl USING (id)),
cs AS (SELECT query_id, count(*) AS n, avg(dl) AS avgdl FROM cl GROUP BY query_id), ct AS (SELECT query_id, id, term, count(*) AS tf FROM cw SEMI JOIN qt USING (query_id, term) GROUP BY ALL), cdf AS (SELECT query_id, term, count(*) AS df FROM ct GROUP BY ALL),
cb AS (SELECT query_id, id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * cl.dl / avgdl))) AS b FROM ct JOIN cdf USING (query_id, term) JOIN cs USING (query_id) JOIN cl USING (query_id, id) JOIN qt USING (query_id, term) GROUP BY ALL),
best AS (SELECT query_id, id, score FROM cand LEFT JOIN cb USING (query_id, id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(0.7 * score + 0.3 * coalesce(b, 0) / (coalesce(b, 0) + 1), 9) DESC, id) <= 10),
l AS (SELECT DISTINCT wing || '/' || room AS room, wing FROM drawers WHERE room <> '' UNION SELECT DISTINCT wing || '/' || room, 'lang ' || room FROM drawers WHERE room <> ''),
sz AS (SELECT wing, count(*) AS z FROM l GROUP BY wing), deg AS (SELECT room, sum(z - 1)::DOUBLE AS degree FROM l JOIN sz USING (wing) GROUP BY room HAVING sum(z - 1) > 0),
nm AS (SELECT query_id, room, count(*)::DOUBLE AS mass FROM qwords, (SELECT DISTINCT room FROM l) WHERE contains(lower(room), term) GROUP BY ALL),
sd AS (SELECT 'q' || query_id AS sd, room, mass FROM nm UNION ALL SELECT 'all', room, 1.0 FROM (SELECT DISTINCT room FROM l)),
t0 AS (SELECT sd, room, mass / sum(mass) OVER (PARTITION BY sd) AS rest FROM sd), """ + ", ".join(_PUSH.format(k, k + 1) for k in range(_ROUNDS)) + """,
rk AS (SELECT sd, room, sum(x) AS rank FROM (""" + " UNION ALL ".join(f"SELECT sd, room, {'0.15 * ' if k < _ROUNDS else ''}rest AS x FROM t{k}" for k in range(_ROUNDS + 1)) + """) GROUP BY sd, room),
rt AS (SELECT * FROM rk QUALIFY row_number() OVER (PARTITION BY sd ORDER BY round(rank, 12) DESC, room) <= 50),
fu AS (SELECT b.query_id, b.id, d.wing, round(0.7 * b.score + 0.3 * coalesce(rank, 0), 9) AS fused FROM best b JOIN drawers d USING (id) LEFT JOIN rt ON rt.room = d.wing || '/' || d.room AND rt.sd = CASE WHEN b.query_id IN (SELECT query_id FROM nm) THEN 'q' || b.query_id ELSE 'all' END)
SELECT query_id, id, wing, round(fused, 6) AS fused FROM fu QUALIFY row_number() OVER (PARTITION BY query_id, wing ORDER BY fused DESC, id) <= 2"""))
def search_with_rooms(spark, d):
    """The whole search for all queries at once: fused streams, BM25 within the candidates, the rooms' ranks from the query's own words, at most two hits of a source."""
    docs, q = B.drawers(spark, d), B.queries(spark, d)
    fused = settle(R.diversify(_hybrid(spark, d).select("query_id", "id", "score", "session"), "session", 3, 30))  # read for words, counts and scores
    best = R.rerank(fused.select("query_id", "id", "score").join(docs.select("id", "content"), "id"), q, 10)
    place = F.concat_ws("/", "wing", "room")
    nodes = docs.where("room <> ''").groupBy(place.alias("room")).agg(F.collect_set(F.col("wing")).alias("w"), F.collect_set(F.concat(F.lit("lang "), F.col("room"))).alias("r")).select("room", F.concat("w", "r").alias("wings"))
    ranks, seedings = G.room_ranks(nodes, q, rounds=_ROUNDS)
    found = R.fuse_rooms(best.select("query_id", "id", "score").join(docs.select("id", "wing", place.alias("room")), "id"), ranks, seedings)
    return R.max_per_source(found.select("query_id", "id", "wing", F.col("fused").alias("score")), "wing", 2).select("query_id", "id", "wing", F.round("score", 6).alias("fused"))
