"""The supplied tables as the engine's logical tables, in Spark and, as WITH clauses, in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import spread, table

NOW = "TIMESTAMP '2024-06-01 00:00:00'"


def now():
    return F.expr(NOW)


def _view(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*columns)


def drawers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "documents", "doc_id AS id", "text AS content", "source AS wing", "lang AS room", "concat('f', doc_id % 30) AS source_file", "doc_id % 40 AS session", "concat('h', doc_id % 3) AS hall", "concat('2024-01-', lpad(cast(1 + doc_id % 28 AS string), 2, '0')) AS date", "cast(doc_id % 10 AS double) / 10 AS importance")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawers, for searches through their texts: a small table is dealt out to all cores."""
    return spread(drawers(spark, sf_dir), "id")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "benchmark", "item_id AS query_id", "text AS query")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(
        spark, sf_dir, "documents", "doc_id AS memory_id", "text AS content", "lang AS kind", "source AS project", "cast(1 AS int) AS version", "doc_id % 7 <> 0 AS is_latest", "cast(doc_id % 100 AS double) / 100 AS confidence",
        "cast(1.0 AS double) AS retention_strength", "cast(0.001 * (1 + doc_id % 50) AS double) AS decay_rate", "doc_id % 60 AS access_count", f"{NOW} - make_dt_interval(cast(doc_id % 400 AS int)) AS last_accessed", f"{NOW} - make_dt_interval(cast(doc_id % 700 AS int)) AS created_at",
        f"CASE WHEN doc_id % 11 = 0 THEN {NOW} - make_dt_interval(cast(doc_id % 5 AS int)) END AS forget_after", "cast(doc_id % 10 AS double) / 10 AS strength",
    )


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(
        spark, sf_dir, "orders", "o_orderkey AS triple_id", "concat('c', o_custkey) AS subject", "o_orderstatus AS predicate", "concat('c', (o_custkey * 7 + o_orderkey) % 140 + 1) AS object", "o_orderdate AS valid_from",
        "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + make_dt_interval(cast(o_orderkey % 300 AS int)) END AS valid_to", "o_orderdate AS t_created", "CASE WHEN o_orderkey % 10 = 0 THEN o_orderdate + make_dt_interval(200) END AS t_expired", "cast(o_orderkey % 100 AS double) / 100 AS confidence",
        "cast(1 + o_orderkey % 9 AS double) / 10 AS weight",
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "customer", "concat('c', c_custkey) AS entity_id", "c_name AS name")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(
        spark, sf_dir, "events", "event_id AS id", "user_id AS session_id", "ts", "event_type AS type", "concat(event_type, ' ', user_id % 20) AS title", "concat('p', user_id % 4) AS project", "array(concat('f', event_id % 37), concat('g', event_id % 11)) AS files",
        "array(event_type, concat('k', event_id % 13)) AS concepts", "cast(1 + event_id % 10 AS int) AS importance", "cast(50 + event_id % 400 AS long) AS tokens", "value", "props",
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "orders", "o_orderkey AS action_id", "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'in_progress' END AS status", "cast(1 + o_orderkey % 5 AS int) AS priority", "concat('p', o_custkey % 10) AS project", "o_orderdate AS created_at")


def action_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "orders", "o_orderkey AS action_id", "o_orderkey - 3 AS depends_on").where("action_id % 4 = 0")


def leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "orders", "o_orderkey AS action_id", "concat('a', o_custkey % 5) AS agent_id", "o_orderdate AS acquired_at", "o_orderdate + make_dt_interval(cast(o_orderkey * 11 % 12000 AS int)) AS expires_at")


#: The same tables as DuckDB common table expressions.
SQL = {
    "drawers": "drawers AS (SELECT doc_id AS id, text AS content, source AS wing, lang AS room, 'f' || (doc_id % 30) AS source_file, doc_id % 40 AS session, 'h' || (doc_id % 3) AS hall, '2024-01-' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') AS date, (doc_id % 10)::DOUBLE / 10 AS importance FROM documents)",
    "words": "words AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda w: w <> '')) AS term FROM drawers)",
    "queries": "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)",
    "qwords": "qwords AS (SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: w <> '')) AS term FROM queries)",
    "memories": f"memories AS (SELECT doc_id AS memory_id, text AS content, lang AS kind, source AS project, 1 AS version, doc_id % 7 <> 0 AS is_latest, (doc_id % 100)::DOUBLE / 100 AS confidence, 1.0::DOUBLE AS retention_strength, (0.001 * (1 + doc_id % 50))::DOUBLE AS decay_rate, doc_id % 60 AS access_count, {NOW} - to_days((doc_id % 400)::INT) AS last_accessed, {NOW} - to_days((doc_id % 700)::INT) AS created_at, CASE WHEN doc_id % 11 = 0 THEN {NOW} - to_days((doc_id % 5)::INT) END AS forget_after, (doc_id % 10)::DOUBLE / 10 AS strength, doc_id FROM documents)",
    "triples": "triples AS (SELECT o_orderkey AS triple_id, 'c' || o_custkey AS subject, o_orderstatus AS predicate, 'c' || ((o_custkey * 7 + o_orderkey) % 140 + 1) AS object, o_orderdate AS valid_from, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + to_days((o_orderkey % 300)::INT) END AS valid_to, o_orderdate AS t_created, CASE WHEN o_orderkey % 10 = 0 THEN o_orderdate + to_days(200) END AS t_expired, (o_orderkey % 100)::DOUBLE / 100 AS confidence, (1 + o_orderkey % 9)::DOUBLE / 10 AS weight FROM orders)",
    "entities": "entities AS (SELECT 'c' || c_custkey AS entity_id, c_name AS name FROM customer)",
    "observations": "observations AS (SELECT event_id AS id, user_id AS session_id, ts, event_type AS type, event_type || ' ' || (user_id % 20) AS title, 'p' || (user_id % 4) AS project, ['f' || (event_id % 37), 'g' || (event_id % 11)] AS files, [event_type, 'k' || (event_id % 13)] AS concepts, (1 + event_id % 10)::INT AS importance, (50 + event_id % 400)::BIGINT AS tokens, value, props FROM events)",
    "actions": "actions AS (SELECT o_orderkey AS action_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'in_progress' END AS status, (1 + o_orderkey % 5)::INT AS priority, 'p' || (o_custkey % 10) AS project, o_orderdate AS created_at FROM orders)",
    "action_edges": "action_edges AS (SELECT o_orderkey AS action_id, o_orderkey - 3 AS depends_on FROM orders WHERE o_orderkey % 4 = 0)",
    "leases": "leases AS (SELECT o_orderkey AS action_id, 'a' || (o_custkey % 5) AS agent_id, o_orderdate AS acquired_at, o_orderdate + to_days((o_orderkey * 11 % 12000)::INT) AS expires_at FROM orders)",
}


def sql(names: str, body: str) -> str:
    """``body`` after the named tables (comma-separated)."""
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names.split(",")) + body
