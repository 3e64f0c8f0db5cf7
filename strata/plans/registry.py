"""The catalogue of queries: each a function of (spark, sf_dir) and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# The adapters of sources.tables, as common table expressions.
MEM = """mem AS (SELECT 'doc_' || d.doc_id AS id, d.source AS projectId,
  ['episodic', 'semantic', 'procedural', 'code_entity', 'chat_turn', 'refactor_plan'][d.doc_id % 6 + 1] AS kind, ['code', 'chat', 'manual', 'system'][d.doc_id % 4 + 1] AS sourceType,
  substr(d.text, 1, 72) AS title, substr(d.text, 1, 180) AS summary, d.text AS content, [d.lang, d.source] AS tags, coalesce(0.4::DOUBLE + 0.4::DOUBLE * g.quality, 0.6::DOUBLE) AS importance,
  coalesce(0.9::DOUBLE - 0.3::DOUBLE * g.toxic, 0.75::DOUBLE) AS confidence, 1704067200000 + d.doc_id * 60000 AS createdAt, 1704067200000 + d.doc_id * 60000 + d.doc_id * 7919 % 86400 * 1000 AS lastAccessedAt,
  'src/' || d.lang || '/' || d.doc_id % 97 || '.ts' AS sourceRef FROM documents d LEFT JOIN labels g USING (doc_id))"""
WRITES = """w AS (SELECT 'p0' AS projectId, ['main', 'feature', 'release'][user_id % 3 + 1] AS branch, 'L' || user_id % 50 AS logicalId, event_id,
  CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS operation, epoch_us(ts) AS validFrom, event_type || ' ' || event_id AS title, event_type AS summary, props AS content,
  least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 100)) AS importance, 0.75::DOUBLE AS confidence, CAST(user_id % 7 AS VARCHAR) AS sourceRef FROM events)"""
SNAP = WRITES + """, snap AS (SELECT *, lead(validFrom) OVER (PARTITION BY projectId, branch, logicalId ORDER BY validFrom, event_id) AS validUntil FROM w)"""
CUR = WRITES + """, cur AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY projectId, branch, logicalId ORDER BY validFrom DESC, event_id DESC) = 1)"""
RUNS = """runs AS (SELECT event_id AS runId, 'scope' || user_id % 5 AS schedulerScope, ['timer', 'manual', 'startup'][event_id % 3 + 1] AS trigger,
  CASE event_type WHEN 'purchase' THEN 'applied' WHEN 'view' THEN 'dry-run-only' WHEN 'click' THEN 'indexed' WHEN 'signup' THEN 'skipped' ELSE 'error' END AS outcome, event_type = 'view' AS dryRunOnly,
  epoch_us(ts) // 1000 AS startedAt, CAST(floor(value * 10) AS BIGINT) AS durationMs FROM events)"""
EDGES = """edges AS (SELECT 'r' || n_regionkey AS fromNode, 'n' || n_nationkey AS toNode, 'contains' AS type, 0.9::DOUBLE - n_nationkey * 0.01::DOUBLE AS weight FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'has', (c_custkey % 100) / 100.0::DOUBLE FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'has', (s_suppkey % 50) / 50.0::DOUBLE FROM supplier)"""

NOW = 1704067200000 + 40 * 86400000
#: 2024-01-16 in microseconds and milliseconds, inside the events.
MID_US, MID_MS = 1705363200000000, 1705363200000
