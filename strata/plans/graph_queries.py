"""Queries of the graph and of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..sources import tables as T
from ..streaming import live, suggestions
from .registry import EDGES, MEM, WRITES, query
from .text_queries import trim

# Memories of a graph: chats name a session and up to two files by tags, code lies in a file; others come from a manual source.
GM = MEM.replace("mem AS (", "mem0 AS (", 1) + """, mem AS (SELECT * REPLACE (CASE kind WHEN 'code_entity' THEN 'src\\f' || length(content) % 7 || '.ts' END AS sourceRef, 'manual' AS sourceType), CASE WHEN kind = 'chat_turn' THEN 'c' || (length(content) % 10) END AS session,
  CASE kind WHEN 'code_entity' THEN ['src/f' || length(content) % 7 || '.ts'] WHEN 'chat_turn' THEN list_distinct(['src/f' || length(content) % 5 || '.ts', 'src/f' || length(content) % 3 || '.ts']) ELSE [] END AS files FROM mem0)"""


def graph_memories(spark, d):
    m = T.memories(spark, d)
    n = F.length("content")
    file = lambda k: F.concat(F.lit("src/f"), (n % k).cast("string"), F.lit(".ts"))
    tags = F.when(F.col("kind") == "chat_turn", F.array(F.lit("x"), F.concat(F.lit("file:"), file(5)), F.concat(F.lit("file: "), file(3)), F.concat(F.lit("chat-file:c"), (n % 10).cast("string")))).otherwise(F.array("kind"))
    return m.withColumns({"tags": tags, "sourceRef": F.when(F.col("kind") == "code_entity", F.regexp_replace(file(7), "/", "\\\\")), "sourceType": F.lit("manual")})


def history(spark, d):
    """``events`` as snapshots of memories on main."""
    w = T.writes(spark, d).where("branch = 'main'")
    return w.select("projectId", "branch", "logicalId", "operation", (F.col("validFrom") / 1000).cast("long").alias("validFrom"), F.when(F.col("sourceRef") < "3", "chat_turn").otherwise("semantic").alias("kind"), F.lit("manual").alias("sourceType"), F.concat(F.lit("s"), "sourceRef").alias("sourceRef"), F.array().cast("array<string>").alias("tags"), F.when(F.col("sourceRef") == "4", " ").otherwise(F.col("title")).alias("title"))


def node(prefix: str, x: str) -> str:
    return f"'{prefix}_' || substr(sha1(projectId || '|main|' || {x}), 1, 24)"


def edge(a: str, b: str, kind: str, scope: str) -> str:
    return f"'gx_edge_' || substr(sha1(projectId || '|main|' || {a} || '|' || {b} || '|{kind}|' || {scope}), 1, 24)"


GE = f"""{GM}, {WRITES}, r AS (SELECT *, lastAccessedAt AS ats, strftime(make_timestamp(lastAccessedAt * 1000), '%Y-%m-%d') AS day FROM mem),
n AS (SELECT *, {node('gx_mem', 'id')} AS m, {node('gx_time', 'day')} AS dn, CASE WHEN session IS NOT NULL THEN {node('gx_session', 'session')} END AS sn FROM r),
f AS (SELECT projectId, kind, m, id, ats, unnest(files) AS file, unnest(range(1, len(files) + 1)) AS place FROM n WHERE len(files) > 0),
c AS (SELECT *, row_number() OVER (PARTITION BY projectId, file ORDER BY ats DESC, id) AS rank FROM f WHERE kind = 'code_entity'),
x AS (SELECT a.projectId, a.m AS f, c.m AS t, a.file, row_number() OVER (PARTITION BY a.m ORDER BY a.place, c.rank) - 1 AS k FROM f a JOIN c ON a.projectId = c.projectId AND a.file = c.file WHERE a.kind = 'chat_turn' QUALIFY k < 12),
h AS (SELECT projectId, logicalId, operation, validFrom // 1000 AS validFrom, strftime(make_timestamp(validFrom), '%Y-%m-%d') AS day, CASE WHEN sourceRef < '3' THEN 's' || sourceRef END AS session FROM w WHERE branch = 'main'),
hn AS (SELECT *, {node('gx_mem', 'logicalId')} AS m, {node('gx_time', 'day')} AS dn, CASE WHEN session IS NOT NULL THEN {node('gx_session', 'session')} END AS sn FROM h),
e AS (SELECT {edge('m', 'dn', 'derived_from', "'memory-day:' || ats")} AS id, m AS fromNode, dn AS toNode, 'derived_from' AS type, 0.62::DOUBLE AS weight, 'memory_time_bucket' AS relation FROM n
  UNION SELECT {edge('m', 'sn', 'derived_from', "'memory-session:' || id")}, m, sn, 'derived_from', 0.88, 'memory_session' FROM n WHERE sn IS NOT NULL
  UNION SELECT {edge('sn', 'dn', 'derived_from', "'session-day:' || day")}, sn, dn, 'derived_from', 0.67, 'session_time_bucket' FROM n WHERE sn IS NOT NULL
  UNION SELECT {edge('f', 't', 'explains', "'chat-code:' || file || ':' || k")}, f, t, 'explains', 0.74, 'chat_to_code' FROM x
  UNION SELECT {edge('dn', 'm', 'derived_from', "'snapshot:' || logicalId || ':' || validFrom || ':' || operation")}, dn, m, 'derived_from', CASE WHEN operation = 'delete' THEN 0.45 ELSE 0.7 END, 'snapshot_event' FROM hn
  UNION SELECT {edge('sn', 'm', 'derived_from', "'snapshot-session:' || logicalId || ':' || validFrom")}, sn, m, 'derived_from', CASE WHEN operation = 'delete' THEN 0.42 ELSE 0.79 END, 'session_snapshot' FROM hn WHERE sn IS NOT NULL),
nd AS (SELECT m AS id, projectId, 'memory' AS role FROM n UNION SELECT dn, projectId, 'day' FROM n UNION SELECT sn, projectId, 'session' FROM n WHERE sn IS NOT NULL UNION SELECT m, projectId, 'memory' FROM hn UNION SELECT dn, projectId, 'day' FROM hn UNION SELECT sn, projectId, 'session' FROM hn WHERE sn IS NOT NULL)"""


def indexed(spark, d):
    return graph.index_memories(graph_memories(spark, d), history(spark, d))


@query(f"WITH {GE} SELECT id, fromNode, toNode, type, weight, relation FROM e")
def index_memory_graph(spark, d):
    return indexed(spark, d)[1].select("id", "fromNode", "toNode", "type", "weight", "relation")


@query(f"""WITH {GE}, l AS (SELECT m AS id, CASE kind WHEN 'chat_turn' THEN 'chat' WHEN 'code_entity' THEN 'function' ELSE 'memory' END AS type FROM n UNION SELECT dn, 'concept' FROM n UNION SELECT sn, 'session' FROM n WHERE sn IS NOT NULL)
SELECT id, type, 'Day ' || day AS label FROM l JOIN (SELECT DISTINCT dn AS id, day FROM n) USING (id) UNION ALL SELECT id, type, 'Session ' || session FROM l JOIN (SELECT DISTINCT sn AS id, session FROM n WHERE sn IS NOT NULL) USING (id)
UNION ALL SELECT l.id, l.type, coalesce(nullif({trim('title')}, ''), n.id) FROM l JOIN n ON n.m = l.id""")
def graph_nodes(spark, d):
    return graph.index_memories(graph_memories(spark, d))[0].select("id", "type", "label")


@query(f"WITH {GE} SELECT (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(DISTINCT projectId) FROM nd) AS projects")
def graph_stats(spark, d):
    return graph.stats(*indexed(spark, d))


@query(f"""WITH {GE} SELECT (SELECT count(*) FROM mem) AS scannedMemories, (SELECT count(*) FROM h) AS scannedSnapshots, (SELECT count(*) FROM nd) AS nodesUpserted, (SELECT count(*) FROM nd WHERE role = 'memory') AS memoryNodes, (SELECT count(*) FROM nd WHERE role = 'session') AS sessionNodes,
  (SELECT count(*) FROM nd WHERE role = 'day') AS temporalNodes, (SELECT count(*) FROM e) AS edgesUpserted, count_if(relation IN ('memory_session', 'session_snapshot')) AS sessionEdges, count_if(relation IN ('memory_time_bucket', 'session_time_bucket', 'snapshot_event')) AS temporalEdges, count_if(relation = 'chat_to_code') AS chatToCodeEdges FROM e""")
def graph_index_counts(spark, d):
    m, s = graph_memories(spark, d), history(spark, d)
    return graph.index_counts(m, s, *graph.index_memories(m, s))


@query(f"WITH {EDGES} SELECT fromNode, toNode, round(weight, 6) AS weight FROM edges ORDER BY round(weight, 9) DESC, fromNode, toNode, type LIMIT 24")
def limit_traversal(spark, d):
    return graph.limit_traversal(T.edges(spark, d).withColumn("weight", F.round("weight", 9))).select("fromNode", "toNode", F.round("weight", 6).alias("weight"))


@query(f"WITH {EDGES}, x AS (SELECT toNode AS neighbor, type, weight, 'out' AS direction FROM edges WHERE fromNode = 'n3' AND weight >= 0.2 UNION ALL SELECT fromNode, type, weight, 'in' FROM edges WHERE toNode = 'n3' AND weight >= 0.2) SELECT neighbor, type, round(weight, 6) AS weight, direction FROM x ORDER BY round(weight, 9) DESC, neighbor LIMIT 40")
def query_neighbors(spark, d):
    return graph.neighbors(T.edges(spark, d).withColumn("weight", F.round("weight", 9)), "n3", 40, 0.2).withColumn("weight", F.round("weight", 6))


@query(f"WITH RECURSIVE {EDGES}, w(node, depth) AS (SELECT 'r1', 0 UNION SELECT toNode, depth + 1 FROM w JOIN edges ON fromNode = node WHERE depth < 2) SELECT node, min(depth) AS depth FROM w GROUP BY 1")
def reachable(spark, d):
    return graph.reachable(T.edges(spark, d), "r1", 2)


@query(f"""WITH {EDGES}, l1 AS (SELECT *, row_number() OVER (ORDER BY round(weight, 9) DESC, toNode, type) AS place, 1 AS depth FROM edges WHERE fromNode = 'r2' AND weight >= 0.1), f AS (SELECT toNode AS node, min(place) AS pp FROM l1 GROUP BY 1),
l2 AS (SELECT e.*, row_number() OVER (ORDER BY pp, round(e.weight, 9) DESC, e.toNode, e.type) + (SELECT count(*) FROM l1) AS place, 2 AS depth FROM edges e JOIN f ON e.fromNode = f.node WHERE weight >= 0.1)
SELECT place, fromNode, toNode, type, round(weight, 6) AS weight, depth FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) WHERE place <= 64""")
def traverse_graph(spark, d):
    return graph.traverse(T.edges(spark, d).withColumn("weight", F.round("weight", 9)), "r2", 2, 64, 0.1).withColumn("weight", F.round("weight", 6))


@query(f"WITH {EDGES} SELECT fromNode, toNode, type FROM edges WHERE fromNode NOT IN ('n1', 'n2') AND toNode NOT IN ('n1', 'n2')")
def remove_node(spark, d):
    gone = spark.createDataFrame([("n1",), ("n2",)], "id string")
    e = T.edges(spark, d)
    return graph.remove_node(gone, e, gone)[1].select("fromNode", "toNode", "type")


@query(f"WITH {EDGES}, x AS (SELECT fromNode, toNode, type, weight FROM edges UNION ALL SELECT fromNode, toNode, type, weight / 2 FROM edges) SELECT fromNode, toNode, type, round(max(weight), 6) AS weight, 'gx_edge_' || substr(sha1('p0|' || fromNode || '|' || toNode || '|' || type), 1, 24) AS id FROM x GROUP BY fromNode, toNode, type")
def upsert_graph_rows(spark, d):
    e = T.edges(spark, d)
    return graph.merge_edges(e.unionByName(e.withColumn("weight", F.col("weight") / 2))).select("fromNode", "toNode", "type", F.round("weight", 6).alias("weight"), "id")


FILES = ("auth", "test-error-bug", "plain", "crash error fix")


def watcher_events(spark, d):
    """``events`` as file events of five projects."""
    e = T.read(spark, d, "events")
    kind = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "unlink").otherwise("change")
    file = T.pick(FILES, F.col("user_id") % 4)
    return e.select(F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("projectId"), F.lit("main").alias("branch"), F.col("event_id").alias("eventId"), F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("atMs"), F.col("ts").cast("timestamp").alias("at"), kind.alias("type"), F.concat(F.lit("/src/"), file, (F.col("user_id") % 3).cast("string"), F.lit(".ts")).alias("path"))


RISKS = [("p0", "healthy"), ("p1", "warning"), ("p4", "critical")]


@query()
def context_stream(spark, d):
    """Bursts within a minute, as events of ``events`` come minutes apart; p3 has no context."""
    risks = spark.createDataFrame(RISKS, "projectId string, risk string")
    contexts = spark.createDataFrame([(f"p{k}", "" if k == 3 else "context") for k in range(5)], "projectId string, context string")
    return suggestions.suggestion_batch(watcher_events(spark, d), suggestions.Settings(debounce=60_000, dedupe=600_000), risks, contexts)


@query("""WITH e AS (SELECT event_id AS eventId, 'p' || user_id % 5 AS projectId, ['auth', 'test-error-bug', 'plain', 'crash error fix'][user_id % 4 + 1] || user_id % 3 || '.ts' AS f, event_type FROM events WHERE event_type <> 'error'),
q AS (SELECT *, CASE WHEN event_type = 'signup' THEN 'new file in ' ELSE 'file change in ' END || f || '; review file' AS query FROM e)
SELECT eventId, query, sha256(projectId || ':main:' || query || ':/src/' || f) AS hash, CASE WHEN f LIKE 'test%' OR f LIKE 'crash%' THEN 'debugging' ELSE 'general' END AS category, round(CASE WHEN f LIKE 'test%' THEN 0.5 WHEN f LIKE 'crash%' THEN 0.62 ELSE 0.45 END::DOUBLE, 6) AS confidence, projectId = 'p4' AS critical FROM q""")
def stream_gates(spark, d):
    """What the stateless gates look at."""
    made = suggestions.prepared(watcher_events(spark, d), spark.createDataFrame(RISKS, "projectId string, risk string"))
    return made.select("eventId", "query", "hash", "category", F.round("confidence", 6).alias("confidence"), "critical")


@query("""WITH e AS (SELECT 'p' || user_id % 5 AS projectId, event_id, ts, epoch_us(ts) AS us FROM events), g AS (SELECT *, CASE WHEN us - lag(us) OVER w < 300000000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY projectId ORDER BY us)),
s AS (SELECT *, sum(new) OVER (PARTITION BY projectId ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT projectId, count(*) AS n, max(event_id) AS lastEvent FROM s GROUP BY projectId, k""")
def debounce(spark, d):
    return suggestions.debounced(watcher_events(spark, d), "5 minutes").select("projectId", "n", "lastEvent")


@query("""SELECT CAST(epoch_us(time_bucket(INTERVAL 5 MINUTES, ts)) // 1000000 AS BIGINT) AS start, CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'unlink' ELSE 'change' END AS type, count(*) AS n FROM events GROUP BY ALL""")
def windowed_counts(spark, d):
    return suggestions.windowed_counts(watcher_events(spark, d)).select(F.unix_seconds("start").alias("start"), "type", "n")


@query("""WITH e AS (SELECT 'p' || user_id % 5 AS projectId, event_id, epoch_us(ts) // 1000 AS atMs, event_type AS category FROM events), g AS (SELECT *, CASE WHEN lag(category) OVER w IS NOT DISTINCT FROM category THEN 0 ELSE 1 END AS n FROM e WINDOW w AS (PARTITION BY projectId ORDER BY atMs, event_id)),
r AS (SELECT *, sum(n) OVER (PARTITION BY projectId ORDER BY atMs, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g), s AS (SELECT event_id AS eventId, row_number() OVER (PARTITION BY projectId, run ORDER BY atMs, event_id) AS seen FROM r)
SELECT eventId, CAST(seen AS BIGINT) AS seen, round(CASE WHEN seen > 1 THEN least(0.12::DOUBLE, 0.02::DOUBLE * seen) ELSE 0 END, 6) AS bonus FROM s""")
def intent_history(spark, d):
    e = watcher_events(spark, d).join(T.read(spark, d, "events").select(F.col("event_id").alias("eventId"), F.col("event_type").alias("category")), "eventId")
    return suggestions.with_history(e).select("eventId", F.col("seen").cast("long").alias("seen"), F.round("bonus", 6).alias("bonus"))


@query("""WITH e AS (SELECT CAST(user_id % 50 AS VARCHAR) AS h, epoch_us(ts) // 1000 AS atMs, event_type FROM events) SELECT a.h AS suggestionHash, a.atMs, a.atMs + 600000 AS expiresAt FROM e a WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM e b WHERE b.event_type = 'purchase' AND b.h = a.h AND b.atMs BETWEEN a.atMs AND a.atMs + 600000)""")
def suggestion_ttl(spark, d):
    e = T.read(spark, d, "events").select((F.col("user_id") % 50).cast("string").alias("suggestionHash"), F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("atMs"), "event_type")
    return suggestions.expired(e.where("event_type = 'view'"), e.where("event_type = 'purchase'").withColumn("status", F.lit("applied")), 600_000)


LIVES = """e AS (SELECT CAST(user_id % 50 AS VARCHAR) AS h, epoch_us(ts) // 1000 AS t, event_type, event_id FROM events), em AS (SELECT h, t, event_id FROM e WHERE event_type = 'view'),
ak AS (SELECT h, t, CASE event_type WHEN 'purchase' THEN 'applied' WHEN 'error' THEN 'suppressed' ELSE 'ack' END AS s FROM e WHERE event_type IN ('purchase', 'error', 'click')),
sd AS (SELECT em.h, em.t AS emitted, em.event_id, ak.t, s, coalesce(max(s <> 'ack') OVER (PARTITION BY em.event_id ORDER BY ak.t, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM em JOIN ak ON ak.h = em.h AND ak.t BETWEEN em.t AND em.t + 600000),
told AS (SELECT * FROM sd WHERE NOT ended)"""


@query(f"""WITH {LIVES} SELECT h AS suggestionHash, emitted AS emittedMs, CASE s WHEN 'ack' THEN 'contextDeltaAcked' WHEN 'applied' THEN 'contextDeltaApplied' ELSE 'contextDeltaSuppressed' END AS eventType, t AS atMs FROM told
UNION ALL SELECT h, t, 'contextDeltaExpired', t + 600000 FROM em WHERE event_id NOT IN (SELECT event_id FROM told WHERE s <> 'ack')""")
def suggestion_lives(spark, d):
    """What becomes of suggestions, of which views are; purchases apply, errors suppress and clicks acknowledge them."""
    e = T.read(spark, d, "events").select((F.col("user_id") % 50).cast("string").alias("suggestionHash"), F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("atMs"), "event_type")
    status = F.when(F.col("event_type") == "purchase", "applied").when(F.col("event_type") == "error", "suppressed").otherwise("ack")
    acks = e.where("event_type IN ('purchase', 'error', 'click')").withColumn("status", status)
    return live.lives_batch(e.where("event_type = 'view'"), acks, 600_000)
