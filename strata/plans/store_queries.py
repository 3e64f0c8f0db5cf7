"""Queries of the whole store: reads by branch and time, whole writes, compacted rows, health and links."""

from __future__ import annotations

import base64
import json

from pyspark.sql import functions as F

from ..functions import codec
from ..operators import compaction, evolution, ngram, records, scheduler, store
from ..sources import tables as T
from .core_queries import rounded
from .registry import MEM, MID_MS, NOW, RUNS, WRITES, query
from .text_queries import CUT_AT, NGRAM, model_of

P, B = "p0", "feature"


def store_tables(spark, d) -> store.Tables:
    """``events`` as a store of three branches, times in milliseconds."""
    w = T.writes(spark, d).withColumn("validFrom", F.expr("validFrom div 1000"))
    full = w.select(
        store.storage_id(F.col("projectId"), F.col("branch"), F.col("logicalId")).alias("id"), "logicalId", "projectId", "branch", F.lit("semantic").alias("kind"), F.lit("manual").alias("sourceType"), "title", "summary", "content",
        F.array().cast("array<string>").alias("tags"), "importance", "confidence", F.col("validFrom").alias("createdAt"), F.col("validFrom").alias("lastAccessedAt"), "sourceRef", F.lit(None).cast("string").alias("storageId"), "operation", "validFrom", "event_id",
    )
    latest = full.groupBy("projectId", "branch", "logicalId").agg(F.max_by(F.struct(*full.columns), F.struct("validFrom", "event_id")).alias("r")).select("r.*")
    rows = latest.where("operation = 'upsert'").select(*store.ROW)
    gone = latest.where("operation = 'delete' AND branch <> 'main'").select("projectId", "branch", "logicalId", "createdAt")
    branches = T.branches(spark).withColumns({"forkedFromCommit": F.lit(None).cast("string"), "createdAt": F.lit(1).cast("long"), "updatedAt": F.lit(1).cast("long")})
    return store.Tables(rows.where("branch = 'main'"), rows.where("branch <> 'main'"), gone, full, branches)


STORE = WRITES + """, sw AS (SELECT * REPLACE (validFrom // 1000 AS validFrom), CASE WHEN branch = 'main' THEN logicalId ELSE 'mem_branch_row_' || substr(sha1(projectId || '|' || branch || '|' || logicalId), 1, 24) END AS id FROM w),
latest AS (SELECT * FROM sw QUALIFY row_number() OVER (PARTITION BY branch, logicalId ORDER BY validFrom DESC, event_id DESC) = 1), line(branch, depth) AS (VALUES ('feature', 0), ('release', 1), ('main', 2)),
hidden AS (SELECT logicalId, min(depth) AS hid FROM latest JOIN line USING (branch) WHERE operation = 'delete' AND branch <> 'main' GROUP BY 1)"""


def viewed(where: str = "true") -> str:
    return f"""seen AS (SELECT n.* FROM (SELECT * FROM latest JOIN line USING (branch) WHERE operation = 'upsert' AND ({where}) QUALIFY row_number() OVER (PARTITION BY logicalId ORDER BY depth, validFrom DESC) = 1) n LEFT JOIN hidden USING (logicalId) WHERE hid IS NULL OR depth < hid)"""


HELD = f"""ended AS (SELECT *, lead(validFrom) OVER (PARTITION BY branch, logicalId ORDER BY validFrom, event_id) AS validUntil FROM sw),
held AS (SELECT * FROM (SELECT * FROM ended JOIN line USING (branch) WHERE validFrom <= {MID_MS} AND (validUntil IS NULL OR validUntil > {MID_MS}) QUALIFY row_number() OVER (PARTITION BY logicalId ORDER BY depth, validFrom DESC, event_id DESC) = 1) WHERE operation = 'upsert')"""


@query(f"WITH {STORE}, {viewed()} SELECT id, logicalId, branch, title, validFrom AS lastAccessedAt FROM seen ORDER BY validFrom DESC, id LIMIT 20")
def list_branch(spark, d):
    return store.listed(store_tables(spark, d), P, 20, B).select("id", "logicalId", "branch", "title", "lastAccessedAt")


@query(f"WITH {STORE}, {HELD} SELECT id, logicalId, branch, title FROM held ORDER BY validFrom DESC, id LIMIT 20")
def list_asof(spark, d):
    return store.listed(store_tables(spark, d), P, 20, B, MID_MS).select("id", "logicalId", "branch", "title")


@query(f"WITH {STORE}, {viewed()} SELECT id, logicalId, branch, title FROM seen WHERE logicalId = 'L7' UNION ALL SELECT * FROM (WITH {HELD} SELECT id, logicalId, branch, title FROM held WHERE logicalId = 'L8')")
def get_by_branch(spark, d):
    t = store_tables(spark, d)
    cols = ["id", "logicalId", "branch", "title"]
    return store.by_id(t, "L7", P, B).select(cols).unionByName(store.by_id(t, "L8", P, B, MID_MS).select(cols))


def lexical(rows: str, text: str) -> str:
    return f"""sc AS (SELECT id, logicalId, branch, CASE WHEN contains(lower(title), '{text}') OR contains(lower(summary), '{text}') THEN 0.82::DOUBLE WHEN contains(lower(content), '{text}') THEN 0.72::DOUBLE ELSE 0.6::DOUBLE END AS similarity, importance, validFrom FROM {rows}),
so AS (SELECT *, 0.5::DOUBLE * similarity + 0.3::DOUBLE * importance + 0.2::DOUBLE * exp(-1e-8::DOUBLE * greatest(0, {NOW} - validFrom)) AS score FROM sc)"""


@query(f"""WITH {STORE}, {viewed("title ILIKE '%view%' OR summary ILIKE '%view%' OR content ILIKE '%view%'")}, near AS (SELECT * FROM seen ORDER BY validFrom DESC, id LIMIT 80), {lexical('near', 'view')}
SELECT id, logicalId, branch, similarity, round(score, 6) AS score FROM so WHERE score >= 0.5 ORDER BY so.score DESC, id LIMIT 10""")
def search_branch(spark, d):
    return rounded(store.search(store_tables(spark, d), "view", NOW, P, B, k=10, min_score=0.5).select("id", "logicalId", "branch", "similarity", "score"))


@query(f"""WITH {STORE}, {HELD}, hit AS (SELECT * FROM held WHERE contains(lower(title || chr(10) || summary || chr(10) || content), 'view')), {lexical('hit', 'view')}
SELECT id, logicalId, branch, similarity, round(score, 6) AS score FROM so ORDER BY so.score DESC, id LIMIT 10""")
def search_branch_asof(spark, d):
    return rounded(store.search(store_tables(spark, d), "View", NOW, P, B, MID_MS, 10).select("id", "logicalId", "branch", "similarity", "score"))


def told(t: store.Tables):
    """All tables after a write, as rows (what, branch, logicalId, title, at)."""
    rows = t.memories.select("branch", "logicalId", "title", F.col("lastAccessedAt").alias("at")).unionByName(t.overlays.select("branch", "logicalId", "title", F.col("lastAccessedAt").alias("at")))
    ends = store.snapshots(t).where("validUntil IS NOT NULL").select("branch", "logicalId", "title", F.col("validUntil").alias("at"))
    parts = {"row": rows, "tombstone": t.tombstones.select("branch", "logicalId", F.lit("").alias("title"), F.col("createdAt").alias("at")), "version": t.log.select("branch", "logicalId", "title", F.col("validFrom").alias("at")), "ended": ends}
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("what"), "branch", "logicalId", "title", "at")
        out = part if out is None else out.unionByName(part)
    return out


AFTER = """ended AS (SELECT branch, logicalId, title, lead(validFrom) OVER (PARTITION BY branch, logicalId ORDER BY validFrom, event_id) AS at_ FROM version)
SELECT 'row' AS what, branch, logicalId, title, at_ AS "at" FROM stored UNION ALL SELECT 'tombstone', branch, logicalId, '', at_ FROM tomb UNION ALL SELECT 'version', branch, logicalId, title, validFrom FROM version UNION ALL SELECT 'ended', branch, logicalId, title, at_ FROM ended WHERE at_ IS NOT NULL"""


@query(f"""WITH {STORE}, input AS (SELECT ['main', 'feature', 'release'][n_nationkey % 3 + 1] AS branch, 'L' || n_nationkey * 3 AS logicalId, trim(n_name) AS title FROM nation),
stored AS (SELECT branch, logicalId, title, validFrom AS at_ FROM latest ANTI JOIN input USING (branch, logicalId) WHERE operation = 'upsert' UNION ALL SELECT branch, logicalId, title, {NOW} FROM input),
tomb AS (SELECT branch, logicalId, validFrom AS at_ FROM latest ANTI JOIN input USING (branch, logicalId) WHERE operation = 'delete' AND branch <> 'main'),
version AS (SELECT branch, logicalId, title, validFrom, event_id FROM sw UNION ALL SELECT branch, logicalId, title, {NOW}, {NOW} FROM input), {AFTER}""")
def upsert_whole(spark, d):
    k = F.col("n_nationkey")
    inputs = T.read(spark, d, "nation").select(F.lit(P).alias("projectId"), T.pick(("main", "feature", "release"), k % 3).alias("branch"), F.concat(F.lit("L"), (k * 3).cast("string")).alias("id"), F.lit("semantic").alias("kind"), F.concat(F.lit(" "), "n_name").alias("title"), F.lit("s").alias("summary"), F.repeat("n_name", 60).alias("content"))
    return told(store.upsert(store_tables(spark, d), inputs, NOW))


@query(f"""WITH {STORE}, {viewed()}, input AS (SELECT DISTINCT 'L' || n_nationkey * 4 AS logicalId FROM nation),
stored AS (SELECT branch, logicalId, title, validFrom AS at_ FROM latest l WHERE operation = 'upsert' AND NOT (branch = 'feature' AND logicalId IN (SELECT logicalId FROM input))),
tomb AS (SELECT branch, logicalId, validFrom AS at_ FROM latest WHERE operation = 'delete' AND branch <> 'main' AND NOT (branch = 'feature' AND logicalId IN (SELECT logicalId FROM input)) UNION ALL SELECT 'feature', logicalId, {NOW} FROM input),
version AS (SELECT branch, logicalId, title, validFrom, event_id FROM sw UNION ALL SELECT 'feature', logicalId, coalesce(title, 'Deleted memory ' || logicalId), {NOW}, {NOW} FROM input LEFT JOIN seen USING (logicalId)), {AFTER}""")
def delete_whole(spark, d):
    ids = T.read(spark, d, "nation").select(F.concat(F.lit("L"), (F.col("n_nationkey") * 4).cast("string")).alias("id"))
    return told(store.delete(store_tables(spark, d), ids, P, B, NOW))


# A fixed text and its envelopes: sound, with another checksum, and with a payload that can't be read.
PACKED_TEXT = "repeated words of a long memory " * 80


def envelopes() -> dict[str, str]:
    body = codec.envelope(codec.compact(PACKED_TEXT))
    packed = lambda x: codec.PREFIX + base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    return {"good": packed(body), "bad": packed(body | {"checksum": "0" * 24}), "broken": packed(body | {"payload": base64.b64encode(b"no text").decode()})}


ENVELOPES = envelopes()
STATE = "CASE WHEN {p} = 'src4' AND {k} % 7 = 2 THEN 'broken' WHEN {p} IN ('src2', 'src4') AND {k} % 9 = 0 THEN 'bad' WHEN {p} = 'src3' OR {k} % 3 = 1 THEN 'good' ELSE 'plain' END"


def mixed_memories(spark, d):
    """Memories some of which are stored compacted: all of src3, a third of the others, a few damaged ones."""
    m = T.memories(spark, d)
    state = F.expr(STATE.format(p="projectId", k="CAST(substring(id, 5) AS BIGINT)"))
    packed = F.coalesce(*(F.when(state == s, v) for s, v in ENVELOPES.items()))
    return m.withColumn("content", F.coalesce(packed, "content"))


STORED = "CASE st " + " ".join(f"WHEN '{s}' THEN {len(v)}" for s, v in ENVELOPES.items()) + " ELSE length(content) END"
MIXED = f"""{MEM}, mx0 AS (SELECT *, {STATE.format(p='projectId', k='CAST(substr(id, 5) AS BIGINT)')} AS st FROM mem), mx AS (SELECT *, {STORED} AS stored, CASE WHEN st = 'plain' THEN length(content) ELSE {len(PACKED_TEXT)} END AS original FROM mx0)"""
SUMS = """count(*) AS totalRows, count_if(st <> 'plain') AS compactedRows, count_if(st = 'plain') AS plainRows, sum(stored) AS storedChars, sum(original) AS originalChars, sum(original - stored) AS savedChars, count_if(st = 'bad') AS invalidChecksum, count_if(st = 'broken') AS decodeError"""
RATES = """round(savedChars * 100.0 / originalChars, 6)::DOUBLE AS savedPercent, round(compactedRows / totalRows, 6)::DOUBLE AS compactionRate, round(storedChars / originalChars, 6)::DOUBLE AS averageCompressionRatio, invalidChecksum + decodeError AS anomalies"""
RISK = "CASE WHEN anomalies > 0 THEN 'critical' WHEN totalRows >= 25 AND compactionRate < 0.5 THEN 'warning' WHEN totalRows >= 100 AND savedPercent < 5 THEN 'warning' ELSE 'healthy' END"


@query(f"WITH {MIXED}, s AS (SELECT {SUMS} FROM mx WHERE projectId = 'src2') SELECT *, {RATES} FROM s")
def compaction_stats(spark, d):
    return rounded(compaction.stats(mixed_memories(spark, d), "src2"))


BROKEN_DOWN = f"{MIXED}, s AS (SELECT projectId, {SUMS}, max(lastAccessedAt) AS lastAccessedAt FROM mx GROUP BY GROUPING SETS ((projectId), ())), b AS (SELECT *, {RATES} FROM s)"


@query(f"WITH {BROKEN_DOWN} SELECT *, {RISK} AS risk FROM b")
def project_breakdown(spark, d):
    return rounded(compaction.breakdown(mixed_memories(spark, d)))


def said(key: str) -> str:
    return "'" + compaction.HEALTH[key].replace("'", "''") + "'"


@query(f"""WITH {BROKEN_DOWN}, w AS (SELECT *, CASE WHEN anomalies > 0 THEN 'critical' WHEN totalRows >= 50 AND compactionRate < 0.5 THEN 'coverage' WHEN totalRows >= 120 AND savedPercent < 5 THEN 'savings' ELSE 'healthy' END AS why FROM b)
SELECT projectId, anomalies, CASE WHEN why IN ('coverage', 'savings') THEN 'warning' ELSE why END AS status, CASE why WHEN 'critical' THEN {said('critical')} WHEN 'coverage' THEN {said('coverage')} WHEN 'savings' THEN {said('savings')} ELSE {said('healthy')} END AS recommendation FROM w""")
def memory_health_signal(spark, d):
    return compaction.health(compaction.breakdown(mixed_memories(spark, d))).select("projectId", "anomalies", "status", "recommendation")


@query(f"""WITH {MIXED}, t AS (SELECT * FROM mx ORDER BY lastAccessedAt DESC, id LIMIT 500), s AS (SELECT {SUMS} FROM t)
SELECT *, {RATES}, round((invalidChecksum + decodeError) / compactedRows, 6)::DOUBLE AS anomalyRate, round(plainRows / totalRows, 6)::DOUBLE AS opportunityRate,
  list_filter([CASE WHEN invalidChecksum + decodeError > 0 THEN '{compaction.DAMAGED}' END, CASE WHEN plainRows / totalRows >= 0.2 THEN '{compaction.MANY_PLAIN}' END], lambda x: x IS NOT NULL) AS recommendations FROM s""")
def resurrection_audit(spark, d):
    return rounded(compaction.audit(mixed_memories(spark, d), 500)[0])


@query(f"""WITH {MIXED}, t AS (SELECT * FROM mx ORDER BY lastAccessedAt DESC, id LIMIT 5000) SELECT id, projectId, CASE st WHEN 'broken' THEN 'decode_error' ELSE 'invalid_checksum' END AS issue, lastAccessedAt FROM t WHERE st IN ('bad', 'broken') ORDER BY lastAccessedAt DESC, id LIMIT 10""")
def resurrection_issues(spark, d):
    return compaction.audit(mixed_memories(spark, d))[1]


@query(f"WITH {BROKEN_DOWN}, t AS (SELECT * FROM b WHERE projectId IS NOT NULL ORDER BY totalRows DESC, projectId LIMIT 5) SELECT coalesce(projectId, '*') AS projectId, totalRows, compactedRows, savedPercent, compactionRate, anomalies AS integrityAnomalyTotal FROM (SELECT * FROM t UNION ALL SELECT * FROM b WHERE projectId IS NULL)")
def persist_trend_snapshots(spark, d):
    return rounded(records.trend_snapshots(mixed_memories(spark, d), NOW, 5).select(F.coalesce("projectId", F.lit("*")).alias("projectId"), "totalRows", "compactedRows", "savedPercent", "compactionRate", "integrityAnomalyTotal"))


@query(f"WITH {BROKEN_DOWN} SELECT count(*) AS projectCount, count_if(anomalies > 0) AS projectsWithAnomalies, count_if(compactionRate >= 0.8) AS projectsMostlyCompacted FROM b WHERE projectId IS NOT NULL")
def dashboard_totals(spark, d):
    return records.dashboard(mixed_memories(spark, d), spark.createDataFrame([], "projectId string, createdAt long"))["totals"]


@query(f"WITH {BROKEN_DOWN} SELECT projectId, anomalies, savedChars, totalRows FROM b WHERE projectId IS NOT NULL ORDER BY anomalies DESC, savedChars DESC, totalRows DESC, projectId LIMIT 4")
def dashboard_projects(spark, d):
    return records.dashboard(mixed_memories(spark, d), spark.createDataFrame([], "projectId string, createdAt long"), 4)["perProject"].select("projectId", "anomalies", "savedChars", "totalRows")


@query(f"WITH {MIXED} SELECT id, sha1(CASE WHEN st = 'good' THEN repeat('repeated words of a long memory ', 80) WHEN st IN ('bad', 'broken') THEN substr(repeat('repeated words of a long memory ', 80), 1, 319) || '…' ELSE content END) AS content FROM mx")
def restore_contents(spark, d):
    """Whole contents; the preview where the checksum is wrong or the payload is broken."""
    return store.restored(mixed_memories(spark, d)).select("id", F.sha1("content").alias("content"))


DECIDED = f"""{RUNS}, r AS (SELECT runId, dryRunOnly, (startedAt // 60000) % 60 AS anomalies, (runId % 100) / 500.0::DOUBLE AS rate, runId % 7 AS compacted, hour(make_timestamp(startedAt * 1000)) AS h, CASE WHEN outcome = 'error' THEN runId % 3 ELSE 0 END AS errors FROM runs)"""


def decided_runs(spark, d):
    r = T.run_history(spark, d)
    return r.select("runId", "dryRunOnly", F.expr("(startedAt div 60000) % 60").alias("anomalies"), (F.col("runId") % 100 / 500).alias("opportunityRate"), (F.col("runId") % 7).alias("dryRunCompacted"), F.hour(F.timestamp_millis("startedAt")).alias("hour"), F.when(F.col("outcome") == "error", F.col("runId") % 3).otherwise(0).alias("ingestionErrors"))


@query(f"""WITH {DECIDED} SELECT runId, list_filter([CASE WHEN dryRunOnly THEN 'Manual dry-run only mode requested.' END, CASE WHEN anomalies > 40 THEN 'Anomaly guardrail blocked apply (' || anomalies || ' > 40).' END,
  CASE WHEN rate < 0.05 THEN 'Compaction opportunity below threshold (' || printf('%.4f', rate) || ' < 0.0500).' END, CASE WHEN compacted < 3 THEN 'Dry-run compacted rows below threshold (' || compacted || ' < 3).' END,
  CASE WHEN NOT (h >= 22 OR h < 3) THEN 'Current time is outside apply window [22:00-3:00).' END], lambda x: x IS NOT NULL) AS reasons, len(reasons) = 0 AS allowApply, CAST(800 AS INT) AS applyLimit FROM r""")
def apply_decision(spark, d):
    g = scheduler.Guardrails(max_anomalies=40, min_compacted=3, window_start=22, window_end=3, backfill_limit=800)
    return scheduler.apply_decision(decided_runs(spark, d), g).select("runId", "reasons", "allowApply", "applyLimit")


@query(f"""WITH {DECIDED} SELECT runId, list_filter([CASE WHEN dryRunOnly THEN 'Manual dry-run only mode requested.' END, 'Apply mode is disabled by configuration.', CASE WHEN errors > 0 THEN 'Ingestion produced ' || errors || ' errors; apply mode blocked.' END,
  CASE WHEN anomalies > 40 THEN 'Anomaly guardrail blocked apply (' || anomalies || ' > 40).' END, 'Apply limit resolved to 0 rows.', CASE WHEN compacted <= 0 THEN 'Dry-run detected no compactable rows.' END], lambda x: x IS NOT NULL) AS reasons FROM r""")
def session_apply_decision(spark, d):
    g = scheduler.Guardrails(apply_enabled=False, max_anomalies=40, backfill_limit=-5)
    return scheduler.session_decision(decided_runs(spark, d), g).select("runId", "reasons")


@query(f"""WITH {RUNS}, b(i, le) AS (VALUES (0, 0.01::DOUBLE), (1, 0.05), (2, 0.1), (3, 0.25), (4, 0.5), (5, 1.0), (6, 2.0), (7, 5.0), (8, 10.0), (9, 30.0), (10, 60.0)), c AS (SELECT trigger, outcome, i, count_if(durationMs / 1000 <= le) AS n FROM runs CROSS JOIN b GROUP BY ALL)
SELECT trigger, outcome, (SELECT count(*) FROM runs r WHERE r.trigger = c.trigger AND r.outcome = c.outcome) AS runs, list(n ORDER BY i) AS buckets FROM c GROUP BY trigger, outcome""")
def scheduler_metrics(spark, d):
    return scheduler.run_metrics(T.run_history(spark, d)).select("trigger", "outcome", "runs", "buckets")


@query(f"""WITH RECURSIVE {RUNS}, o AS (SELECT schedulerScope, runId, startedAt, durationMs * 60 AS took, row_number() OVER (PARTITION BY schedulerScope ORDER BY startedAt, runId) AS k FROM runs),
f(schedulerScope, runId, k, late, busy) AS (SELECT schedulerScope, runId, k, false, startedAt + took FROM o WHERE k = 1 UNION ALL SELECT o.schedulerScope, o.runId, o.k, o.startedAt < f.busy, CASE WHEN o.startedAt < f.busy THEN f.busy ELSE o.startedAt + o.took END FROM f JOIN o ON o.schedulerScope = f.schedulerScope AND o.k = f.k + 1)
SELECT schedulerScope, runId, late AS "overlaps" FROM f""")
def single_flight(spark, d):
    return scheduler.single_flight(T.run_history(spark, d).withColumn("durationMs", F.col("durationMs") * 60))


NAME = "regexp_extract(lower(text), '[a-z0-9_]{3,}')"


@query(f"""WITH {MEM}, e AS (SELECT DISTINCT {NAME} AS name, ['dep ' || item_id % 3, CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'fr' END] AS deps, item_id AS entityId FROM benchmark WHERE {NAME} <> ''),
m AS (SELECT id, importance, tags, regexp_replace(lower(summary), '[ \\t\\n\\r\\f\\x0B\\x{{00a0}}\\x{{feff}}]+', ' ', 'g') AS s FROM mem), p AS (SELECT m.id, e.entityId, contains(s, e.name) AS lexicalMatch, (list_contains(deps, tags[1])::INT + list_contains(deps, tags[2])::INT) / 2.0::DOUBLE AS dep, importance FROM m, e)
SELECT id, entityId, lexicalMatch, round(dep, 4) AS depMatch, round(least(0.98::DOUBLE, 0.55::DOUBLE + 0.25::DOUBLE * lexicalMatch::INT + 0.18::DOUBLE * dep + 0.02::DOUBLE * importance), 4) AS weight FROM p WHERE lexicalMatch OR dep > 0""")
def link_memory_entity(spark, d):
    """Every memory with every entity whose name its title or summary contains or whose dependencies share a tag."""
    b = T.read(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.regexp_extract(F.lower("text"), "[a-z0-9_]{3,}", 0).alias("name"), F.array(F.concat(F.lit("dep "), (F.col("item_id") % 3).cast("string")), F.when(F.col("item_id") % 2 == 0, "EN").otherwise("fr")).alias("dependencies"))
    return evolution.link_entities(T.memories(spark, d), b.where("name <> ''")).select("id", "entityId", "lexicalMatch", "depMatch", "weight")


@query("""WITH e AS (SELECT p_partkey AS k, lower(p_brand) AS name, [lower(p_type), lower(p_name)] AS deps FROM part), n AS (SELECT a.k AS fromId, b.k AS toId, a.deps, b.name FROM e a JOIN e b ON b.k = a.k + 1 UNION ALL SELECT a.k, -1, a.deps, substr(a.deps[1], 2, 4) FROM e a)
SELECT fromId, toId, CASE WHEN len(list_filter(deps, lambda x: contains(x, name))) > 0 THEN 0.82::DOUBLE ELSE 0.41::DOUBLE END AS weight, CASE WHEN len(list_filter(deps, lambda x: contains(x, name))) > 0 THEN 'dependency-name-match' ELSE 'co-located' END AS reason FROM n""")
def link_entity_dependency(spark, d):
    p = T.read(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_brand", F.array("p_type", "p_name").alias("dependencies"))
    nxt = p.select((F.col("k") - 1).alias("fromId"), F.col("k").alias("toId"), F.upper("p_brand").alias("toName")).join(p.select(F.col("k").alias("fromId"), "dependencies"), "fromId")
    own = p.select(F.col("k").alias("fromId"), F.lit(-1).cast("long").alias("toId"), F.substring(F.get("dependencies", F.lit(0)), 2, 4).alias("toName"), "dependencies")
    return evolution.link_dependencies(nxt.unionByName(own)).select("fromId", "toId", "weight", "reason")


# A candidate: title and summary, and snippets two of which it contains where its id is even.
CANDIDATE = """c AS (SELECT doc_id, trim(regexp_replace(substr(text, 1, 30), '[ \\t\\n\\r]+', ' ', 'g')) AS title, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS summary FROM documents),
s AS (SELECT *, title || chr(10) || summary AS body, CASE WHEN doc_id % 2 = 0 AND title <> '' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS novelty FROM c),
cq AS (SELECT *, length(body) AS n, len(regexp_extract_all(body, '[.;:!?]')) AS p FROM s), cv AS (SELECT *, least(1, n / 320.0::DOUBLE) * 0.7::DOUBLE + least(1, p / 5.0::DOUBLE) * 0.3::DOUBLE AS c1, least(1, n / 350.0::DOUBLE) * 0.65::DOUBLE + least(1, p / 6.0::DOUBLE) * 0.35::DOUBLE AS c2 FROM cq)"""
ACTION = "CASE WHEN score >= 0.8 THEN 'merge' WHEN score >= 0.6 THEN 'store' WHEN score >= 0.42 THEN 'compress' ELSE 'reject' END"


def candidates(spark, d):
    flat = F.trim(F.regexp_replace("text", "[ \t\n\r]+", " "))
    c = T.read(spark, d, "documents").select("doc_id", F.trim(F.regexp_replace(F.substring("text", 1, 30), "[ \t\n\r]+", " ")).alias("title"), flat.alias("summary"))
    own = F.when(F.col("doc_id") % 2 == 0, F.col("title")).otherwise(F.lit("\x02 nowhere"))
    return c.withColumn("snippets", F.array(own, F.lit("\x02 no text has this")))


@query(f"""WITH {CANDIDATE}, r AS (SELECT *, novelty * 0.62::DOUBLE + c1 * 0.38::DOUBLE AS s1, novelty * 0.6::DOUBLE + c2 * 0.4::DOUBLE AS s2 FROM cv), w AS (SELECT *, (s1 + s2) / 2 AS score FROM r)
SELECT doc_id, round(score, 6) AS score, novelty, 1 - novelty AS redundancy, round((c1 + c2) / 2, 6) AS clarity, {ACTION} AS action, score >= 0.42 AS accepted, CASE WHEN score >= 0.42 THEN 'fallback-heuristic' WHEN s2 >= 0.35 THEN 'accepted-by-heuristic' ELSE 'low-signal' END AS reason FROM w""")
def critic_fallback(spark, d):
    made = candidates(spark, d).select("doc_id", evolution.critic_fallback(F.col("title"), F.col("summary"), F.col("snippets")).alias("r"))
    return rounded(made.select("doc_id", "r.score", "r.novelty", "r.redundancy", "r.clarity", "r.action", "r.accepted", "r.reason"))


@query(f"""WITH {CANDIDATE}, {NGRAM}, db AS (SELECT doc_id, unnest(ts[:-2]) AS a, unnest(ts[2:]) AS b FROM tok WHERE len(ts) > 1), ex0 AS (SELECT doc_id, avg(1 - coalesce(q, 0) / 127) AS e FROM db LEFT JOIN v x ON a = x.token LEFT JOIN v y ON b = y.token LEFT JOIN tr ON fromId = coalesce(x.tokenId, 0) AND toId = coalesce(y.tokenId, 0) GROUP BY 1),
r AS (SELECT cv.*, novelty * 0.7::DOUBLE + coalesce(e, 0.5) * 0.3::DOUBLE AS nv, c2 * 0.9::DOUBLE + least(1, length(summary) / 300.0::DOUBLE) * 0.1::DOUBLE AS cl FROM cv LEFT JOIN ex0 USING (doc_id)), w AS (SELECT *, nv * 0.62::DOUBLE + cl * 0.38::DOUBLE AS score FROM r)
SELECT doc_id, round(score, 6) AS score, round(nv, 6) AS novelty, round(cl, 6) AS clarity, {ACTION} AS action, CASE WHEN score >= 0.8 THEN regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END AS mergeKey FROM w""")
def critic_ngram(spark, d):
    """The novelty that the review expects is that of the whole text under a model of all texts."""
    expected = ngram.novelty(T.read(spark, d, "documents"), model_of(spark, d)).select("doc_id", F.col("novelty").alias("expected"))
    made = candidates(spark, d).join(expected, "doc_id").select("doc_id", evolution.critic_ngram(F.col("title"), F.col("summary"), F.col("snippets"), F.col("expected")).alias("r"))
    return rounded(made.select("doc_id", "r.score", "r.novelty", "r.clarity", "r.action", "r.mergeKey"))


SHORT = "regexp_replace(CASE WHEN e > 99 THEN substr(h, 1, e + 1) ELSE h END, '[ \\t\\n\\r]+$', '') || '…'"


@query(f"""WITH {CANDIDATE}, r AS (SELECT doc_id, title, summary, ((novelty * 0.62::DOUBLE + c1 * 0.38::DOUBLE) + (novelty * 0.6::DOUBLE + c2 * 0.4::DOUBLE)) / 2 AS score, (c1 + c2) / 2 AS clarity, doc_id % 4 AS k FROM cv),
a AS (SELECT *, {ACTION} AS action, CASE k WHEN 0 THEN 'code_entity' WHEN 1 THEN 'procedural' ELSE 'semantic' END AS kind, substr(summary, 1, 180) AS h FROM r), e AS (SELECT *, {CUT_AT} AS e FROM a WHERE score >= 0.42),
f AS (SELECT *, round(least(1, score + CASE k WHEN 0 THEN 0.03 WHEN 1 THEN 0.02 ELSE 0 END + CASE WHEN clarity >= 0.85 THEN 0.02 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 0.08 ELSE 0 END), 4)::DOUBLE AS i, round(clarity, 4)::DOUBLE AS c FROM e)
SELECT doc_id AS id, action, CASE WHEN action <> 'compress' OR length(summary) <= 180 THEN summary ELSE {SHORT} END AS summary, CASE WHEN i >= 0.82 AND c >= 0.82 THEN greatest(i, 0.9::DOUBLE) ELSE i END AS importance, c AS confidence, CASE WHEN doc_id % 5 = 0 THEN 'Keep' ELSE 'x' END || CASE WHEN i >= 0.82 AND c >= 0.82 THEN ',promoted' ELSE '' END AS tags,
  NOT (i < 0.22 AND c < 0.45 AND doc_id % 5 <> 0) AS stored FROM f""")
def settle_candidates(spark, d):
    """Reviewed candidates as what is stored; every fifth has a tag that protects it."""
    k = F.col("doc_id")
    r = candidates(spark, d).withColumn("r", evolution.critic_fallback(F.col("title"), F.col("summary"), F.col("snippets")))
    kind = F.when(k % 4 == 0, "code_entity").when(k % 4 == 1, "procedural").otherwise("semantic")
    made = r.select(k.alias("id"), F.lit(P).alias("projectId"), kind.alias("kind"), "title", "summary", F.col("summary").alias("content"), F.array(F.when(k % 5 == 0, "Keep").otherwise("x")).alias("tags"), "r.action", "r.score", "r.clarity")
    out = evolution.settle(made, NOW)
    return out.select("id", "action", "summary", "importance", "confidence", F.array_join("tags", ",").alias("tags"), "stored")


@query("""WITH b(branch, createdAt) AS (SELECT 'b' || n_nationkey, n_nationkey % 4 FROM nation) SELECT branch, createdAt, row_number() OVER (ORDER BY createdAt, branch) AS place FROM b""")
def list_branches(spark, d):
    k = F.col("n_nationkey")
    b = T.read(spark, d, "nation").select(F.lit(P).alias("projectId"), F.concat(F.lit("b"), k.cast("string")).alias("branch"), F.lit(None).cast("string").alias("parentBranch"), F.lit(None).cast("string").alias("forkedFromCommit"), (k % 4).cast("long").alias("createdAt"), k.cast("long").alias("updatedAt"))
    return records.list_branches(b, P).select("branch", F.col("createdAt").cast("int").alias("createdAt"), F.col("place").cast("long").alias("place"))

