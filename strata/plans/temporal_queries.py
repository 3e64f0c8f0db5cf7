"""Queries over history, branches, runs and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import records, scheduler, temporal, windows
from ..sources import tables as T
from ..streaming import live
from .core_queries import rounded
from .registry import CUR, MEM, MID_MS, MID_US, NOW, RUNS, SNAP, WRITES, query


def snapshots(spark, d):
    return temporal.close_intervals(T.writes(spark, d))


def line(spark, branch="feature"):
    return temporal.lineage(spark, T.branches(spark), "p0", branch)


LINE = "line(branch, depth) AS (VALUES ('feature', 0), ('release', 1), ('main', 2))"
LATE_US = MID_US + 10 * 86400 * 1000000


def as_of(at: int, name: str) -> str:
    return f"{name} AS (SELECT * FROM snap JOIN line USING (branch) WHERE validFrom <= {at} AND (validUntil IS NULL OR validUntil > {at}) QUALIFY row_number() OVER (PARTITION BY logicalId ORDER BY depth, validFrom DESC, event_id DESC) = 1)"


@query(f"WITH {SNAP} SELECT logicalId, branch, validFrom, operation, title FROM snap WHERE branch = 'main' AND validFrom <= {MID_US} AND (validUntil IS NULL OR validUntil > {MID_US})")
def scan_snapshots_asof(spark, d):
    s = snapshots(spark, d)
    return s.where((F.col("branch") == "main") & (F.col("validFrom") <= MID_US) & (F.col("validUntil").isNull() | (F.col("validUntil") > MID_US))).select("logicalId", "branch", "validFrom", "operation", "title")


@query(f"WITH {WRITES} SELECT logicalId, event_id, validFrom, coalesce(nullif(trim(title), ''), 'Memory ' || logicalId) AS title FROM w WHERE branch = 'main' AND validFrom >= {MID_US} ORDER BY validFrom DESC, event_id DESC LIMIT 200")
def scan_snapshots_since(spark, d):
    return windows.history_since(T.writes(spark, d), "main", MID_US).select("logicalId", "event_id", "validFrom", "title")


@query(f"WITH {SNAP} SELECT event_id, logicalId, branch, validFrom, coalesce(validUntil, -1) AS validUntil FROM snap")
def close_open_snapshot(spark, d):
    return snapshots(spark, d).select("event_id", "logicalId", "branch", "validFrom", F.coalesce("validUntil", F.lit(-1)).alias("validUntil"))


# Every customer is a branch of its nation: it begins from the branch of half its number, if that is of the same nation.
BRANCHES = "b AS (SELECT 'n' || c.c_nationkey AS projectId, 'b' || c.c_custkey AS branch, 'b' || p.c_custkey AS parent, c.c_custkey AS k FROM customer c LEFT JOIN customer p ON p.c_nationkey = c.c_nationkey AND p.c_custkey = c.c_custkey // 2 AND p.c_custkey <> c.c_custkey)"


def customer_branches(spark, d):
    c = T.read(spark, d, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("projectId"), F.col("c_custkey").cast("long").alias("k"))
    parent = c.select("projectId", F.col("k").alias("p"), F.concat(F.lit("b"), F.col("k").cast("string")).alias("parentBranch"))
    return c.withColumns({"branch": F.concat(F.lit("b"), F.col("k").cast("string")), "p": F.expr("k div 2")}).join(parent, ["projectId", "p"], "left").select("projectId", "branch", "parentBranch")


@query(f"""WITH RECURSIVE {BRANCHES}, l AS (SELECT projectId, branch AS start, branch, parent, 0 AS depth FROM b UNION ALL SELECT b.projectId, l.start, b.branch, b.parent, l.depth + 1 FROM l JOIN b ON b.projectId = l.projectId AND b.branch = l.parent WHERE l.depth < 31)
SELECT projectId, start, branch, depth FROM l UNION ALL SELECT projectId, start, 'main', max(depth) + 1 FROM l GROUP BY ALL""")
def branch_lineage(spark, d):
    """The lineages of all branches of all projects."""
    return temporal.lineages(customer_branches(spark, d)).select("projectId", "start", "branch", "depth")


@query(f"WITH {SNAP}, {LINE}, {as_of(MID_US, 's')} SELECT logicalId, branch, operation, validFrom, title FROM s")
def branch_state_asof(spark, d):
    return temporal.state_as_of(snapshots(spark, d), line(spark), MID_US).select("logicalId", "branch", "operation", "validFrom", "title")


@query(f"""WITH {CUR}, {LINE}, h AS (SELECT logicalId, min(depth) AS hid FROM cur JOIN line USING (branch) WHERE operation = 'delete' GROUP BY 1),
n AS (SELECT * FROM cur JOIN line USING (branch) WHERE operation = 'upsert' QUALIFY row_number() OVER (PARTITION BY logicalId ORDER BY depth, validFrom DESC) = 1)
SELECT n.logicalId, n.branch, n.title, n.validFrom FROM n LEFT JOIN h USING (logicalId) WHERE hid IS NULL OR depth < hid""")
def current_branch_view(spark, d):
    c = T.current_rows(spark, d)
    return temporal.branch_view(c.where("operation = 'upsert'"), c.where("operation = 'delete'").select("branch", "logicalId"), line(spark), True, F.desc("validFrom")).select("logicalId", "branch", "title", "validFrom")


@query(f"""WITH {CUR}, {LINE}, h AS (SELECT DISTINCT logicalId FROM cur JOIN line USING (branch) WHERE operation = 'delete'),
n AS (SELECT * FROM cur JOIN line USING (branch) WHERE operation = 'upsert' QUALIFY row_number() OVER (PARTITION BY logicalId ORDER BY depth, validFrom DESC) = 1) SELECT logicalId, branch FROM n ANTI JOIN h USING (logicalId)""")
def tombstone_anti_join(spark, d):
    c = T.current_rows(spark, d)
    return temporal.branch_view(c.where("operation = 'upsert'"), c.where("operation = 'delete'").select("branch", "logicalId"), line(spark), False, F.desc("validFrom")).select("logicalId", "branch")


@query(f"""WITH {SNAP}, {LINE}, {as_of(MID_US, 's')}, {as_of(LATE_US, 't')}, a AS (SELECT * FROM s WHERE operation <> 'delete'), b AS (SELECT * FROM t WHERE operation <> 'delete'),
x AS (SELECT coalesce(a.logicalId, b.logicalId) AS logicalId, CASE WHEN a.logicalId IS NULL THEN 'added' WHEN b.logicalId IS NULL THEN 'removed' WHEN a.title IS DISTINCT FROM b.title OR a.summary IS DISTINCT FROM b.summary OR a.content IS DISTINCT FROM b.content
  OR a.sourceRef IS DISTINCT FROM b.sourceRef OR abs(a.importance - b.importance) > 1e-6 OR abs(a.confidence - b.confidence) > 1e-6 THEN 'modified' END AS change, a.title AS beforeTitle, b.title AS afterTitle FROM a FULL JOIN b ON a.logicalId = b.logicalId)
SELECT * FROM x WHERE change IS NOT NULL""")
def temporal_diff(spark, d):
    s, b = snapshots(spark, d), line(spark)
    return temporal.diff(temporal.state_as_of(s, b, MID_US), temporal.state_as_of(s, b, LATE_US))


@query(f"""WITH {SNAP}, {LINE}, {as_of(MID_US, 's')} SELECT logicalId, title, importance FROM s WHERE operation <> 'delete' AND contains(lower(title || chr(10) || summary || chr(10) || content), 'view')""")
def search_asof(spark, d):
    from ..operators.retrieval import contains_ci

    return contains_ci(temporal.state_as_of(snapshots(spark, d), line(spark), MID_US).where("operation <> 'delete'"), "view").select("logicalId", "title", "importance")


def merge_sql(strategy: str) -> str:
    held = "" if strategy == "source-wins" else " AND logicalId NOT IN (SELECT logicalId FROM cur WHERE branch = 'main')"
    return f"WITH {CUR} SELECT count(*) AS mergedRows, count_if(operation = 'upsert'{held}) AS appliedUpserts, count_if(operation = 'delete'{held}) AS appliedDeletes, count(*) - count_if(true{held}) AS skipped FROM cur WHERE branch = 'feature'"


def merge(spark, d, strategy):
    c = T.current_rows(spark, d)
    return temporal.merge_branch(c.where("operation = 'upsert'"), c.where("operation = 'delete'").select("branch", "logicalId"), "feature", "main", strategy)[2]


@query(merge_sql("source-wins"))
def merge_branch(spark, d):
    return merge(spark, d, "source-wins")


@query(merge_sql("target-wins"))
def merge_target_anti(spark, d):
    return merge(spark, d, "target-wins")


@query(f"WITH {CUR}, base AS (SELECT * FROM cur WHERE branch = 'main' AND operation = 'upsert'), delta AS (SELECT * FROM cur WHERE branch = 'feature' AND operation = 'upsert') SELECT logicalId, title FROM delta UNION ALL SELECT logicalId, title FROM base ANTI JOIN delta USING (logicalId)")
def upsert_memory(spark, d):
    c = T.current_rows(spark, d).where("operation = 'upsert'").select("branch", "logicalId", "title")
    return temporal.merge_rows(c.where("branch = 'main'"), c.where("branch = 'feature'"), ["logicalId"]).select("logicalId", "title")


@query(f"WITH {CUR} SELECT count(DISTINCT logicalId) AS deleted FROM cur WHERE branch = 'main' AND logicalId IN (SELECT logicalId FROM cur WHERE branch = 'feature' AND operation = 'delete')")
def delete_many(spark, d):
    c = T.current_rows(spark, d)
    return temporal.delete_rows(c.where("branch = 'main'"), c.where("branch = 'feature' AND operation = 'delete'"), ["logicalId"])[1]


@query(f"WITH {CUR} SELECT logicalId, branch FROM cur WHERE branch = 'main' AND logicalId NOT IN (SELECT logicalId FROM cur WHERE branch = 'feature' AND operation = 'delete')")
def delete_memory(spark, d):
    c = T.current_rows(spark, d)
    return temporal.delete_rows(c.where("branch = 'main'"), c.where("branch = 'feature' AND operation = 'delete'"), ["logicalId"])[0].select("logicalId", "branch")


@query(f"WITH {SNAP}, cur AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY projectId, branch, logicalId ORDER BY validFrom DESC, event_id DESC) = 1) SELECT branch, logicalId FROM cur ANTI JOIN (SELECT * FROM snap WHERE validFrom < {MID_US} AND operation = 'upsert' AND validUntil IS NULL) USING (projectId, branch, logicalId)")
def baseline_snapshots(spark, d):
    return temporal.baseline(T.current_rows(spark, d), snapshots(spark, d).where(F.col("validFrom") < MID_US)).select("branch", "logicalId")


@query(f"WITH {RUNS} SELECT schedulerScope, count(*) AS n, count_if(outcome = 'error') AS errors FROM (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY schedulerScope ORDER BY startedAt DESC, runId DESC) <= 100) GROUP BY 1")
def persist_run_history(spark, d):
    return temporal.keep_newest(T.run_history(spark, d), "schedulerScope", "startedAt", "runId", 100).groupBy("schedulerScope").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "error").alias("errors"))


@query(f"WITH {RUNS} SELECT outcome, count(*) AS n FROM runs WHERE startedAt >= {MID_MS} AND schedulerScope = 'scope1' GROUP BY 1")
def outcome_counts_since(spark, d):
    return windows.outcomes_since(T.run_history(spark, d), "scope1", MID_MS)


@query(f"""WITH {RUNS}, win(minutes) AS (VALUES (60), (1440), (10080)) SELECT minutes, count(runId) AS total, count_if(outcome = 'applied') AS applied, count_if(outcome = 'dry-run-only') AS dryRunOnly, count_if(outcome = 'indexed') AS indexed, count_if(outcome = 'skipped') AS skipped, count_if(outcome = 'error') AS error,
  round(CASE WHEN count(runId) = 0 THEN 1 ELSE (count(runId) - count_if(outcome = 'error'))::DOUBLE / count(runId) END, 6) AS successRate, round(CASE WHEN count(runId) = 0 THEN 0 ELSE count_if(outcome = 'error')::DOUBLE / count(runId) END, 6) AS errorRate,
  round(CASE WHEN count(runId) = 0 THEN 0 ELSE count_if(outcome = 'applied')::DOUBLE / count(runId) END, 6) AS applyRate, round(CASE WHEN count(runId) = 0 THEN 0 ELSE count_if(outcome IN ('applied', 'indexed'))::DOUBLE / count(runId) END, 6) AS indexRate
FROM win LEFT JOIN runs ON startedAt > {MID_MS} - minutes * 60000 AND startedAt <= {MID_MS} GROUP BY minutes""")
def slo_windows(spark, d):
    return rounded(scheduler.slo_windows(T.run_history(spark, d), MID_MS))


@query(f"""WITH {RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY schedulerScope ORDER BY startedAt DESC, runId DESC) AS rn FROM runs WHERE outcome <> 'skipped')
SELECT schedulerScope, coalesce(min(rn) FILTER (outcome <> 'error') - 1, count(*)) AS consecutiveFailures FROM r GROUP BY 1""")
def consecutive_failures(spark, d):
    return scheduler.consecutive_failures(T.run_history(spark, d))


@query(f"""WITH {RUNS}, h AS (SELECT runId, hour(make_timestamp(startedAt * 1000)) AS h FROM runs) SELECT runId, true AS always, h >= 10 AND h < 13 AS byDay, h >= 22 OR h < 3 AS byNight FROM h""")
def is_within_apply_window(spark, d):
    h = F.hour(F.timestamp_millis(F.col("startedAt")))
    at = lambda a, b: scoring.in_apply_window(h, F.lit(a), F.lit(b))
    return T.run_history(spark, d).select("runId", at(0, 0).alias("always"), at(10, 13).alias("byDay"), at(22, 3).alias("byNight"))


@query(f"""WITH {RUNS}, f AS (SELECT runId, runId % 9 AS failures FROM runs) SELECT runId, CAST(greatest(1000, floor(least(60000.0::DOUBLE, 1000 * pow(2.0::DOUBLE, greatest(0, failures - 1))) + runId % 250)) AS BIGINT) AS delay FROM f""")
def backoff_delay(spark, d):
    return T.run_history(spark, d).select("runId", scoring.backoff_delay(F.lit(1000), 2.0, F.col("runId") % 9, 60_000, F.col("runId") % 250).alias("delay"))


@query("""WITH m AS (SELECT 'GET' AS method, '/r/' || user_id % 4 AS route, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value * 20 / 1000 AS seconds FROM events),
b(le) AS (VALUES (0.005::DOUBLE), (0.01), (0.025), (0.05), (0.1), (0.25), (0.5), (1.0), (2.5), (5.0), (10.0)) SELECT route, status, le, count_if(seconds <= le) AS n FROM m CROSS JOIN b GROUP BY ALL""")
def http_histogram(spark, d):
    e = T.read(spark, d, "events").select(F.concat(F.lit("/r/"), (F.col("user_id") % 4).cast("string")).alias("route"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), (F.col("value") * 20 / 1000).alias("seconds"))
    return scheduler.histogram(e, ["route", "status"], "seconds", scheduler.HTTP_BUCKETS)


# Snapshots of the trend as they would be taken on four days: of the memories made until then.
DAYS = [NOW - k * 5 * 86_400_000 for k in (4, 3, 2, 0)]
TRENDS = f"""{MEM}, days(at_) AS (VALUES {', '.join(f'({t})' for t in DAYS)}), seen AS (SELECT at_, projectId, length(content) AS n FROM days JOIN mem ON createdAt + (CAST(substr(id, 5) AS BIGINT) % 41) * 86400000 <= at_),
g AS (SELECT at_ AS createdAt, projectId, count(*) AS totalRows, sum(n) AS chars FROM seen GROUP BY GROUPING SETS ((at_, projectId), (at_))), tr AS (SELECT * FROM g QUALIFY projectId IS NULL OR row_number() OVER (PARTITION BY createdAt, projectId IS NULL ORDER BY totalRows DESC, projectId) <= 20)"""


def trend_rows(spark, d):
    """Each memory is made some days after its time, by its number, so that the days differ."""
    m = T.memories(spark, d).withColumn("createdAt", F.col("createdAt") + F.substring("id", 5, 20).cast("long") % 41 * 86_400_000)
    made = [records.trend_snapshots(m.where(F.col("createdAt") <= t), t) for t in DAYS]
    out = made[0]
    for other in made[1:]:
        out = out.unionByName(other)
    return out


@query(f"WITH {TRENDS} SELECT projectId, totalRows, createdAt FROM (SELECT *, row_number() OVER (ORDER BY createdAt DESC) AS k FROM tr WHERE projectId IS NULL AND createdAt >= {DAYS[1]}) WHERE k <= 2")
def scan_trend(spark, d):
    """The last two of the trend's rows of all projects, from the second day on."""
    return windows.trend(trend_rows(spark, d), None, DAYS[1], 2).select("projectId", "totalRows", "createdAt")


@query(f"WITH {TRENDS} SELECT projectId, arg_max(totalRows, createdAt) - arg_min(totalRows, createdAt) AS totalRows, count(*) AS rows FROM tr GROUP BY 1")
def trend_delta(spark, d):
    return windows.trend_change(trend_rows(spark, d), ("totalRows",))


@query(f"""WITH {RUNS} SELECT runId, schedulerScope, count(*) OVER (PARTITION BY schedulerScope ORDER BY startedAt RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW) AS inLastMinute, count(*) OVER (PARTITION BY schedulerScope ORDER BY startedAt RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW) > 6 AS limited FROM runs""")
def rate_limit_sliding_60s(spark, d):
    return windows.rate_limited(T.run_history(spark, d), ["schedulerScope"], "startedAt", 6).select("runId", "schedulerScope", F.col("inLast").alias("inLastMinute"), "limited")


# The bus of five projects: every event is a delta, and who signs up listens until an error.
BUS_SQL = """e AS (SELECT 'p' || user_id % 5 AS projectId, event_id, 'u' || user_id AS client, event_type, epoch_us(ts) // 1000 AS atMs FROM events),
b AS (SELECT *, count(*) OVER (PARTITION BY projectId ORDER BY atMs, CAST(event_id AS VARCHAR)) AS n FROM e), pl AS (SELECT projectId, n - 1 AS place, event_type || ' ' || event_id AS payload, atMs FROM b),
j AS (SELECT projectId, client, atMs, (SELECT count(*) FROM e o WHERE o.projectId = s.projectId AND o.atMs <= s.atMs) AS n FROM (SELECT DISTINCT projectId, client, atMs FROM e WHERE event_type = 'signup') s)"""


@query(f"WITH {BUS_SQL} SELECT client, j.projectId, place, 'replay' AS kind, payload, pl.atMs FROM j JOIN pl ON pl.projectId = j.projectId AND place < n AND place >= n - 50 UNION ALL SELECT client, projectId, -1, 'bootstrap', NULL, atMs FROM j")
def bus_replay(spark, d):
    """What every client gets when it joins: a bootstrap and the last 50 of the 200 deltas that its project holds."""
    e = T.read(spark, d, "events").select(F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("projectId"), "event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("client"), "event_type", F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("atMs"))
    deltas = e.select("projectId", F.col("event_id").alias("id"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("payload"), "atMs")
    clients = e.where("event_type = 'signup'").select("projectId", "client", F.lit("join").alias("kind"), "atMs").distinct()
    return live.bus_batch(deltas, clients, live=False)


@query(f"""WITH {RUNS}, o AS (SELECT *, row_number() OVER (ORDER BY startedAt DESC, runId DESC) AS rn FROM runs WHERE schedulerScope = 'scope3') SELECT rn AS place, runId, outcome, (SELECT count(*) FROM o) AS total FROM o WHERE rn <= 25""")
def load_run_history(spark, d):
    return scheduler.newest_runs(T.run_history(spark, d), "scope3", 25)
