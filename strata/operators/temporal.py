"""History, branches and merges over immutable tables.

A log of writes (projectId, branch, logicalId, operation, validFrom, and a payload) is the source of truth;
the end of each version follows from the next write, so nothing is updated in place. Rows of a child branch
shadow those of its ancestors; the lineage (at most 32 branches) is resolved once and broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import LINEAGE_DEPTH, MAIN

KEY = ["projectId", "branch", "logicalId"]


def close_intervals(writes: DataFrame, tie: str = "event_id") -> DataFrame:
    """validUntil = the next write's validFrom for the same key; null for the open version."""
    return writes.withColumn("validUntil", F.lead("validFrom").over(Window.partitionBy(*KEY).orderBy("validFrom", tie)))


def lineage(spark: SparkSession, branches: DataFrame, project: str, branch: str) -> DataFrame:
    """(branch, depth) from the branch to main; a missing parent means main, cycles end, main is always last."""
    parents = {r["branch"]: r["parentBranch"] for r in branches.where(F.col("projectId") == project).select("branch", "parentBranch").toLocalIterator()} if branch != MAIN else {}
    out, at = [], branch
    while at and at not in out and len(out) < LINEAGE_DEPTH:
        out.append(at)
        at = None if at == MAIN else parents.get(at) or MAIN
    if MAIN not in out:
        out.append(MAIN)
    return spark.createDataFrame([(b, i) for i, b in enumerate(out)], "branch string, depth int")


def lineages(branches: DataFrame) -> DataFrame:
    """(projectId, start, branch, depth): the lineage of every branch, by the rules of ``lineage``: a missing parent is
    main, cycles end, at most 32 branches, main last.

    Each round joins all lines to the next branch; a round's table is written, so plans stay small.
    """
    from .lineage import kept

    edges = branches.where(F.col("branch") != MAIN).select("projectId", "branch", F.coalesce("parentBranch", F.lit(MAIN)).alias("up"))
    known = kept(edges.groupBy("projectId", "branch").agg(F.min("up").alias("up")), "branches")
    at = known.select("projectId", F.col("branch").alias("start"), F.array("branch").alias("line"), "up")
    done: list[DataFrame] = []
    step = known.select("projectId", F.col("branch").alias("up"), F.col("up").alias("next"))
    for depth in range(LINEAGE_DEPTH):
        goes_on = (F.col("up") != MAIN) & ~F.array_contains("line", F.col("up")) & F.lit(depth + 1 < LINEAGE_DEPTH)
        done.append(at.where(~goes_on).select("projectId", "start", "line"))
        longer = at.where(goes_on).join(step, ["projectId", "up"], "left")
        at = kept(longer.select("projectId", "start", F.concat("line", F.array("up")).alias("line"), F.coalesce("next", F.lit(MAIN)).alias("up")), "lines")
        if at.isEmpty():
            break
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every.select("projectId", "start", F.posexplode(F.concat("line", F.array(F.lit(MAIN)))).alias("depth", "branch"))


def nearest(rows: DataFrame, line: DataFrame, *order: Column) -> DataFrame:
    """For each logicalId the row of the nearest branch of the lineage, by ``order`` within it."""
    w = Window.partitionBy("logicalId").orderBy("depth", *order)
    return rows.join(F.broadcast(line), "branch").withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def state_as_of(snapshots: DataFrame, line: DataFrame, at: int, tie: str = "event_id") -> DataFrame:
    """The version of each logicalId that holds at ``at``; versions that are deletes stay and shadow parents."""
    held = snapshots.where((F.col("validFrom") <= at) & (F.col("validUntil").isNull() | (F.col("validUntil") > at)))
    return nearest(held, line, F.desc("validFrom"), F.desc(tie))


def branch_view(rows: DataFrame, tombstones: DataFrame, line: DataFrame, depth_aware: bool = True, *order: Column) -> DataFrame:
    """Current rows seen from a branch. Tombstones hide rows of their branch and its ancestors; with
    ``depth_aware`` off also rows that a nearer branch has made again."""
    hidden = tombstones.join(F.broadcast(line), "branch").groupBy("logicalId").agg(F.min("depth").alias("hiddenAt"))
    if depth_aware:
        seen = nearest(rows, line, *order).join(hidden, "logicalId", "left")
        return seen.where(F.col("hiddenAt").isNull() | (F.col("depth") < F.col("hiddenAt"))).drop("hiddenAt")
    return nearest(rows, line, *order).join(hidden, "logicalId", "left_anti")


COMPARED = ("title", "summary", "content", "sourceRef")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """logicalId, change, and both titles; deletes count as absent. Modified: texts differ, or scores by over 1e-6."""
    cols = [*COMPARED, "importance", "confidence"]
    a = before.where("operation <> 'delete'").select("logicalId", F.struct(*cols).alias("b"))
    b = after.where("operation <> 'delete'").select("logicalId", F.struct(*cols).alias("a"))
    texts = [~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in COMPARED]
    moved = [F.abs(F.coalesce(F.col(f"a.{c}"), F.lit(0.0)) - F.coalesce(F.col(f"b.{c}"), F.lit(0.0))) > 1e-6 for c in ("importance", "confidence")]
    changed = texts[0]
    for x in (*texts[1:], *moved):
        changed = changed | x
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(changed, "modified")
    return a.join(b, "logicalId", "full_outer").select("logicalId", kind.alias("change"), F.col("b.title").alias("beforeTitle"), F.col("a.title").alias("afterTitle")).where("change IS NOT NULL")


#: The order of changes in a listing.
CHANGES = ("modified", "added", "removed")


def diff_items(before: DataFrame, after: DataFrame, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """(totals, items) of a diff: a row with how many were added, removed and modified; the first ``limit`` changes,
    modified ones first, then by logical id, with kind, source and title from after (before, where removed), and
    what they were and are."""
    told = lambda side: F.struct(*(F.col(f"{side}.{c}").alias(c) for c in ("summary", "content", "sourceRef", "confidence", "importance")))
    cols = [c for c in before.columns if c != "logicalId"]
    changes = diff(before, after).select("logicalId", "change")
    b, a = (df.where("operation <> 'delete'").select("logicalId", F.struct(*cols).alias(n)) for df, n in ((before, "b"), (after, "a")))
    both = changes.join(b, "logicalId", "left").join(a, "logicalId", "left")
    totals = changes.agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "modified")))
    shown = [F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("kind", "sourceType", "title", "branch") if c in cols]
    place = F.array_position(F.array(*map(F.lit, CHANGES)), F.col("change"))
    items = both.select("logicalId", F.col("change").alias("changeType"), *shown, F.when(F.col("b").isNotNull(), told("b")).alias("before"), F.when(F.col("a").isNotNull(), told("a")).alias("after"), place.alias("__place"))
    return totals, items.orderBy("__place", "logicalId").limit(limit).drop("__place")


def merge_rows(target: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-replace: ``delta`` wins over ``target`` by ``keys``; columns that one lacks are null."""
    return target.join(delta.select(*keys), keys, "left_anti").unionByName(delta, allowMissingColumns=True)


def delete_rows(target: DataFrame, ids: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and how many distinct keys were there."""
    wanted = ids.select(*keys).distinct()
    return target.join(wanted, keys, "left_anti"), target.join(wanted, keys, "left_semi").select(*keys).distinct().agg(F.count("*").alias("deleted"))


def merge_branch(current: DataFrame, tombstones: DataFrame, source: str, target: str, strategy: str = "source-wins") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(upserts, deletes, counters) that a merge of ``source`` into ``target`` makes; only the source's own rows."""
    rows, gone = current.where(F.col("branch") == source), tombstones.where(F.col("branch") == source)
    if strategy == "target-wins":
        held = current.where(F.col("branch") == target).select("logicalId").unionByName(tombstones.where(F.col("branch") == target).select("logicalId")).distinct()
        kept_rows, kept_gone = rows.join(held, "logicalId", "left_anti"), gone.join(held, "logicalId", "left_anti")
    else:
        kept_rows, kept_gone = rows, gone
    def one(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias(name))

    counters = one(rows.select("logicalId").unionByName(gone.select("logicalId")), "mergedRows").crossJoin(one(kept_rows, "appliedUpserts")).crossJoin(one(kept_gone, "appliedDeletes"))  # one row each
    counters = counters.withColumn("skipped", F.col("mergedRows") - F.col("appliedUpserts") - F.col("appliedDeletes"))
    return kept_rows.withColumn("branch", F.lit(target)), kept_gone.withColumn("branch", F.lit(target)), counters


def baseline(current: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Current rows that have no open upsert in the history, as versions from their creation on; nothing is written."""
    held = snapshots.where("operation = 'upsert' AND validUntil IS NULL").select("projectId", "branch", "logicalId")
    return current.join(held, KEY, "left_anti").withColumn("operation", F.lit("upsert"))


def keep_newest(df: DataFrame, scope: str, by: str, tie: str, n: int) -> DataFrame:
    """The newest ``n`` rows of each scope."""
    w = Window.partitionBy(scope).orderBy(F.desc(by), F.desc(tie))
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
