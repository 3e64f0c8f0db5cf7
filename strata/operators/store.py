"""Writes and reads of the whole memory store: rows of main, overlays of branches, tombstones, history and vectors.

Nothing is updated in place: each write gives the tables as they are afterwards, for the caller to store. The
history is a log; a version ends with the next write to its key.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec, hashing, text
from ..schema import MAIN
from . import records, retrieval, temporal

ROW = ("id", "logicalId", "projectId", "branch", "kind", "sourceType", "title", "summary", "content", "tags", "importance", "confidence", "createdAt", "lastAccessedAt", "sourceRef")
LOG = (*ROW, "storageId", "operation", "validFrom", "event_id")


@dataclass(frozen=True)
class Tables:
    """``memories`` (ROW, of main), ``overlays`` (ROW, of branches), ``tombstones`` (projectId, branch, logicalId,
    createdAt), ``log`` (LOG), ``branches`` and, if vectors are kept, ``vectors`` (id, embedding)."""

    memories: DataFrame
    overlays: DataFrame
    tombstones: DataFrame
    log: DataFrame
    branches: DataFrame
    vectors: DataFrame | None = None


def storage_id(project: Column, branch: Column, logical: Column) -> Column:
    """The id of a row: on main its logical id, on a branch one of its own."""
    return F.when(branch == MAIN, logical).otherwise(hashing.stable_id("mem_branch_row", project, branch, logical))


def upsert(t: Tables, inputs: DataFrame, now: int) -> Tables:
    """The tables after ``inputs`` (see ``records.create``, and ``embedding``) are written: branches exist, contents are
    compacted, rows of one key replaced, their tombstones gone, and versions from their last access on in the log.

    Of several inputs of one key the last by id and content counts.
    """
    made = records.create(inputs, now)
    logical = text.trim(F.coalesce("logicalId", "id"))
    rows = made.withColumn("logicalId", logical).withColumn("id", storage_id(F.col("projectId"), F.col("branch"), F.col("logicalId")))
    rows = rows.groupBy("projectId", "branch", "logicalId").agg(F.max_by(F.struct(*(c for c in ROW if c not in ("projectId", "branch", "logicalId"))), F.struct("title", "content")).alias("r")).select("projectId", "branch", "logicalId", "r.*").select(*ROW)
    plain = rows
    rows = rows.withColumn("content", codec.compacted(F.col("content")))
    key = ["projectId", "branch", "logicalId"]
    on_main = F.col("branch") == MAIN
    versions = plain.withColumns({"storageId": F.col("id"), "operation": F.lit("upsert"), "validFrom": F.greatest(F.lit(0), F.coalesce("lastAccessedAt", "createdAt")), "event_id": F.lit(now)})
    wanted = rows.select("projectId", "branch").distinct().withColumns({"parentBranch": F.lit(None).cast("string"), "forkedFromCommit": F.lit(None).cast("string")})
    vectors = t.vectors
    if vectors is not None and "embedding" in inputs.columns:
        given = inputs.select(storage_id(F.coalesce(F.col("projectId"), F.lit("default")), F.coalesce(F.nullif(text.trim(F.col("branch")), F.lit("")), F.lit(MAIN)) if "branch" in inputs.columns else F.lit(MAIN), text.trim(F.coalesce(*[F.col(c) for c in ("logicalId", "id") if c in inputs.columns]))).alias("id"), "embedding")
        vectors = upsert_vectors(vectors, given)
    return replace(
        t, memories=temporal.merge_rows(t.memories, rows.where(on_main), ["id"]), overlays=temporal.merge_rows(t.overlays, rows.where(~on_main), ["id"]),
        tombstones=t.tombstones.join(rows.select(*key), key, "left_anti").select(t.tombstones.columns), log=t.log.unionByName(versions.select(*LOG)), branches=records.ensure_branches(t.branches, wanted, now), vectors=vectors,
    )


def delete(t: Tables, ids: DataFrame, project: str, branch: str, now: int) -> Tables:
    """The tables after the memories ``ids`` (id: logical or stored) are gone from a branch of a project.

    On main rows go; on a branch its own rows go and a tombstone hides what its parents have. Either way the log gets a
    delete with the last known texts, also for ids that weren't there.
    """
    seen = view(t, project, branch)
    asked = ids.select(text.trim(F.col("id")).alias("asked")).where("asked <> ''").distinct()
    found = seen.select(F.struct(*ROW).alias("r"), F.explode(F.array_distinct(F.array("id", "logicalId"))).alias("asked"))
    prior = asked.join(found, "asked", "left").select(F.coalesce("r.logicalId", "asked").alias("logicalId"), "r").dropDuplicates(["logicalId"])
    gone = prior.select("logicalId")
    memories, overlays, tombstones = t.memories, t.overlays, t.tombstones
    if branch == MAIN:
        memories = memories.join(gone.withColumn("projectId", F.lit(project)), ["projectId", "logicalId"], "left_anti").select(t.memories.columns)
    else:
        mine = gone.withColumns({"projectId": F.lit(project), "branch": F.lit(branch)})
        overlays = overlays.join(mine, ["projectId", "branch", "logicalId"], "left_anti").select(t.overlays.columns)
        tombstones = upsert_tombstones(tombstones, mine, now)
    was = lambda c, otherwise: F.coalesce(F.col(f"r.{c}"), otherwise)
    logical = F.col("logicalId")
    versions = prior.select(
        was("id", F.lit(None).cast("string")).alias("id"), "logicalId", F.lit(project).alias("projectId"), F.lit(branch).alias("branch"), was("kind", F.lit("semantic")).alias("kind"), was("sourceType", F.lit("manual")).alias("sourceType"),
        was("title", F.concat(F.lit("Deleted memory "), logical)).alias("title"), was("summary", F.lit("Deleted in branch scope")).alias("summary"), was("content", F.lit("")).alias("content"), was("tags", F.array().cast("array<string>")).alias("tags"),
        was("importance", F.lit(0.5)).alias("importance"), was("confidence", F.lit(0.5)).alias("confidence"), F.lit(now).alias("createdAt"), was("lastAccessedAt", F.lit(now)).alias("lastAccessedAt"), F.col("r.sourceRef").alias("sourceRef"),
        F.col("r.id").alias("storageId"), F.lit("delete").alias("operation"), F.lit(now).alias("validFrom"), F.lit(now).alias("event_id"),
    )
    vectors = t.vectors
    if vectors is not None:
        stored = gone.select(storage_id(F.lit(project), F.lit(branch), logical).alias("id"))
        vectors = vectors.join(stored, "id", "left_anti")
    return replace(t, memories=memories, overlays=overlays, tombstones=tombstones, log=t.log.unionByName(versions.select(*LOG)), vectors=vectors)


def delete_everywhere(t: Tables, ids: DataFrame, now: int) -> tuple[Tables, DataFrame]:
    """The tables without the rows of these ids, of main and of branches, and how many distinct ids were there; each
    leaves a delete in the log."""
    wanted = ids.select("id").distinct()
    every = t.memories.select(*ROW).unionByName(t.overlays.select(*ROW))
    lost = every.join(wanted, "id", "left_semi")
    versions = lost.withColumns({"storageId": F.col("id"), "operation": F.lit("delete"), "validFrom": F.lit(now), "event_id": F.lit(now)}).select(*LOG)
    kept = lambda rows: rows.join(wanted, "id", "left_anti").select(rows.columns)
    vectors = kept(t.vectors) if t.vectors is not None else None
    return replace(t, memories=kept(t.memories), overlays=kept(t.overlays), log=t.log.unionByName(versions), vectors=vectors), lost.agg(F.count_distinct("id").alias("deleted"))


def upsert_tombstones(tombstones: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    """One tombstone for each of ``keys`` (projectId, branch, logicalId), with its latest time."""
    key = ["projectId", "branch", "logicalId"]
    return tombstones.join(keys.select(*key), key, "left_anti").select(*key, "createdAt").unionByName(keys.select(*key).distinct().withColumn("createdAt", F.lit(now)))


def upsert_vectors(vectors: DataFrame, fresh: DataFrame) -> DataFrame:
    """Vectors after a write, by id; empty ones aren't written."""
    some = fresh.where(F.size("embedding") > 0)
    return vectors.join(some.select("id"), "id", "left_anti").unionByName(some.select("id", "embedding"))


def snapshots(t: Tables) -> DataFrame:
    """The history with the end of each version."""
    return temporal.close_intervals(t.log)


def line(t: Tables, project: str, branch: str) -> DataFrame:
    return temporal.lineage(t.log.sparkSession, t.branches, project, branch)


def restored(rows: DataFrame) -> DataFrame:
    """Rows with their contents restored."""
    return codec.analysed(rows).withColumn("content", F.col("restored")).select(rows.columns)


def view(t: Tables, project: str, branch: str, like: str | None = None) -> DataFrame:
    """The rows seen from a branch, with restored contents; ``like`` filters what is stored first, so packed contents of
    a branch aren't searched."""
    mine = F.col("projectId") == project
    rows = t.memories.select(*ROW).unionByName(t.overlays.select(*ROW)).where(mine)
    if like is not None:
        rows = retrieval.like_any(rows, like)
    gone = t.tombstones.where(mine).select("branch", "logicalId")
    return restored(temporal.branch_view(rows, gone, line(t, project, branch), True, F.desc("lastAccessedAt"), F.asc("id")).select(*ROW))


def state(t: Tables, project: str, branch: str, at: int) -> DataFrame:
    """The rows that held at a time, deletes left out."""
    held = temporal.state_as_of(snapshots(t).where(F.col("projectId") == project), line(t, project, branch), at)
    return held.where("operation = 'upsert'").select(*ROW)


def read(t: Tables, project: str | None = None, branch: str | None = None, at: int | None = None) -> DataFrame:
    """The rows of all projects on main; of a project's branch; or as they were at a time."""
    if project is None:
        return restored(t.memories.select(*ROW))
    return view(t, project, branch or MAIN) if at is None else state(t, project, branch or MAIN, at)


def listed(t: Tables, project: str | None = None, limit: int = 100, branch: str | None = None, at: int | None = None) -> DataFrame:
    """The newest rows, at most 5,000."""
    return read(t, project, branch, at).orderBy(F.desc("lastAccessedAt"), "id").limit(max(1, min(5000, limit)))


def by_id(t: Tables, key: str, project: str | None = None, branch: str | None = None, at: int | None = None) -> DataFrame:
    """At most one row by its logical or stored id; without a project of main, else of any branch."""
    wanted = key.strip()
    if project is not None:
        return read(t, project, branch, at).where((F.col("logicalId") == wanted) | (F.col("id") == wanted)).orderBy("id").limit(1)
    rows = t.memories.select(*ROW, F.lit(0).alias("order")).unionByName(t.overlays.select(*ROW, F.lit(1).alias("order"))).where(F.col("id") == wanted)
    return restored(rows.orderBy("order").limit(1).drop("order"))


def search(t: Tables, query: str, now: int, project: str | None = None, branch: str | None = None, at: int | None = None, k: int = 10, min_score: float = 0.0, vector: list[float] | None = None) -> DataFrame:
    """The best ``k`` (at most 200) rows with similarity, recency and score; none for a blank query.

    On a branch rows that match ``%query%`` as they are stored, the newest 8 ``k`` of them; at a time those that
    contain the query. On main the newest 3 ``k`` matches, filled up from the newest rows whose restored contents
    contain the query, and the nearest vectors.
    """
    q, k = query.strip(), max(1, min(200, k))
    if not q:
        return retrieval.lexical_scores(t.memories.select(*ROW).limit(0), "x", now).limit(0)
    if project is not None and (at is not None or (branch or MAIN) != MAIN):
        rows = retrieval.contains_ci(state(t, project, branch or MAIN, at), q) if at is not None else view(t, project, branch or MAIN, q).orderBy(F.desc("lastAccessedAt"), "id").limit(8 * k)
        return retrieval.best(retrieval.scored(rows, q, now), k, min_score)
    rows = t.memories.select(*ROW) if project is None else t.memories.select(*ROW).where(F.col("projectId") == project)
    return retrieval.search_main(rows, t.vectors, q, now, k, min_score, vector)
