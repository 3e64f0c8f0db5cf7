"""One object with the tables and the clock, and a method per operator."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compaction, context, graph, store, temporal
from ..schema import MAIN


@dataclass
class MemoryEngine:
    """``now`` in epoch milliseconds; nothing reads a clock. Tables that a method doesn't need may be None: without
    history, branches and overlays all there is is main. Writes give a new engine, whose tables the caller stores."""

    spark: SparkSession
    memories: DataFrame
    now: int
    vectors: DataFrame | None = None
    log: DataFrame | None = None
    branches: DataFrame | None = None
    overlays: DataFrame | None = None
    tombstones: DataFrame | None = None

    def tables(self) -> store.Tables:
        """All tables, empty ones for those that are None."""
        rows = self.memories
        for name, value in (("logicalId", F.col("id")), ("branch", F.lit(MAIN)), ("sourceRef", F.lit(None).cast("string")), ("sourceType", F.lit("manual"))):
            rows = rows if name in rows.columns else rows.withColumn(name, value)
        rows = rows.select(*store.ROW)
        none = rows.limit(0)
        log = none.withColumns({"storageId": F.col("id"), "operation": F.lit(""), "validFrom": F.lit(0).cast("long"), "event_id": F.lit(0).cast("long")}).select(*store.LOG)
        tombstones = none.select("projectId", "branch", "logicalId", "createdAt")
        branches = none.select("projectId", "branch", F.lit("").alias("parentBranch"), F.lit("").alias("forkedFromCommit"), "createdAt", F.col("createdAt").alias("updatedAt"))
        given = lambda df, otherwise: otherwise if df is None else df
        return store.Tables(rows, given(self.overlays, none), given(self.tombstones, tombstones), given(self.log, log), given(self.branches, branches), self.vectors)

    def having(self, t: store.Tables) -> MemoryEngine:
        return replace(self, memories=t.memories, overlays=t.overlays, tombstones=t.tombstones, log=t.log, branches=t.branches, vectors=t.vectors)

    def upsert(self, inputs: DataFrame) -> MemoryEngine:
        return self.having(store.upsert(self.tables(), inputs, self.now))

    def delete(self, ids: DataFrame, project: str, branch: str = MAIN) -> MemoryEngine:
        return self.having(store.delete(self.tables(), ids, project, branch, self.now))

    def delete_everywhere(self, ids: DataFrame) -> tuple[MemoryEngine, DataFrame]:
        t, count = store.delete_everywhere(self.tables(), ids, self.now)
        return self.having(t), count

    def get(self, key: str, project: str | None = None, branch: str | None = None, at: int | None = None) -> DataFrame:
        return store.by_id(self.tables(), key, project, branch, at)

    def list(self, project: str | None = None, limit: int = 100, branch: str | None = None, at: int | None = None) -> DataFrame:
        return store.listed(self.tables(), project, limit, branch, at)

    def search(self, query: str, vector: list[float] | None = None, k: int = 10, min_score: float = 0.0, project: str | None = None, branch: str | None = None, at: int | None = None) -> DataFrame:
        return store.search(self.tables(), query, self.now, project, branch, at, k, min_score, vector)

    def as_of(self, project: str, branch: str, at: int) -> DataFrame:
        return store.state(self.tables(), project, branch, at)

    def view(self, project: str, branch: str) -> DataFrame:
        return store.view(self.tables(), project, branch)

    def diff(self, project: str, branch: str, a: int, b: int, limit: int = 200) -> tuple[DataFrame, DataFrame]:
        t = self.tables()
        rows, line = store.snapshots(t).where(F.col("projectId") == project), store.line(t, project, branch)
        return temporal.diff_items(temporal.state_as_of(rows, line, min(a, b)), temporal.state_as_of(rows, line, max(a, b)), limit)

    def compile_context(self, query: str, max_tokens: int = 4000, k: int = 12) -> DataFrame:
        return context.compile_context(self.search(query, k=k).select("id", "score", "title", "content"), max_tokens)

    def stats(self, project: str | None = None) -> DataFrame:
        return compaction.stats(self.memories, project)

    def health(self, project: str | None = None) -> DataFrame:
        return compaction.health(self.stats(project))

    def audit(self, limit: int = 5000) -> tuple[DataFrame, DataFrame]:
        return compaction.audit(self.memories, limit)

    def graph(self, branch: str = MAIN, since: int | None = None) -> tuple[DataFrame, DataFrame]:
        t = self.tables()
        return graph.index_memories(t.memories.where(F.col("branch") == branch) if branch == MAIN else t.overlays.where(F.col("branch") == branch), store.snapshots(t), branch, since)
