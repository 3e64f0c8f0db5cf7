"""Schemas of the engine's tables. Times are epoch milliseconds unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, I, B = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


MEMORY = struct(id=S, projectId=S, kind=S, sourceType=S, title=S, summary=S, content=S, tags=T.ArrayType(S), importance=D, confidence=D, createdAt=L, lastAccessedAt=L, embeddingRef=S, sourceRef=S)
OVERLAY = T.StructType([*MEMORY.fields, T.StructField("logicalId", S), T.StructField("branch", S)])
SNAPSHOT = T.StructType([*OVERLAY.fields, *struct(storageId=S, parentBranch=S, forkedFromCommit=S, operation=S, validFrom=L, validUntil=L).fields])
BRANCH = struct(projectId=S, branch=S, parentBranch=S, forkedFromCommit=S, createdAt=L, updatedAt=L)
TOMBSTONE = struct(projectId=S, branch=S, logicalId=S, createdAt=L)
NODE = struct(id=S, type=S, label=S, projectId=S, metadata=T.MapType(S, S), createdAt=L)
EDGE = struct(id=S, fromNode=S, toNode=S, type=S, weight=D, projectId=S, metadata=T.MapType(S, S), createdAt=L)
FINGERPRINT = struct(projectId=S, sourceType=S, sourceRef=S, contentHash=S, contentBytes=L, ingestVersion=S, firstIngestedAt=L, lastIngestedAt=L)
RUN = struct(runId=L, schedulerScope=S, trigger=S, outcome=S, dryRunOnly=B, reason=S, startedAt=L, completedAt=L, durationMs=L)
DELTA = struct(sessionId=S, projectId=S, step=L, deltaType=S, payload=S, tokenEstimate=L, replaceSpan=struct(start=L, end=L), checksum=S, timestamp=L)
COMPACTION_TREND = struct(projectId=S, totalRows=L, compactedRows=L, savedPercent=D, compactionRate=D, integrityAnomalyTotal=L, createdAt=L)

KINDS = ("episodic", "semantic", "procedural", "code_entity", "chat_turn", "refactor_plan")
SOURCE_TYPES = ("code", "chat", "manual", "system")
MAIN = "main"
LINEAGE_DEPTH = 32
