"""Windows over time for scopes of any size, and the trends and histories that are read by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def in_last(rows: DataFrame, scope: list[str], at: str, width: int, value: Column | None = None) -> DataFrame:
    """``rows`` with ``inLast``: how many rows of the scope lie in the ``width`` (of ``at``'s unit) up to and with its time,
    or the sum of ``value`` over them.

    Time is cut into buckets of ``width``, and a scope's bucket is a key of its own, so a scope with most of the rows is as
    many tasks as it has buckets. Earlier rows of a window lie in the bucket before at most, whose rows are also
    dealt to this one; those copies count and aren't returned.
    """
    counted = F.lit(1).cast("long") if value is None else value
    bucket = F.floor(F.col(at) / width).cast("long")
    own = F.struct(bucket.alias("b"), F.lit(True).alias("own"))
    halo = F.struct((bucket + 1).alias("b"), F.lit(False).alias("own"))
    dealt = rows.withColumn("__v", counted).withColumn("__t", F.explode(F.array(own, halo)))
    w = Window.partitionBy(*scope, F.col("__t.b")).orderBy(at).rangeBetween(-width, 0)
    return dealt.withColumn("inLast", F.sum("__v").over(w)).where("__t.own").drop("__t", "__v")


def rate_limited(events: DataFrame, scope: list[str], at: str, most: int, width: int = 60_000) -> DataFrame:
    """``events`` with ``inLast`` and ``limited``, whether that is more than ``most``."""
    return in_last(events, scope, at, width).withColumn("limited", F.col("inLast") > most)


def history_since(writes: DataFrame, branch: str, since: int, limit: int = 200, project: str | None = None) -> DataFrame:
    """The newest writes on a branch from a time on, at most ``limit``; those without a title are told by their id."""
    own = writes.where((F.col("branch") == branch) & (F.col("validFrom") >= since))
    own = own.where(F.col("projectId") == project) if project is not None else own
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.lit("Memory "), "logicalId"))
    return own.withColumn("title", title).orderBy(F.desc("validFrom"), F.desc("event_id")).limit(limit)


def trend(snapshots: DataFrame, project: str | None, cutoff: int = 0, most: int = 90) -> DataFrame:
    """The newest ``most`` trend rows (projectId, createdAt, ...) of a project, or of all projects together, from a time on, oldest first."""
    own = F.col("projectId").isNull() if project is None else F.col("projectId") == project
    return snapshots.where(own & (F.col("createdAt") >= cutoff)).orderBy(F.desc("createdAt")).limit(most).orderBy("createdAt")


def trend_change(snapshots: DataFrame, columns: tuple[str, ...] = ("savedPercent", "compactionRate", "integrityAnomalyTotal")) -> DataFrame:
    """How much each project's last trend row differs from its first; two partial aggregates, no window."""
    each = [(F.max_by(c, "createdAt") - F.min_by(c, "createdAt")).alias(c) for c in columns]
    return snapshots.groupBy("projectId").agg(*each, F.count("*").alias("rows"))


def outcomes_since(runs: DataFrame, scope: str | None, since: int) -> DataFrame:
    """(outcome, n) of the runs of a scope, or of all, that began at a time or later."""
    own = runs.where(F.col("startedAt") >= since)
    own = own.where(F.col("schedulerScope") == scope) if scope is not None else own
    return own.groupBy("outcome").agg(F.count("*").alias("n"))
