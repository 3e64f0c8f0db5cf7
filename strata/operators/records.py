"""Making and keeping records: defaults, branches, fingerprints, trends, dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hashing, scoring, text
from . import compaction
from .temporal import merge_rows


def create(inputs: DataFrame, now: int) -> DataFrame:
    """Inputs (any of a memory's columns) with trimmed texts, distinct tags, bounded scores and times."""
    have = set(inputs.columns)

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in have else default

    key = given("id", hashing.stable_id("mem", given("projectId", F.lit("default")), F.col("title"), F.col("content")))
    tags = F.array_distinct(F.filter(F.transform(given("tags", F.array().cast("array<string>")), text.trim), lambda t: t != ""))
    branch = text.trim(given("branch", F.lit("main")))
    return inputs.select(
        key.alias("id"), given("logicalId", key).alias("logicalId"), given("projectId", F.lit("default")).alias("projectId"), F.when(branch == "", "main").otherwise(branch).alias("branch"), F.col("kind"), given("sourceType", F.lit("manual")).alias("sourceType"),
        text.trim(F.col("title")).alias("title"), text.trim(F.col("summary")).alias("summary"), F.col("content"), tags.alias("tags"), scoring.clamp01(given("importance", F.lit(0.6))).alias("importance"), scoring.clamp01(given("confidence", F.lit(0.75))).alias("confidence"),
        F.lit(now).alias("createdAt"), F.lit(now).alias("lastAccessedAt"), given("sourceRef", F.lit(None).cast("string")).alias("sourceRef"),
    )


def ensure_branches(branches: DataFrame, wanted: DataFrame, now: int) -> DataFrame:
    """``wanted`` (projectId, branch, parentBranch, forkedFromCommit) exist: known ones keep what they have, else take what is given."""
    keys = ["projectId", "branch"]
    w = wanted.select(*keys, F.col("parentBranch").alias("p"), F.col("forkedFromCommit").alias("c"), F.lit(True).alias("asked"))
    both = branches.join(w, keys, "full_outer")
    return both.select(*keys, F.coalesce("parentBranch", "p").alias("parentBranch"), F.coalesce("forkedFromCommit", "c").alias("forkedFromCommit"), F.coalesce("createdAt", F.lit(now)).alias("createdAt"), F.when(F.col("asked"), F.lit(now)).otherwise(F.col("updatedAt")).alias("updatedAt"))


def list_branches(branches: DataFrame, project: str) -> DataFrame:
    """A project's branches, a few, in order of their making and name, with their place."""
    order = Window.orderBy("createdAt", "branch")
    return branches.where(F.col("projectId") == project).withColumn("place", F.row_number().over(order)).orderBy("place")


def upsert_fingerprints(stored: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Fingerprints of this run replace stored ones; the first time stays."""
    keys = ["projectId", "sourceType", "sourceRef"]
    first = stored.select(*keys, F.col("firstIngestedAt").alias("f"))
    fresh = new.join(first, keys, "left").withColumns({"firstIngestedAt": F.coalesce("f", F.lit(now)), "lastIngestedAt": F.lit(now)}).drop("f")
    return merge_rows(stored, fresh, keys)


def trend_snapshots(memories: DataFrame, now: int, top: int = 20) -> DataFrame:
    """The breakdown to keep: one row for all and one for each of the ``top`` largest projects."""
    b = compaction.breakdown(memories).select("projectId", "totalRows", "compactedRows", "savedPercent", "compactionRate", F.col("anomalies").alias("integrityAnomalyTotal"))
    largest = b.where("projectId IS NOT NULL").orderBy(F.desc("totalRows"), "projectId").limit(top)
    return b.where("projectId IS NULL").unionByName(largest).withColumn("createdAt", F.lit(now))


def retain(trend: DataFrame, cutoff: int) -> DataFrame:
    return trend.where(F.col("createdAt") >= cutoff)


def dashboard(memories: DataFrame, trend: DataFrame, top: int = 10) -> dict[str, DataFrame]:
    """current, perProject (worst first) and totals, and the trend, oldest first."""
    b = compaction.breakdown(memories)
    projects = b.where("projectId IS NOT NULL")
    ranked = projects.orderBy(F.desc("anomalies"), F.desc("savedChars"), F.desc("totalRows"), "projectId").limit(top)
    totals = projects.agg(F.count("*").alias("projectCount"), F.count_if(F.col("anomalies") > 0).alias("projectsWithAnomalies"), F.count_if(F.col("compactionRate") >= 0.8).alias("projectsMostlyCompacted"))
    return {"current": b.where("projectId IS NULL"), "perProject": ranked, "totals": totals, "trend": trend.orderBy("createdAt")}


def mcp_envelope(df: DataFrame, now: int) -> DataFrame:
    """Envelopes (intent, scope, concepts, entities, constraints) trimmed, with lists of distinct entries, as JSON."""

    def clean(c: str) -> Column:
        return F.array_distinct(F.filter(F.transform(c, text.trim), lambda x: x != "")).alias(c)

    return df.withColumn("envelope", F.to_json(F.struct(F.lit("1.0").alias("version"), F.lit(now).alias("createdAt"), text.trim(F.col("intent")).alias("intent"), text.trim(F.col("scope")).alias("scope"), *map(clean, ("concepts", "entities", "constraints")))))


def read_envelope(column: Column) -> Column:
    """The envelope as a struct; null unless intent, scope and all three lists are there."""
    e = F.from_json(column, "version string, createdAt long, intent string, scope string, concepts array<string>, entities array<string>, constraints array<string>")
    whole = e["intent"].isNotNull() & e["scope"].isNotNull() & e["concepts"].isNotNull() & e["entities"].isNotNull() & e["constraints"].isNotNull()
    return F.when(whole, e)
