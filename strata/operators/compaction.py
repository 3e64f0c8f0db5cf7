"""Compaction statistics, audits and candidates over analysed memories (functions.codec.analysed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec, scoring


def sums() -> list[Column]:
    c = F.col
    return [
        F.count("*").alias("totalRows"), F.count_if(c("compacted")).alias("compactedRows"), F.count_if(~c("compacted")).alias("plainRows"),
        F.coalesce(F.sum("storedChars"), F.lit(0)).alias("storedChars"), F.coalesce(F.sum("originalChars"), F.lit(0)).alias("originalChars"),
        F.coalesce(F.sum(c("originalChars") - c("storedChars")), F.lit(0)).alias("savedChars"), F.count_if(c("invalidChecksum")).alias("invalidChecksum"), F.count_if(c("decodeError")).alias("decodeError"),
    ]


def finalised(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns({
        "savedPercent": F.when(c("originalChars") > 0, c("savedChars") * 100.0 / c("originalChars")).otherwise(0.0),
        "compactionRate": F.when(c("totalRows") > 0, c("compactedRows") / c("totalRows")).otherwise(0.0),
        "averageCompressionRatio": F.when(c("originalChars") > 0, c("storedChars") / c("originalChars")).otherwise(1.0),
        "anomalies": c("invalidChecksum") + c("decodeError"),
    })


def stats(memories: DataFrame, project: str | None = None) -> DataFrame:
    """One row over all memories, or one project's."""
    rows = memories.where(F.col("projectId") == project) if project else memories
    return finalised(codec.analysed(rows.select("projectId", "content", "lastAccessedAt"), texts=False).agg(*sums()))


def breakdown(memories: DataFrame) -> DataFrame:
    """A row per project and one for all (projectId null), in one pass, with the newest access and the risk."""
    a = codec.analysed(memories.select("projectId", "content", "lastAccessedAt"), texts=False).withColumn("projectId", F.coalesce("projectId", F.lit("")))
    rolled = a.rollup("projectId").agg(*sums(), F.max("lastAccessedAt").alias("lastAccessedAt"))
    return finalised(rolled).withColumn("risk", scoring.project_risk(F.col("anomalies"), F.col("totalRows"), F.col("compactionRate"), F.col("savedPercent")))


def estimated(memories: DataFrame) -> DataFrame:
    """Plain rows and the length that compaction would store (not shorter: the same)."""
    plain = memories.where(~F.startswith(F.coalesce("content", F.lit("")), F.lit(codec.PREFIX)))
    return plain.withColumn("estimatedStored", F.length(codec.compacted(F.coalesce("content", F.lit("")))).cast("long")).withColumn("chars", F.length(F.coalesce("content", F.lit(""))).cast("long"))


def opportunities(memories: DataFrame, least: int = 240, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """(totals over all candidates, the ``limit`` that would save most)."""
    found = estimated(memories.where(F.length("content") >= least)).where("estimatedStored < chars").withColumn("saved", F.col("chars") - F.col("estimatedStored"))
    totals = found.agg(F.count("*").alias("candidates"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"))
    return totals, found.select("id", "projectId", "chars", "estimatedStored", "saved").orderBy(F.desc("saved"), F.desc("lastAccessedAt"), "id").limit(limit)


def audit(memories: DataFrame, limit: int = 5000, most_issues: int = 10) -> tuple[DataFrame, DataFrame]:
    """(counts and rates over the newest ``limit`` rows, the first broken rows among them)."""
    newest = memories.orderBy(F.desc("lastAccessedAt"), "id").limit(limit)
    a = codec.analysed(newest.select("id", "projectId", "content", "lastAccessedAt"), texts=False)
    rows = a.agg(*sums())
    c = F.col
    summary = finalised(rows).withColumns({"anomalyRate": F.when(c("compactedRows") > 0, c("anomalies") / c("compactedRows")).otherwise(0.0), "opportunityRate": F.when(c("totalRows") > 0, c("plainRows") / c("totalRows")).otherwise(0.0)})
    summary = summary.withColumn("recommendations", recommendations(c("totalRows"), c("anomalies"), c("opportunityRate")))
    issue = F.when(c("decodeError"), "decode_error").otherwise("invalid_checksum")
    issues = a.where("decodeError OR invalidChecksum").select("id", "projectId", issue.alias("issue"), "lastAccessedAt").orderBy(F.desc("lastAccessedAt"), "id").limit(most_issues)
    return summary, issues


def backfill(memories: DataFrame, limit: int = 1000, least: int = 240) -> tuple[DataFrame, DataFrame]:
    """(scanned, eligible, compacted, skipped, savedChars; the rows with their new contents) for the newest rows.

    Rows that compaction wouldn't shorten are both eligible and skipped.
    """
    newest = memories.orderBy(F.desc("lastAccessedAt"), "id").limit(limit)
    plain = ~F.startswith(F.coalesce("content", F.lit("")), F.lit(codec.PREFIX))
    done = newest.withColumn("plain", plain).withColumn("new", F.when(F.col("plain"), codec.compacted(F.coalesce("content", F.lit("")))).otherwise(F.col("content")))
    shorter = F.col("plain") & (F.length("new") < F.length("content"))
    eligible = F.col("plain") & (F.length("content") >= least)
    summary = done.agg(F.count("*").alias("scanned"), F.count_if(eligible).alias("eligible"), F.count_if(shorter).alias("compacted"), F.count_if(~shorter).alias("skipped"), F.coalesce(F.sum(F.when(shorter, F.length("content") - F.length("new"))), F.lit(0)).cast("long").alias("savedChars"))
    return summary, done.where(shorter).withColumn("content", F.col("new")).drop("new", "plain")


# What an audit recommends.
NO_ROWS = "No memory rows were scanned. Ingest data first, then re-run memory audit."
DAMAGED = "Integrity anomalies detected. Inspect issue samples and re-ingest affected sources to restore full resurrection fidelity."
MANY_PLAIN = "A notable share of rows are still plain. Consider `memory backfill --apply` during a maintenance window."
SOUND = "Resurrection integrity checks look healthy. Keep periodic audits enabled."


def recommendations(rows: Column, anomalies: Column, opportunity: Column) -> Column:
    """What to do after an audit, at least one thing."""
    some = F.array_compact(F.array(F.when(anomalies > 0, DAMAGED), F.when(opportunity >= 0.2, MANY_PLAIN)))
    return F.when(rows == 0, F.array(F.lit(NO_ROWS))).when(F.size(some) > 0, some).otherwise(F.array(F.lit(SOUND)))


# Health of memory, and what it calls for.
HEALTH = {
    "critical": "Integrity anomalies detected. Run memory audit and re-ingest affected sources before critical agent tasks.", "coverage": "Compaction coverage is low for this memory volume. Consider running memory backfill --apply in maintenance.",
    "savings": "Compression savings are low at current scale. Review compaction thresholds and run dashboard trend analysis.", "healthy": "Memory quality is healthy. Keep regular ingestion and dashboard snapshots running.",
}


def health(stats: DataFrame) -> DataFrame:
    """Rows of ``stats`` or ``breakdown`` with status and recommendation, from 50 and from 120 rows on."""
    c = F.col
    why = F.when(c("anomalies") > 0, "critical").when((c("totalRows") >= 50) & (c("compactionRate") < 0.5), "coverage").when((c("totalRows") >= 120) & (c("savedPercent") < 5), "savings").otherwise("healthy")
    said = F.when(why == "critical", HEALTH["critical"]).when(why == "coverage", HEALTH["coverage"]).when(why == "savings", HEALTH["savings"]).otherwise(HEALTH["healthy"])
    return stats.withColumns({"status": F.when(why.isin("coverage", "savings"), "warning").otherwise(why), "recommendation": said})
