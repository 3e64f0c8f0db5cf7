"""Run histories, service levels and guardrails of maintenance schedulers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scoring import in_apply_window

# Bucket bounds in seconds, and window lengths in minutes.
HTTP_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
RUN_BUCKETS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0)
SLO_MINUTES = (60, 1440, 10080)
OUTCOMES = {"applied": "applied", "dryRunOnly": "dry-run-only", "indexed": "indexed", "skipped": "skipped", "error": "error"}


def slo_windows(runs: DataFrame, now_ms: int, minutes: tuple[int, ...] = SLO_MINUTES) -> DataFrame:
    """Counts by outcome and rates for each window that ends now; an empty window has a success rate of 1.

    One pass: each run enters the windows it lies in, which are few.
    """
    inside = [F.when(F.col("startedAt") > now_ms - m * 60_000, m) for m in minutes]
    entered = runs.where((F.col("startedAt") <= now_ms) & (F.col("startedAt") > now_ms - max(minutes) * 60_000)).select("outcome", F.explode(F.array_compact(F.array(*inside))).alias("minutes"))
    counted = entered.groupBy("minutes").agg(F.count("*").alias("total"), *(F.count_if(F.col("outcome") == o).alias(n) for n, o in OUTCOMES.items()))
    every = runs.sparkSession.createDataFrame([(m,) for m in minutes], "minutes int")
    out = F.broadcast(every).join(counted, "minutes", "left").fillna(0)

    def rate(x: Column, empty: float) -> Column:
        return F.when(F.col("total") == 0, empty).otherwise(x / F.col("total"))

    c = F.col
    return out.withColumns({"successRate": rate(c("total") - c("error"), 1.0), "errorRate": rate(c("error"), 0.0), "applyRate": rate(c("applied"), 0.0), "indexRate": rate(c("applied") + c("indexed"), 0.0)})


def consecutive_failures(runs: DataFrame) -> DataFrame:
    """Errors since the last run that was neither an error nor skipped, by scope; two partial aggregates, no window."""
    told = runs.where("outcome <> 'skipped'")
    last = told.groupBy("schedulerScope").agg(F.max(F.when(F.col("outcome") != "error", F.struct("startedAt", "runId"))).alias("good"))
    newer = F.col("good").isNull() | (F.struct("startedAt", "runId") > F.col("good"))
    return told.join(last, "schedulerScope").groupBy("schedulerScope").agg(F.count_if(newer & (F.col("outcome") == "error")).alias("consecutiveFailures"))


def histogram(df: DataFrame, labels: list[str], value: str, bounds: tuple[float, ...]) -> DataFrame:
    """Cumulative counts: labels, le, n."""
    counted = df.groupBy(*labels).agg(*(F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)))
    each = F.explode(F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds))))
    return counted.select(*labels, each.alias("x")).select(*labels, "x.le", "x.n")


def held_back(*rules: tuple[Column, Column]) -> Column:
    """The reasons whose conditions hold, in order; empty: a run may apply."""
    return F.array_compact(F.array(*(F.when(when, why) for when, why in rules)))


DRY, OFF, NO_LIMIT = "Manual dry-run only mode requested.", "Apply mode is disabled by configuration.", "Apply limit resolved to 0 rows."


@dataclass
class Guardrails:
    """What a maintenance run must keep to before it changes anything."""

    apply_enabled: bool = True
    max_anomalies: int = 0
    min_opportunity: float = 0.05
    min_compacted: int = 1
    window_start: int = 0
    window_end: int = 0
    backfill_limit: int = 5000
    max_apply_rows: int = 5000

    @property
    def limit(self) -> int:
        return max(0, min(self.backfill_limit, self.max_apply_rows))


def apply_decision(runs: DataFrame, g: Guardrails) -> DataFrame:
    """Runs (dryRunOnly, anomalies, opportunityRate, dryRunCompacted, hour) with reasons, allowApply and applyLimit.

    The guardrails, in order: a dry run was asked for, applying is off, too many anomalies, too little to gain, too
    few rows that a dry run compacted, outside the window of hours, a limit of no rows.
    """
    c = F.col
    said = held_back(
        (c("dryRunOnly"), F.lit(DRY)), (F.lit(not g.apply_enabled), F.lit(OFF)), (c("anomalies") > g.max_anomalies, anomalies_said(g)),
        (c("opportunityRate") < g.min_opportunity, F.concat(F.lit("Compaction opportunity below threshold ("), F.format_string("%.4f", c("opportunityRate")), F.lit(f" < {g.min_opportunity:.4f})."))),
        (c("dryRunCompacted") < g.min_compacted, F.concat(F.lit("Dry-run compacted rows below threshold ("), c("dryRunCompacted").cast("string"), F.lit(f" < {g.min_compacted})."))),
        (~in_apply_window(c("hour"), F.lit(g.window_start), F.lit(g.window_end)), F.lit(f"Current time is outside apply window [{g.window_start}:00-{g.window_end}:00).")), (F.lit(g.limit <= 0), F.lit(NO_LIMIT)),
    )
    return runs.withColumn("reasons", said).withColumns({"allowApply": F.size("reasons") == 0, "applyLimit": F.lit(g.limit)})


def anomalies_said(g: Guardrails) -> Column:
    return F.concat(F.lit("Anomaly guardrail blocked apply ("), F.col("anomalies").cast("string"), F.lit(f" > {g.max_anomalies})."))


def session_decision(runs: DataFrame, g: Guardrails) -> DataFrame:
    """The same for runs that ingest first (dryRunOnly, ingestionErrors, anomalies, dryRunCompacted): any error of the
    ingestion and a dry run that compacted nothing hold them back; hours and rates don't matter."""
    c, limit = F.col, max(0, g.backfill_limit)
    said = held_back(
        (c("dryRunOnly"), F.lit(DRY)), (F.lit(not g.apply_enabled), F.lit(OFF)), (c("ingestionErrors") > 0, F.concat(F.lit("Ingestion produced "), c("ingestionErrors").cast("string"), F.lit(" errors; apply mode blocked."))),
        (c("anomalies") > g.max_anomalies, anomalies_said(g)), (F.lit(limit <= 0), F.lit(NO_LIMIT)), (c("dryRunCompacted") <= 0, F.lit("Dry-run detected no compactable rows.")),
    )
    return runs.withColumn("reasons", said).withColumns({"allowApply": F.size("reasons") == 0, "applyLimit": F.lit(limit)})


def single_flight(runs: DataFrame) -> DataFrame:
    """Runs (schedulerScope, runId, startedAt, durationMs) with ``overlaps``: another run of the scope was still going on,
    so this one is skipped; a skipped run holds nobody up.

    A stream over runs in order of time, with one number per scope.
    """
    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, busy = None, -1
        for p in parts:
            out = []
            for scope, run, start, took in zip(p.schedulerScope, p.runId, p.startedAt, p.durationMs, strict=True):
                if scope != at:
                    at, busy = scope, -1
                overlaps = start < busy
                busy = busy if overlaps else start + took
                out.append((scope, run, bool(overlaps)))
            yield pd.DataFrame(out, columns=["schedulerScope", "runId", "overlaps"])

    dealt = runs.select("schedulerScope", "runId", "startedAt", "durationMs").repartition(n, "schedulerScope").sortWithinPartitions("schedulerScope", "startedAt", "runId")
    return dealt.mapInPandas(step, "schedulerScope string, runId long, overlaps boolean")


def run_metrics(runs: DataFrame) -> DataFrame:
    """(trigger, outcome, runs, seconds and cumulative counts of durations by bucket as an array) of scheduler runs."""
    seconds = F.col("durationMs") / 1000
    return runs.groupBy("trigger", "outcome").agg(F.count("*").alias("runs"), F.sum(seconds).alias("seconds"), F.array(*(F.count_if(seconds <= b) for b in RUN_BUCKETS)).alias("buckets"))


def newest_runs(runs: DataFrame, scope: str, limit: int) -> DataFrame:
    """(place, runId, outcome, total): the newest runs of a scope, and how many there are in all."""
    mine = runs.where(F.col("schedulerScope") == scope)
    newest = mine.orderBy(F.desc("startedAt"), F.desc("runId")).limit(limit)
    total = mine.agg(F.count("*").alias("total"))
    placed = newest.withColumn("place", F.row_number().over(Window.orderBy(F.desc("startedAt"), F.desc("runId"))).cast("long"))  # ``limit`` rows
    return placed.join(F.broadcast(total)).select("place", "runId", "outcome", "total")


@dataclass
class Loop:
    """When a scheduler's next run is due; times in milliseconds, jitter given by the caller.

    Failures since the last success lengthen the interval; a run that is due while another goes on is skipped and
    counts neither as success nor as failure.
    """

    interval: int
    multiplier: float = 2.0
    longest: int = 3_600_000
    on_start: bool = False
    failures: int = 0
    busy: bool = False

    @classmethod
    def resumed(cls, runs: DataFrame, scope: str, interval: int, **settings) -> Loop:
        """With the failures that the history of a scope ends with."""
        last = consecutive_failures(runs.where(F.col("schedulerScope") == scope)).first()
        return cls(interval, failures=last["consecutiveFailures"] if last else 0, **settings)

    def delay(self, jitter: int = 0) -> int:
        """Until the next run: the interval, grown by failures up to the longest, at least a second."""
        grown = min(float(self.longest), self.interval * self.multiplier ** max(0, self.failures - 1))
        return max(1000, int(grown + jitter))

    def first(self, jitter: int = 0) -> int:
        return 0 if self.on_start else self.delay(jitter)

    def begin(self) -> bool:
        """Whether a run may start; False: it is skipped."""
        free = not self.busy
        self.busy = True
        return free

    def end(self, outcome: str) -> None:
        self.busy = False
        if outcome != "skipped":
            self.failures = self.failures + 1 if outcome == "error" else 0
