"""The live suggestion stream, and windowed counts of the same events.

Events of a (project, branch) wait until none has come for the debounce interval; then the burst passes the gates
one after another: empty query, memory at critical risk, low confidence, at most so many emitted in the last minute,
not the same suggestion again within the dedupe interval, no context. State holds the burst that waits, the times of
emitted suggestions, when each hash was emitted last, and the run of intents that raises confidence; it goes when
nothing in it matters any more.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..functions import hashing, text
from ..operators.context import infer_intent
from ..operators.ordered import runs

OUTPUT = "projectId string, branch string, eventId long, atMs long, processedMs long, status string, confidence double, suggestionHash string"
FIELDS = ("eventId", "atMs", "query", "category", "confidence", "critical", "known", "hash")
MINUTE = 60_000


@dataclass(frozen=True)
class Settings:
    """Intervals in milliseconds; the least confidence; whether projects at critical risk are left alone."""

    debounce: int = 1400
    per_minute: int = 6
    dedupe: int = 20_000
    least: float = 0.6
    on_critical: bool = True


class Gates:
    """The state of one (project, branch)."""

    def __init__(self, settings: Settings, made: str | None = None):
        self.settings = settings
        held = json.loads(made) if made else {}
        self.waiting: list[list] = held.get("waiting", [])  # a burst, in order of (time, id)
        self.emitted: list[int] = held.get("emitted", [])
        self.last: dict[str, int] = held.get("last", {})
        self.run: list = held.get("run", [None, 0])  # the latest intent, and how often in a row

    def stored(self) -> str:
        return json.dumps({"waiting": self.waiting, "emitted": self.emitted, "last": self.last, "run": self.run})

    def status(self, now: int, query: str, category: str, base: float, critical: bool, known: bool, h: str) -> tuple[str, float]:
        s = self.settings
        self.emitted = [t for t in self.emitted if now - t <= MINUTE]
        self.last = {k: t for k, t in self.last.items() if now - t < s.dedupe}
        if not query.strip():
            return "empty_query", 0.0
        if critical and s.on_critical:
            return "memory_risk_critical", 0.0
        self.run = [category, self.run[1] + 1] if self.run[0] == category else [category, 1]
        confidence = min(1.0, base + (min(0.12, 0.02 * self.run[1]) if self.run[1] > 1 else 0.0))
        if confidence < s.least:
            return "low_confidence", confidence
        if len(self.emitted) >= s.per_minute:
            return "rate_limited", confidence
        if h in self.last:
            return "duplicate", confidence
        if not known:
            return "no_context", confidence
        self.emitted.append(now)
        self.last[h] = now
        return "emitted", confidence

    def due(self) -> int | None:
        """When the burst that waits is processed."""
        return self.waiting[-1][1] + self.settings.debounce if self.waiting else None

    def process(self) -> Iterator[tuple]:
        """(eventId, atMs, processedMs, status, confidence, hash) of the burst."""
        now, burst, self.waiting = self.due(), self.waiting, []
        for event, at, *rest in burst:
            status, confidence = self.status(now, *rest)
            yield event, at, now, status, confidence, rest[-1]

    def feed(self, events: Iterator[tuple]) -> Iterator[tuple]:
        """Takes events in order of (time, id) and yields what bursts that have ended give."""
        for e in events:
            if self.waiting and e[1] > self.due():
                yield from self.process()
            self.waiting.append(list(e))


def event_query(kind: Column, path: Column, symbols: Column | None = None) -> Column:
    """What an event asks for: the change, the file, and up to four symbols in it; at most 400 characters."""
    verb = F.when(kind == "add", "new file").when(kind == "unlink", "removed file").otherwise("file change")
    some = F.filter(symbols, lambda x: x != "") if symbols is not None else F.array().cast("array<string>")
    hint = F.when(F.size(some) > 0, F.concat(F.lit("symbols "), F.array_join(F.slice(some, 1, 4), ", "))).otherwise("file")
    return F.substring(text.trim(F.concat(verb, F.lit(" in "), text.basename(path), F.lit("; review "), hint)), 1, 400)


def prepared(events: DataFrame, risks: DataFrame | None = None, contexts: DataFrame | None = None) -> DataFrame:
    """Events (projectId, branch, eventId, atMs, at, type, path, and symbols or query if there are any) with query,
    intent, confidence before any run of intents, hash, and whether the project is at critical risk and has a context.

    ``risks`` (projectId, risk) and ``contexts`` (projectId, context) are tables of a row per project; without them
    no project is at risk and all have a context. Unlink events drop.
    """
    asked = events if "query" in events.columns else events.withColumn("query", event_query(F.col("type"), F.col("path"), F.col("symbols") if "symbols" in events.columns else None))
    asked = asked.where("type <> 'unlink'")
    known = asked.join(risks.select("projectId", (F.col("risk") == "critical").alias("critical")), "projectId", "left") if risks is not None else asked.withColumn("critical", F.lit(False))
    known = known.join(contexts.select("projectId", (text.trim(F.col("context")) != "").alias("known")), "projectId", "left") if contexts is not None else known.withColumn("known", F.lit(True))
    h = F.sha2(F.concat_ws(":", "projectId", "branch", "query", "path"), 256)
    keep = [c for c in ("at",) if c in events.columns]
    return infer_intent(known, "query").select("projectId", "branch", "eventId", "atMs", *keep, F.coalesce("query", F.lit("")).alias("query"), "category", "confidence", F.coalesce("critical", F.lit(False)).alias("critical"), F.coalesce("known", F.lit(False)).alias("known"), h.alias("hash"))


COLUMNS = ["projectId", "branch", "eventId", "atMs", "processedMs", "status", "confidence", "suggestionHash"]


def suggestion_stream(events: DataFrame, settings: Settings = Settings(), risks: DataFrame | None = None, contexts: DataFrame | None = None, late: str = "10 seconds") -> DataFrame:
    """A streaming DataFrame of decisions, with state per (project, branch).

    Events need ``at``, their time as a timestamp. A burst is decided when the watermark, ``late`` behind the latest
    event, has passed its end; later events drop. State without a burst goes when its intervals are over.
    """

    def rows_of(parts: Iterator[pd.DataFrame]) -> list[tuple]:
        out = [r for p in parts for r in zip(*(p[c] for c in FIELDS), strict=True)]
        return sorted(((int(r[0]), int(r[1]), str(r[2]), str(r[3]), float(r[4]), bool(r[5]), bool(r[6]), str(r[7])) for r in out), key=lambda r: (r[1], r[0]))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gates = Gates(settings, state.get[0] if state.exists else None)
        seen = rows_of(parts) if not state.hasTimedOut else []
        known = [tuple(w) for w in gates.waiting]
        gates.waiting = []
        out = list(gates.feed(sorted(known + seen, key=lambda r: (r[1], r[0]))))
        watermark = state.getCurrentWatermarkMs()
        due = gates.due()
        if due is not None and due <= watermark:
            out += gates.process()
            due = None
        ends = [t + MINUTE for t in gates.emitted] + [t + settings.dedupe for t in gates.last.values()]
        wake = due if due is not None else max(ends, default=0)
        if due is None and wake <= watermark and not (gates.run[0] and not state.hasTimedOut):
            state.remove()
        else:
            state.update((gates.stored(),))
            state.setTimeoutTimestamp(max(wake, watermark + 1))
        if out:
            yield pd.DataFrame([(*key, *o) for o in out], columns=COLUMNS)

    made = prepared(events.withWatermark("at", late), risks, contexts)
    return made.groupBy("projectId", "branch").applyInPandasWithState(step, OUTPUT, "gates string", "append", GroupStateTimeout.EventTimeTimeout)


def suggestion_batch(events: DataFrame, settings: Settings = Settings(), risks: DataFrame | None = None, contexts: DataFrame | None = None) -> DataFrame:
    """The same decisions over a finished table: sorted partitions are streamed, so no group is held in memory.

    When a burst is processed is known before its events come, from a pass over times alone; so no burst waits,
    and one that never pauses needs no more memory than others.
    """
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, gates = None, Gates(settings)
        for p in parts:
            out = []
            for key, now, row in zip(zip(p.projectId, p.branch, strict=True), p.processedMs, zip(*(p[c] for c in FIELDS), strict=True), strict=True):
                if key != at:
                    at, gates = key, Gates(settings)
                status, confidence = gates.status(now, *row[2:])
                out.append((*key, row[0], row[1], now, status, confidence, row[-1]))
            yield pd.DataFrame(out, columns=COLUMNS)

    made = prepared(events, risks, contexts).select("projectId", "branch", *FIELDS)
    keys = ["projectId", "branch"]
    # latest first: an event with no other within the pause after it ends a burst, which those before it are in
    back = Window.partitionBy(*keys).orderBy(F.desc("atMs"), F.desc("eventId"))
    after = F.lag("atMs").over(back)
    due = F.when(after.isNull() | (after - F.col("atMs") > settings.debounce), F.col("atMs") + settings.debounce)
    timed = made.repartition(n, *keys).withColumn("due", due)
    timed = timed.withColumn("processedMs", F.last("due", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("due")
    return timed.sortWithinPartitions(*keys, "atMs", "eventId").mapInPandas(run, OUTPUT)


def checksum(body: Column) -> Column:
    """Eight hexadecimal digits of the checksum that deltas carry."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: f"{hashing.fnv1a_float(v or ''):08x}")

    return run(body)


def stamped(deltas: DataFrame) -> DataFrame:
    """Deltas with the checksum of session, step, type and payload, whatever they came with."""
    body = F.coalesce("payload", F.lit("null"))
    return deltas.withColumn("checksum", checksum(F.concat_ws(":", "sessionId", F.col("step").cast("string"), "deltaType", body)))


def stream_events(events: DataFrame) -> DataFrame:
    """Deltas to append to a bus, from (projectId, eventType, payload as a JSON object, atMs)."""
    rest = F.expr("substring(trim(payload), 2)")
    body = F.concat(F.lit('{"eventType":"'), "eventType", F.lit('"'), F.when(text.trim(rest) == "}", F.lit("")).otherwise(F.lit(",")), rest)
    session = F.concat(F.lit("daemon-"), "eventType", F.lit("-"), F.lower(F.conv(F.col("atMs").cast("string"), 10, 36)))
    made = events.select(session.alias("sessionId"), "projectId", F.col("atMs").alias("step"), F.lit("append").alias("deltaType"), body.alias("payload"), F.lit(None).cast("double").alias("tokenEstimate"), F.lit(None).cast("struct<start: double, end: double>").alias("replaceSpan"), F.col("atMs").alias("timestamp"))
    return stamped(made)


def branch_switch(branches: DataFrame, project: str, branch: str, now: int, parent: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(branches, the event that tells of it) after a switch to a branch, which is made if it isn't there."""
    from ..operators.records import ensure_branches

    spark = branches.sparkSession
    name = branch.strip() or "main"
    wanted = spark.createDataFrame([(project, name, parent, None)], "projectId string, branch string, parentBranch string, forkedFromCommit string")
    told = spark.createDataFrame([(project, "branchSwitched", json.dumps({"projectId": project, "branch": name}, separators=(",", ":")), now)], "projectId string, eventType string, payload string, atMs long")
    return ensure_branches(branches, wanted, now), stream_events(told)


def debounced(events: DataFrame, gap: str = "1400 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Bursts of events per (project, branch): a session window that ends ``gap`` after the last event; on a stream it
    closes when the watermark has passed it."""
    return events.withWatermark("at", late).groupBy("projectId", "branch", F.session_window("at", gap)).agg(F.count("*").alias("n"), F.max("eventId").alias("lastEvent"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Events per type and tumbling window; on a stream, windows close when the watermark has passed them."""
    return events.withWatermark("at", late).groupBy(F.window("at", size), "type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "type", "n")


# What a delta may do.
DELTA_TYPES = ("snapshot", "append", "replace", "remove")


def valid_deltas(lines: DataFrame, column: str = "value", most_bytes: int = 262_144) -> DataFrame:
    """Stream deltas parsed from JSON lines, with their checksum made anew: too long, malformed or incomplete ones drop.

    A session, a step from 0 on and a known type must be there; a project, an estimate of tokens and a span may be
    missing, but if they are there they must be whole.
    """
    schema = "sessionId string, projectId string, step double, deltaType string, payload string, tokenEstimate double, replaceSpan struct<start: double, end: double>, timestamp long"
    c = F.col
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    parsed = lines.where(F.octet_length(column) <= most_bytes).select(F.from_json(column, schema).alias("d"), F.get_json_object(column, "$.replaceSpan").alias("given"), F.get_json_object(column, "$.tokenEstimate").alias("estimate")).select("d.*", "given", "estimate")
    span = (c("given").isNull() & c("replaceSpan").isNull()) | (finite(c("replaceSpan.start")) & (c("replaceSpan.start") >= 0) & finite(c("replaceSpan.end")) & (c("replaceSpan.end") >= c("replaceSpan.start")))
    estimate = c("estimate").isNull() | finite(c("tokenEstimate"))
    whole = c("sessionId").isNotNull() & finite(c("step")) & (c("step") >= 0) & c("deltaType").isin(*DELTA_TYPES) & F.coalesce(span, F.lit(False)) & F.coalesce(estimate, F.lit(False))
    return stamped(parsed.where(whole).drop("given", "estimate").withColumn("step", c("step").cast("long")))


def client_filter(deltas: DataFrame, project: str) -> DataFrame:
    """What a client of one project receives: its own deltas and those without a project."""
    return deltas.where(F.col("projectId").isNull() | (F.col("projectId") == project))


def expired(emitted: DataFrame, acks: DataFrame, ttl_ms: int = 60_000) -> DataFrame:
    """(suggestionHash, atMs, expiresAt) of suggestions that nobody applied or suppressed within their time to live.

    A plain acknowledgement doesn't stop the expiry.
    """
    final = acks.where(F.col("status").isin("applied", "suppressed")).select("suggestionHash", F.col("atMs").alias("ackedAt"))
    within = [final["suggestionHash"] == emitted["suggestionHash"], final["ackedAt"] >= emitted["atMs"], final["ackedAt"] <= emitted["atMs"] + ttl_ms]
    return emitted.join(final, within, "left_anti").select("suggestionHash", "atMs", (F.col("atMs") + ttl_ms).alias("expiresAt"))


def with_history(events: DataFrame, category: str = "category") -> DataFrame:
    """``seen``: how often a (project, branch) has had the same category in a row up to this event, and the bonus
    of min(0.12, 0.02 * seen) that repeats earn. A project of any size is many tasks; see ``ordered.runs``."""
    out = runs(events, ["projectId", "branch"], ["atMs", "eventId"], category).drop("place")
    return out.withColumn("bonus", F.when(F.col("seen") > 1, F.least(F.lit(0.12), F.lit(0.02) * F.col("seen"))).otherwise(0.0))
