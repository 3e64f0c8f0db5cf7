"""Streams with state and timers: suggestions that expire or are settled, and a bus that replays to clients who join.

State lives in RocksDB, which ``transformWithState`` needs; the session's provider is set when a stream is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..operators.lineage import kept

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What becomes of a suggestion.
ACKED, APPLIED, SUPPRESSED, EXPIRED = "contextDeltaAcked", "contextDeltaApplied", "contextDeltaSuppressed", "contextDeltaExpired"
OUTCOMES = {"ack": ACKED, "applied": APPLIED, "suppressed": SUPPRESSED}


def with_rocks(spark: SparkSession) -> None:
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, ROCKS)


LIFE = "suggestionHash string, emittedMs long, eventType string, atMs long"


class Life(StatefulProcessor):
    """The suggestions of one hash that wait, and acknowledgements that may have come before them.

    Nothing is decided before the watermark has passed it, so rows may come in any order and any portions: all up to
    the watermark are then gone through in the order of their times.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "atMs long")  # emitted, neither settled nor expired
        self.waiting = handle.getListState("waiting", "atMs long, kind string")  # rows later than the watermark

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for at, kind in zip(part["atMs"], part["kind"], strict=True):
                self.waiting.appendValue((int(at), str(kind)))
                self.handle.registerTimer(int(at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()  # no row up to it comes any more
        waiting = sorted((int(r[0]), str(r[1])) for r in self.waiting.get()) if self.waiting.exists() else []
        held = sorted(int(r[0]) for r in self.open.get()) if self.open.exists() else []
        out = []

        def expire(until: int) -> None:
            """An acknowledgement at the very end still counts."""
            while held and held[0] + self.ttl_ms < until:
                out.append((key[0], held[0], EXPIRED, held[0] + self.ttl_ms))
                del held[0]

        # of one moment, suggestions come before what is said of them
        for at, kind in sorted((w for w in waiting if w[0] <= now), key=lambda w: (w[0], w[1] != "emitted", w[1])):
            expire(at)
            if kind == "emitted":
                held.append(at)
            else:
                out += [(key[0], x, OUTCOMES[kind], at) for x in held]
                if kind != "ack":
                    held.clear()
        expire(now + 1)
        for at in held:
            self.handle.registerTimer(at + self.ttl_ms)
        for state, left in ((self.open, [(x,) for x in held]), (self.waiting, [w for w in waiting if w[0] > now])):
            state.clear()
            if left:
                state.put(left)
        if out:
            yield pd.DataFrame(out, columns=["suggestionHash", "emittedMs", "eventType", "atMs"])

    def close(self) -> None:
        pass


def lives(emitted: DataFrame, acks: DataFrame, ttl_ms: int = 60_000, late: str = "10 seconds") -> DataFrame:
    """A stream of what becomes of suggestions (suggestionHash, emittedMs, eventType, atMs).

    ``emitted`` (suggestionHash, atMs) and ``acks`` (suggestionHash, atMs, status) are streams. A plain ``ack`` is told
    and changes nothing; ``applied`` and ``suppressed`` end all open suggestions of that hash; the others expire
    ``ttl_ms`` after they were emitted, once the watermark, ``late`` behind the latest row, has passed that. Later rows
    drop, as do other statuses. For a finished table see ``lives_batch``.
    """
    with_rocks(emitted.sparkSession)
    both = emitted.select("suggestionHash", "atMs", F.lit("emitted").alias("kind")).unionByName(acks.where(F.col("status").isin(*OUTCOMES)).select("suggestionHash", "atMs", F.col("status").alias("kind")))
    timed = both.withColumn("at", F.timestamp_millis("atMs")).withWatermark("at", late)
    return timed.groupBy("suggestionHash").transformWithStateInPandas(Life(ttl_ms), LIFE, "append", "eventTime")


def lives_batch(emitted: DataFrame, acks: DataFrame, ttl_ms: int = 60_000) -> DataFrame:
    """The same of finished tables: a suggestion ends at the first ``applied`` or ``suppressed`` within its time, and
    plain acknowledgements up to then are told.

    Time is cut into buckets of ``ttl_ms``, and a bucket of a hash is a key of its own. What is said in a bucket has a
    place there; a suggestion is told from its own place up to the first end, else up to its deadline in the next
    bucket. Only those places are joined, so no more rows are made than are told.
    """
    width = max(ttl_ms, 1)
    bucket = F.floor(F.col("atMs") / width).cast("long")
    a = acks.where(F.col("status").isin(*OUTCOMES) & F.col("suggestionHash").isNotNull() & F.col("atMs").isNotNull())
    # of one moment, suggestions come first, then plain acknowledgements, then the first in alphabetical order ends it
    a = a.select("suggestionHash", bucket.alias("b"), "atMs", "status", F.when(F.col("status") == "ack", 1).when(F.col("status") == "applied", 2).otherwise(3).alias("rank"))
    e = emitted.select("suggestionHash", F.col("atMs").alias("emittedMs"), bucket.alias("b"), F.monotonically_increasing_id().alias("id"))
    begin = F.struct("b", F.col("emittedMs").alias("atMs"), F.lit(0).alias("rank"))
    deadline = F.struct((F.col("b") + 1).alias("b"), (F.col("emittedMs") + ttl_ms).alias("atMs"), F.lit(4).alias("rank"))
    marks = e.select("suggestionHash", "emittedMs", "id", F.explode(F.array(begin, deadline)).alias("x")).select("suggestionHash", "emittedMs", "id", "x.*")
    both = marks.unionByName(a, allowMissingColumns=True)
    order = ["atMs", "rank", "id"]
    up = Window.partitionBy("suggestionHash", "b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("suggestionHash", "b").orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    says, ends = F.col("rank").isin(1, 2, 3), F.col("rank").isin(2, 3)
    placed = both.withColumn("place", F.count_if(says).over(up)).withColumn("firstEnd", F.min(F.when(ends, F.col("place"))).over(up))
    placed = kept(placed.withColumns({"nextEnd": F.min(F.when(ends, F.col("place"))).over(down), "rest": F.count_if(says).over(down)}), "lives")

    own, late = F.col("rank") == 0, F.col("rank") == 4
    take = {"from": (own, F.col("place") + 1), "to": (own, F.coalesce("nextEnd", F.col("place") + F.col("rest"))), "ended": (own, F.col("nextEnd").isNotNull()), "b": (own, F.col("b")), "to2": (late, F.coalesce("firstEnd", "place")), "ended2": (late, F.col("firstEnd").isNotNull())}
    each = placed.where(own | late).groupBy("id").agg(F.first("suggestionHash").alias("suggestionHash"), F.first("emittedMs").alias("emittedMs"), *(F.max(F.when(when, value)).alias(k) for k, (when, value) in take.items()))
    each = kept(each, "lives-each")
    to2 = F.when(~F.col("ended"), F.col("to2")).otherwise(0)
    spans = F.array(F.struct("b", F.col("from").alias("i"), F.col("to").alias("j")), F.struct((F.col("b") + 1).alias("b"), F.lit(1).cast("long").alias("i"), to2.cast("long").alias("j")))
    wanted = each.select("suggestionHash", "emittedMs", F.explode(F.filter(spans, lambda x: x["j"] >= x["i"])).alias("x"))
    wanted = wanted.select("suggestionHash", "emittedMs", "x.b", F.explode(F.sequence("x.i", "x.j")).alias("place"))
    names = F.create_map(*[F.lit(x) for p in OUTCOMES.items() for x in p])
    said = placed.where(says).select("suggestionHash", "b", "place", "atMs", names[F.col("status")].alias("eventType"))
    told = wanted.join(said, ["suggestionHash", "b", "place"]).select("suggestionHash", "emittedMs", "eventType", "atMs")
    left = each.where(~F.col("ended") & ~F.col("ended2")).select("suggestionHash", "emittedMs", F.lit(EXPIRED).alias("eventType"), (F.col("emittedMs") + ttl_ms).alias("atMs"))
    return told.unionByName(left)


#: Deltas of a project that the bus holds, and those that a client gets when it joins.
HELD, REPLAYED = 200, 50

BUS = "client string, projectId string, place long, kind string, payload string, atMs long"


class Ring(StatefulProcessor):
    """The last deltas of a project in the slots of a ring, and who listens."""

    def __init__(self, held: int, replayed: int):
        self.held, self.replayed = held, replayed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "slot int", "place long, payload string, atMs long")
        self.count = handle.getValueState("count", "n long")
        self.clients = handle.getMapState("clients", "client string", "since long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = int(self.count.get()[0]) if self.count.exists() else 0
        listening = {str(k[0]) for k in self.clients.keys()}
        every = [r for part in rows for r in zip(part["atMs"], part["rank"], part["id"], part["kind"], part["client"], part["payload"], strict=True)]
        out, began = [], n
        fresh: dict[int, tuple] = {}  # what this batch puts into slots

        def at(slot: int) -> tuple:
            return fresh[slot] if slot in fresh else self.slots.getValue((slot,))

        for at_ms, _, _, kind, client, payload in sorted(every, key=lambda r: (r[0], r[1], r[2])):
            if kind == "join":
                out.append((client, key[0], -1, "bootstrap", None, at_ms))
                for place in range(max(0, n - self.replayed, n - self.held), n):
                    _, body, then = at(place % self.held)
                    out.append((client, key[0], place, "replay", body, then))
                listening.add(client)
                self.clients.updateValue((client,), (int(at_ms),))
            elif kind == "leave":
                listening.discard(client)
                self.clients.removeKey((client,))
            else:
                fresh[n % self.held] = (n, payload, int(at_ms))
                out += [(c, key[0], n, "live", payload, at_ms) for c in sorted(listening)]
                n += 1
        for slot, value in fresh.items():
            self.slots.updateValue((slot,), value)
        if n > began:
            self.count.update((n,))
        if out:
            yield pd.DataFrame(out, columns=["client", "projectId", "place", "kind", "payload", "atMs"])

    def close(self) -> None:
        pass


def bus_rows(deltas: DataFrame, clients: DataFrame) -> DataFrame:
    """Deltas (projectId, id, payload, atMs) and clients' doings (projectId, client, kind: join or leave, atMs) in one table."""
    rank = F.when(F.col("kind") == "delta", 0).otherwise(1)
    d = deltas.select("projectId", F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("client"), F.col("id").cast("string").alias("id"), "payload", "atMs")
    c = clients.where("kind IN ('join', 'leave')").select("projectId", "kind", "client", F.concat_ws(":", "kind", "client").alias("id"), F.lit(None).cast("string").alias("payload"), "atMs")
    return d.unionByName(c).withColumn("rank", rank)


def bus(deltas: DataFrame, clients: DataFrame, held: int = HELD, replayed: int = REPLAYED) -> DataFrame:
    """A stream of what each client of a project receives (client, projectId, place, kind, payload, atMs).

    A client that joins gets a ``bootstrap``, then the last ``replayed`` of the ``held`` deltas that the project keeps,
    then each new one while it listens. Rows of a batch are taken in the order of their times, deltas first; batches are
    taken as they come. ``place`` counts a project's deltas from 0.
    """
    with_rocks(deltas.sparkSession)
    return bus_rows(deltas, clients).groupBy("projectId").transformWithStateInPandas(Ring(held, replayed), BUS, "append", "none")


def bus_batch(deltas: DataFrame, clients: DataFrame, held: int = HELD, replayed: int = REPLAYED, live: bool = True) -> DataFrame:
    """The same of finished tables; without ``live`` only what clients get when they join.

    Each delta has a place in its project, and each joining asks for the places before it and, until the client says
    something again, after it: they meet by place, so no more rows are made than are told.
    """
    order = Window.partitionBy("projectId").orderBy("atMs", "rank", "id")
    rows = bus_rows(deltas, clients).withColumn("n", F.count_if(F.col("kind") == "delta").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = rows.where("kind = 'delta'").select("projectId", (F.col("n") - 1).alias("place"), "payload", "atMs")
    doings = Window.partitionBy("projectId", "client").orderBy("atMs", "id")
    said = rows.where("kind <> 'delta'").withColumn("until", F.lead("n").over(doings)).where("kind = 'join'").select("projectId", "client", "n", "until", F.col("atMs").alias("joinedMs"))
    if live:
        totals = placed.groupBy("projectId").agg(F.count("*").alias("total"))
        said = said.join(totals, "projectId", "left").withColumn("end", F.coalesce("until", "total", F.lit(0)))
    else:
        said = said.withColumn("end", F.col("n"))
    wanted = said.withColumn("first", F.greatest(F.lit(0), F.col("n") - min(held, replayed))).where("end > first")
    wanted = wanted.select("projectId", "client", "n", F.explode(F.sequence("first", F.col("end") - 1)).alias("place"))
    kind = F.when(F.col("place") < F.col("n"), "replay").otherwise("live")
    told = wanted.join(placed, ["projectId", "place"]).select("client", "projectId", "place", kind.alias("kind"), "payload", "atMs")
    hello = said.select("client", "projectId", F.lit(-1).cast("long").alias("place"), F.lit("bootstrap").alias("kind"), F.lit(None).cast("string").alias("payload"), F.col("joinedMs").alias("atMs"))
    return told.unionByName(hello)
