import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strata.functions import hashing
from strata.streaming import suggestions
from strata.streaming.suggestions import Settings

START = 1_700_000_000_000  # a stream's first watermark is the epoch
SCHEMA = "projectId string, branch string, eventId long, atMs long, type string, path string"


def events(spark, rows, extra=""):
    return spark.createDataFrame([(*r[:3], r[3] + START, *r[4:]) for r in rows], SCHEMA + extra).withColumn("at", F.timestamp_millis("atMs"))


def many(spark):
    rows = [("p", "main", i, i * 1000 + i // 7 * 3000, ["change", "add", "unlink"][i % 3 if i % 5 else 0], f"/src/{['auth', 'test-error-bug', 'plain', 'crash-error'][i % 4]}.ts") for i in range(120)]
    rows += [("q", "main", 1000 + i, i * 5000, "change", "/src/auth.ts") for i in range(40)] + [("r", "main", 2000 + i, i * 5000, "change", "/src/auth.ts") for i in range(5)] + [("s", "main", 3000 + i, i * 5000, "add", "/src/auth-xss.ts") for i in range(5)]
    return events(spark, rows)


def tables(spark):
    return spark.createDataFrame([("p", "warning"), ("r", "critical")], "projectId string, risk string"), spark.createDataFrame([("p", "context"), ("q", "context"), ("r", "context"), ("s", "  ")], "projectId string, context string")


def statuses(df):
    return [r["status"] for r in df.orderBy("atMs", "eventId").collect()]


def test_what_an_event_asks_for(spark):
    rows = [("p", "main", 1, 0, "add", "/a/b.ts", ["f", "", "g", "h", "i", "j"]), ("p", "main", 2, 0, "change", "c:\\\\x\\\\y.py", []), ("p", "main", 3, 0, "change", "/" + "z" * 500, None)]
    got = [r["query"] for r in suggestions.prepared(events(spark, rows, ", symbols array<string>")).orderBy("eventId").collect()]
    assert got[0] == "new file in b.ts; review symbols f, g, h, i" and got[1] == "file change in y.py; review file" and len(got[2]) == 400


def test_each_gate(spark):
    low = events(spark, [("p", "main", 1, 0, "change", "/plain.ts")])
    assert statuses(suggestions.suggestion_batch(low)) == ["low_confidence"]
    # the same intent in a row raises confidence: 0.5 for a word, then + 0.02 for each in the run
    rows = [("p", "main", i, i * 30_000, "change", f"/auth{i}.ts".replace("auth", "auth ")) for i in range(7)]
    got = suggestions.suggestion_batch(events(spark, rows)).orderBy("eventId").collect()
    assert [round(r["confidence"], 2) for r in got] == [0.5, 0.54, 0.56, 0.58, 0.6, 0.62, 0.62] and [r["status"] for r in got] == ["low_confidence"] * 4 + ["emitted"] * 3
    empty = events(spark, [("p", "main", 1, 0, "change", "/x.ts")]).withColumn("query", F.lit("  "))
    assert statuses(suggestions.suggestion_batch(empty)) == ["empty_query"]
    risks, contexts = tables(spark)
    two = "/auth xss.ts"
    assert statuses(suggestions.suggestion_batch(events(spark, [("r", "main", 1, 0, "change", two)]), risks=risks)) == ["memory_risk_critical"]
    assert statuses(suggestions.suggestion_batch(events(spark, [("r", "main", 1, 0, "change", two)]), Settings(on_critical=False), risks)) == ["emitted"]
    assert statuses(suggestions.suggestion_batch(events(spark, [("s", "main", i, i * 10_000, "change", two) for i in range(2)]), contexts=contexts)) == ["no_context"] * 2
    again = events(spark, [("p", "main", i, t, "change", two) for i, t in enumerate((0, 15_000, 21_000, 39_000, 42_000))])
    assert statuses(suggestions.suggestion_batch(again)) == ["emitted", "duplicate", "emitted", "duplicate", "emitted"]
    often = events(spark, [("p", "main", i, i * 5000, "change", f"/auth xss {i}.ts") for i in range(15)])
    assert statuses(suggestions.suggestion_batch(often)) == ["emitted"] * 6 + ["rate_limited"] * 7 + ["emitted"] * 2


def test_bursts_are_processed_together_at_their_end(spark):
    rows = [("p", "main", i, t, "change", f"/auth xss{i}.ts") for i, t in enumerate((0, 1000, 2400, 3900, 9000))]
    got = suggestions.suggestion_batch(events(spark, rows)).orderBy("eventId").collect()
    assert [r["processedMs"] - START for r in got] == [3800, 3800, 3800, 5300, 10_400]


def test_every_status_occurs_and_branches_are_apart(spark):
    risks, contexts = tables(spark)
    e = many(spark)
    both = e.unionByName(e.withColumn("branch", F.lit("other")))
    got = suggestions.suggestion_batch(both, risks=risks, contexts=contexts).collect()
    by = {b: sorted((r["projectId"], r["eventId"], r["status"]) for r in got if r["branch"] == b) for b in ("main", "other")}
    assert by["main"] == by["other"] and len(by["main"]) == e.where("type <> 'unlink'").count()
    assert set(Counter(r["status"] for r in got)) == {"emitted", "low_confidence", "rate_limited", "duplicate", "memory_risk_critical", "no_context"}


@pytest.mark.parametrize("files", [1, 5])
def test_stream_equals_batch(spark, tmp_path, files):
    risks, contexts = tables(spark)
    e = many(spark)
    flush = events(spark, [(p, "main", 9999, 10_000_000, "change", "/x.ts") for p in "pqrs"])
    cuts = [START + k * 300_000 / files for k in range(files + 1)]
    schema = e.schema
    for k in range(files):
        e.where((F.col("atMs") >= cuts[k]) & (F.col("atMs") < cuts[k + 1])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    flush.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"sugg{files}"
    q = suggestions.suggestion_stream(stream, risks=risks, contexts=contexts, late="400 seconds").writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = sorted(map(tuple, suggestions.suggestion_batch(e, risks=risks, contexts=contexts).collect()))
    got = sorted(map(tuple, spark.table(name).where("eventId <> 9999").collect()))
    assert [(*r[:6], round(r[6], 6), r[7]) for r in got] == [(*r[:6], round(r[6], 6), r[7]) for r in want]


def test_debounce_and_windows_on_a_stream(spark, tmp_path):
    e = many(spark)
    e.write.parquet(str(tmp_path / "in"))
    events(spark, [("z", "main", 1, 99_000_000, "change", "/x")]).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    for name, f, mode in (("deb", lambda d: suggestions.debounced(d).drop("session_window"), "append"), ("win", suggestions.windowed_counts, "append")):
        q = f(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, f(e).collect()))


def test_valid_deltas(spark):
    good = {"sessionId": "s", "step": 1, "deltaType": "append", "payload": "x"}
    bad = [{**good, "step": -1}, {**good, "deltaType": "other"}, {**good, "sessionId": None}, {**good, "tokenEstimate": "many"}, {**good, "replaceSpan": {"start": 1}}, {**good, "replaceSpan": {"start": 3, "end": 2}}, {**good, "replaceSpan": 5}]
    fine = [good, {**good, "projectId": "p", "tokenEstimate": 2.5, "replaceSpan": {"start": 0, "end": 2}, "checksum": "wrong"}]
    lines = [json.dumps(x) for x in (*bad, *fine)] + ["no", '{"sessionId": "s", "step": 1, "deltaType": "append", "tokenEstimate": 1e999}', json.dumps({**good, "payload": "y" * 300_000})]
    d = suggestions.valid_deltas(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert d.count() == 2 and {r["checksum"] for r in d.collect()} == {f"{hashing.fnv1a_float('s:1:append:x'):08x}"}
    assert suggestions.client_filter(d, "p").count() == 2 and suggestions.client_filter(d, "other").count() == 1


def test_events_of_a_bus(spark):
    rows = [("p", "agentStatus", '{"a": 1}', 1_700_000_000_000), ("p", "x", "{}", 35)]
    got = suggestions.stream_events(spark.createDataFrame(rows, "projectId string, eventType string, payload string, atMs long")).orderBy("step").collect()
    assert json.loads(got[0]["payload"]) == {"eventType": "x"} and json.loads(got[1]["payload"]) == {"eventType": "agentStatus", "a": 1}
    assert got[0]["sessionId"] == "daemon-x-z" and got[0]["checksum"] == f"{hashing.fnv1a_float('daemon-x-z:35:append:' + got[0]['payload']):08x}"
    branches = spark.createDataFrame([("p", "main", None, None, 1, 1)], "projectId string, branch string, parentBranch string, forkedFromCommit string, createdAt long, updatedAt long")
    after, told = suggestions.branch_switch(branches, "p", " feature ", 9, "main")
    assert {r["branch"] for r in after.collect()} == {"main", "feature"} and json.loads(told.first()["payload"]) == {"eventType": "branchSwitched", "projectId": "p", "branch": "feature"}


def test_a_burst_without_a_pause_waits_nowhere(spark):
    rows = [("p", "main", i, i * 700, "change", f"/auth xss{i % 9}.ts") for i in range(300)]
    made = suggestions.suggestion_batch(events(spark, rows))
    gates = suggestions.Gates(Settings())
    fed = [tuple(r) for r in suggestions.prepared(events(spark, rows)).orderBy("atMs", "eventId").select(*suggestions.FIELDS).collect()]
    want = [*gates.feed(fed), *gates.process()]
    assert [(r["eventId"], r["atMs"], r["processedMs"], r["status"], r["confidence"], r["suggestionHash"]) for r in made.orderBy("eventId").collect()] == want
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "processedMs" in plan.split("MapInPandas", 1)[1].split("\n", 1)[1]  # known before Python sees the events
