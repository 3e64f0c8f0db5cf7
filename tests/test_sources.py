import json
import random

import pytest
from pyspark.sql import functions as F

from strata.functions import text
from strata.operators import agents, compaction, context, ingest, ngram, records, scheduler
from strata.sources import corpus, options, policy, sinks
from strata.sources import tables as T
from strata.streaming.files import watch_files


def test_options_are_bounded():
    assert [options.integer(x, 1, 10) for x in (0, 5.9, "7.2", "99", " ", "x", None, float("nan"), True, [3])] == [1, 5, 7, 10, None, None, None, None, None, None]
    assert [options.boolean(x, True) for x in (False, " Off ", "YES", "maybe", 1, None)] == [False, False, True, True, True, True] and not options.boolean("0", True)
    assert options.strings([" a ", "", 3, "b" * 300, "c"], most=2) == ["a", "b" * 256] and options.strings("a") is None
    assert options.trimmed("  ") is None and options.trimmed(" abc ", 2) == "ab" and options.port("70000", 8080) == 65_535 and options.port("x", 8080) == 8080
    assert options.number("1e400") is None and options.number("0.5", 1, 2) == 1


def test_files_of_projects(spark, tmp_path):
    for name in ("a.ts", "b.cxx", "vendor/c.py", "node_modules/d.ts", ".tox/e.py", "f.md", "out/g.ts"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"// {name}")
    names = lambda df: sorted(r["path"].rsplit(tmp_path.name, 1)[1] for r in df.collect())
    assert names(T.text_files(spark, str(tmp_path), T.CODE_EXTENSIONS)) == ["/a.ts", "/b.cxx", "/vendor/c.py"]
    assert names(T.text_files(spark, str(tmp_path), corpus.EXTENSIONS, skipped=corpus.SKIPPED_FOLDERS)) == ["/a.ts", "/f.md", "/vendor/c.py"]
    q = watch_files(spark, str(tmp_path), "p").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("seen").collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in got) == ["a.ts", "b.cxx", "c.py"] and {r["type"] for r in got} == {"add"}


def test_technical_rows_of_a_dataset(spark):
    rows = [(1, "the schematic of a rowing boat on the lake today"), (2, "a rowing boat on the lake, a long way from here"), (3, "short api"), (4, "x => y in a text of at least twenty four letters"), (5, "m" * 4000 + " api")]
    got = {r["k"]: r["snippet"] for r in corpus.dataset_corpus(spark.createDataFrame(rows, "k int, t string"), "t", name="d").collect()}
    assert sorted(got) == [1, 4] and got[4].startswith("# dataset:d\nx => y")


def test_pairs_are_written_with_a_manifest(spark, tmp_path):
    chunks = spark.createDataFrame([(str(i), f"text {i}", f"summary {i}") for i in range(7)], "id string, text string, summary string")
    m = sinks.write_pairs(ingest.training_pairs(chunks), str(tmp_path / "pairs")).first()
    assert (m["chunksCollected"], m["pairsWritten"], m["positivePairs"], m["negativePairs"]) == (7, 14, 7, 7)
    (tmp_path / "pairs" / "zz.json").write_text("no json\n")
    back = T.json_lines(spark, str(tmp_path / "pairs"), "left string, right string, label double")
    assert back.count() == 14 and back.where("label > 0.5 AND replace(left, 'text', 'summary') = right").count() == 7
    sinks.write_dataset(chunks, str(tmp_path / "rows"))
    assert spark.read.json(str(tmp_path / "rows")).count() == 7
    index = sinks.build_index(chunks.selectExpr("id", "text AS title", "summary", "'' AS content"), str(tmp_path / "index"), 16)
    assert index.count() == 7 and index.where("size(embedding) = 16").count() == 7


def test_dashboard_text(spark):
    rows = [(f"m{i}", "p" if i else "q", "x" * 1200, 1_700_000_000_000) for i in range(30)]
    m = spark.createDataFrame(rows, "id string, projectId string, content string, lastAccessedAt long")
    trend = spark.createDataFrame([(None, 10, 0.25, 3.0, 1, 1_700_000_000_000), (None, 1500, 0.5, 4.5, 0, 1_700_000_000_500), ("p", 5, 1.0, 1.0, 0, 1)], "projectId string, totalRows long, compactionRate double, savedPercent double, integrityAnomalyTotal long, createdAt long")
    out = sinks.dashboard_text(records.dashboard(m, trend), 1_700_000_000_000, "p").split("\n")
    assert out[2:4] == ["generated: 2023-11-14 22:13:20Z", "scope: p"] and "  rows: total=30 compacted=0 plain=30 (0.00% compacted)" in out
    assert "  delta: saved=+1.50pp compaction=+25.00pp anomalies=-1" in out and "  chars: original=36,000 stored=36,000 saved=0 (0.00%)" in out
    at = out.index("Global trend")
    assert out[at + 1] == "  window: 2023-11-14 22:13:20Z -> 2023-11-14 22:13:20.500Z (2 points)" and out[at + 3].split() == ["timestamp", "|", "rows", "|", "compaction", "|", "saved", "|", "anomalies"]
    assert out[-2].split(" | ")[1:4] == ["p      ", "WARNING", "29  "] and out[-1].split(" | ")[2] == "HEALTHY"
    none = sinks.dashboard_text(records.dashboard(m.limit(0), trend.limit(0)), 0)
    assert "  (no snapshots)" in none and none.endswith("  (no project rows)") and "scope: all projects" in none


def test_health_and_advice_of_audits(spark):
    rows = [("a", 10, 0.0, 0.0, 1), ("b", 60, 0.4, 50.0, 0), ("c", 130, 0.9, 4.0, 0), ("d", 49, 0.0, 0.0, 0), ("e", 119, 0.5, 0.0, 0)]
    got = compaction.health(spark.createDataFrame(rows, "k string, totalRows long, compactionRate double, savedPercent double, anomalies long")).orderBy("k").collect()
    assert [r["status"] for r in got] == ["critical", "warning", "warning", "healthy", "healthy"] and [r["recommendation"] for r in got[1:3]] == [compaction.HEALTH["coverage"], compaction.HEALTH["savings"]]
    c = spark.createDataFrame([(0, 0, 0.0), (5, 1, 0.2), (5, 0, 0.1)], "n long, a long, o double").select(compaction.recommendations(F.col("n"), F.col("a"), F.col("o")).alias("r")).collect()
    assert [r["r"] for r in c] == [[compaction.NO_ROWS], [compaction.DAMAGED, compaction.MANY_PLAIN], [compaction.SOUND]]


def test_guardrails(spark):
    runs = spark.createDataFrame([(False, 0, 0.3, 5, 12, 0), (True, 2, 0.01, 0, 9, 2)], "dryRunOnly boolean, anomalies long, opportunityRate double, dryRunCompacted long, hour int, ingestionErrors long")
    good, bad = scheduler.apply_decision(runs, scheduler.Guardrails(window_start=10, window_end=13, max_apply_rows=100)).collect()
    assert good["allowApply"] and good["applyLimit"] == 100 and good["reasons"] == []
    assert bad["reasons"] == ["Manual dry-run only mode requested.", "Anomaly guardrail blocked apply (2 > 0).", "Compaction opportunity below threshold (0.0100 < 0.0500).", "Dry-run compacted rows below threshold (0 < 1).", "Current time is outside apply window [10:00-13:00)."]
    none = scheduler.apply_decision(runs, scheduler.Guardrails(apply_enabled=False, max_apply_rows=0)).first()
    assert none["reasons"] == ["Apply mode is disabled by configuration.", "Apply limit resolved to 0 rows."]
    assert [len(r["reasons"]) for r in scheduler.session_decision(runs, scheduler.Guardrails()).collect()] == [0, 4]


def test_policies(spark):
    p, wrong = policy.parse(json.dumps({"includeGlobs": ["src/**/*.ts"], "excludeGlobs": ["*.spec.ts"], "languages": ["typescript"], "maxFileBytes": 10, "redaction": {"customPatterns": ["SENSITIVE_\\w+"]}}))
    assert not wrong and p.max_file_bytes == 10
    paths = spark.createDataFrame([("src/a/index.ts",), ("src\\a\\index.spec.ts",), ("lib/x.ts",)], "p string")
    assert [r["ok"] for r in paths.select(policy.path_matches(F.col("p"), p.include, p.exclude).alias("ok")).collect()] == [True, False, False]
    said = spark.createDataFrame([("mail a.b@c.org key sk-abcdefghij0123456789xyz SENSITIVE_THING",)], "t string").select(text.redact(F.col("t"), custom=tuple(p.custom)).alias("t")).first()["t"]
    assert said == "mail [REDACTED_PII] key [REDACTED_SECRET] [REDACTED_CUSTOM]"
    for raw in ({"maxFileBytes": -1}, {"languages": "ts"}, {"redaction": {"customPatterns": ["("]}}, []):
        assert policy.parse(json.dumps(raw))[0] is None
    assert policy.parse("{")[0] is None and policy.extensions(["C++", ".vue", "ts", "nolanguage"])[1] == ["nolanguage"]


def atoms(spark):
    rows = [("a", 1, "memory", "one | two", "body  of\none", 0.5, 0.25, 1.0, "src/a.ts", ["x", "y"]), ("b", 2, "memory", "long " * 20, "b", 0.1, 0.2, 0.3, None, [])]
    return spark.createDataFrame(rows, "id string, place int, kind string, title string, body string, priority double, recency double, relevance double, sourceRef string, tags array<string>")


def test_rendering(spark):
    a = atoms(spark)
    full = context.render_context(a, "why", "full", True).first()["rendered"].split("\n")
    assert full[:5] == ["[CONTEXT]", "intent: why", "atoms: 2", "", "| # | kind | title | priority | relevance | recency |"]
    assert full[6] == "| 1 | memory | one \\| two | 0.50 | 1.00 | 0.25 |" and full[7].count("…") == 1 and full[8] == ""
    assert full[9:16] == ["• one | two", "kind: memory", "priority: 0.50  recency: 0.25  relevance: 1.00", "source: src/a.ts", "tags: x, y", "body  of", "one"]
    compact = context.render_context(a, "why").first()["rendered"].split("\n")
    assert compact[4:8] == ["• one | two", "  body of one", "  tags: x, y", "  source: src/a.ts"]
    assert context.render_context(a.limit(0), "why", table=True).first()["rendered"] == "[CONTEXT]\nintent: why\natoms: 0\n"
    m = a.selectExpr("place", "kind", "title", "body AS summary", "tags", "priority AS score")
    said = context.format_context(m, "why", constraints=("short",), scores=True).first()["formatted"]
    assert said.startswith("[CONTEXT]\n\nintent: why\nscope: current_file + project + memory\n\nmemories:\n  - [memory] one | two\n    summary: body  of\none\n    score: 0.5000\n    tags: x, y\n") and said.endswith("\n\nconstraints:\n  - short")
    assert context.format_context(m.limit(0), "why").first()["formatted"].endswith("memories:\n  - none")
    e = spark.range(1).select(context.prompt_envelope(F.lit("ctx"), " ask ", "be brief", {"tokens": F.lit(3), "atoms": F.lit(2), "dropped": F.lit(1)}).alias("e")).first()["e"]
    assert e == "[SYSTEM]\nbe brief\n\nctx\n\n\n[CONTEXT_STATS]\ntokens=3 atoms=2 dropped=1\n\n\n[USER_QUERY]\n\nask"


def test_bundle(spark):
    m = spark.createDataFrame([(f"m{i}", "semantic", f"title {i}", "s", "content " * 50, ["t"], None, 0.5, 0.9, i / 30, i) for i in range(30)], "id string, kind string, title string, summary string, content string, tags array<string>, sourceRef string, importance double, recency double, similarity double, place int")
    health = spark.createDataFrame([("healthy", "fine")], "status string, recommendation string")
    b = context.bundle(m, "what", health, "copilot").first()
    assert len(b["concepts"]) == 10 and b["graph"][0] == "semantic -> title 0" and b["healthStatus"] == "healthy"
    assert 0 < b["atoms"] <= 20 and b["tokens"] <= 2000 and f"atoms: {b['atoms']}" in b["rendered"] and b["envelope"].endswith("[USER_QUERY]\n\nwhat") and f"dropped={30 - b['atoms']}" in b["envelope"]


@pytest.mark.parametrize(("value", "places", "want"), [(1.0, 2, "1.00"), (0.125, 2, "0.13"), (-3.5, 0, "-4")])
def test_to_fixed(spark, value, places, want):
    assert spark.range(1).select(text.to_fixed(F.lit(value), places).alias("x")).first()["x"] == want


def test_metrics_as_text(spark):
    rows = spark.createDataFrame([("timer", "applied", 3, 0.5), ("manual", 'a"b', 1, 2.0)], "trigger string, outcome string, runs long, seconds double")
    assert sinks.prometheus("runs_total", "counter", "Runs.", rows, ["trigger", "outcome"], "runs") == '# HELP runs_total Runs.\n# TYPE runs_total counter\nruns_total{trigger="manual",outcome="a\\"b"} 1\nruns_total{trigger="timer",outcome="applied"} 3\n'
    assert sinks.prometheus("s", "gauge", "S.", rows.limit(1), [], "seconds").endswith("\ns 0.5\n")


def test_scheduler_loop(spark):
    loop = scheduler.Loop(1000, longest=5000)
    waits = []
    for outcome in ("error", "error", "error", "skipped", "error", "applied"):
        waits.append(loop.delay())
        assert loop.begin() and not loop.begin()
        loop.end(outcome)
    assert [*waits, loop.delay()] == [1000, 1000, 2000, 4000, 4000, 5000, 1000] and loop.first(5) == 1005 and scheduler.Loop(1000, on_start=True).first() == 0
    runs = spark.createDataFrame([(1, "s", "applied", 1), (2, "s", "error", 2), (3, "s", "skipped", 3), (4, "s", "error", 4)], "runId long, schedulerScope string, outcome string, startedAt long")
    assert scheduler.Loop.resumed(runs, "s", 1000).delay() == 2000 and scheduler.Loop.resumed(runs, "none", 1000).delay() == 1000


def test_agents(spark):
    t = spark.createDataFrame([(1, " Fix the error in state handling. Fix it\n\nfix IT\nfix it "), (2, "  "), (3, None)], "id int, text string")
    got = {r["id"]: r for r in agents.loop(t).collect()}
    assert got[1]["planner"]["intent"] == "debugging" and got[1]["writer"]["tags"] == ["bugfix"] and got[1]["compressor"]["compressed"] == "Fix the error in state handling. Fix it\nfix IT"
    assert len(got[1]["refactor"]["recommendations"]) == 2 and got[1]["critic"]["novelty"] == 1.0
    assert all(got[k][a] is None for k in (2, 3) for a in agents.AGENTS)
    with pytest.raises(ValueError, match="nobody"):
        agents.run_agent(t, "nobody")
    c = spark.createDataFrame([("a", {"title": " ", "summary": "sum", "content": None, "tags": ["t", "t"], "confidence": 0.9}, [{"title": "n1", "summary": "near words"}, {"title": "n2", "summary": ""}])], "id string, candidate struct<title: string, summary: string, content: string, tags: array<string>, confidence: double>, neighbors array<struct<title: string, summary: string>>")
    r = agents.consolidate_candidates(c).first()
    assert (r["title"], r["summary"], r["content"], r["tags"]) == ("Generated Memory", "sum near words n2", "sum\n\nNeighbor overlap summary:\nnear words n2", ["t", "near", "words", "consolidated"]) and r["confidence"] == pytest.approx(0.94)
    model = ngram.ephemeral("fix it now and then")
    w = agents.write_candidates(t, model).orderBy("id").collect()
    assert len(w) == 3 and w[0]["confidence"] == 0.72 and "mini-llm" in w[0]["tags"] and "Model-guided continuation:\n" in w[0]["content"] and w[1]["content"].startswith("generated memory candidate")


def test_code_summary(spark):
    src = "import x from 'y'\nfunction sum(a) { for (;;) { if (a) { b() } } }\n"
    made = spark.createDataFrame([(src,)], "s string").select(ingest.code_summary(F.lit("a.ts"), ingest.structure(F.col("s"))).alias("x")).first()["x"]
    assert made == "a.ts: functions=1, classes=0, loops=1, branches=1, calls=2, imports=1, depth=3, cyclomatic_proxy=3; top_identifiers=[sum], dependencies=[x from 'y']"


def test_corpus_of_a_project_ends_at_its_budget(spark):
    rng = random.Random(4)
    rows = [(f"p{i % 3}", f"f{i:03}", "w" * rng.randint(1, 90)) for i in range(200)] + [("p0", "f000", "v" * 50), (None, "x", "n" * 40)]
    df = spark.createDataFrame(rows, "projectId string, path string, source string").repartition(5)
    got = sorted((r["projectId"] or "", r["path"], r["snippet"]) for r in corpus.project_corpus(df, 1000, 32).collect())
    want = []
    for p in ("p0", "p1", "p2", None):
        paths = sorted({r[1] for r in rows if r[0] == p})
        used = 0
        for path in paths:
            mine = [r[2] for r in rows if r[0] == p and r[1] == path and len(r[2]) >= 32]
            want += [(p or "", path, s[: 1000 - used]) for s in mine if used < 1000]
            used += sum(map(len, mine))
    assert got == sorted(want) and len(got) > 40


def test_ingestion_skips_forces_and_removes(spark):
    p = policy.Policy(include=["src/*"], exclude=["*.spec.ts"], languages=["typescript"], max_file_bytes=3000)
    talk = json.dumps([{"role": "user", "content": "ask a.b@c.org"}, {"role": "assistant", "content": "told"}, {"role": "user", "content": "more"}])

    def files(body):
        rows = [("p", "src/a.ts", len(body), body), ("p", "src/b.spec.ts", 5, "let b"), ("p", "src/big.ts", 9999, "x"), ("p", "src/c.py", 3, "c=1")]
        return spark.createDataFrame(rows, "projectId string, path string, bytes long, source string")

    def chats(value):
        return spark.createDataFrame([("p", "s.json", value), ("p", "bad.json", "{")], "projectId string, path string, value string")

    def run(body, value, before=None, force=False):
        prints, rows = before or (spark.createDataFrame([], "projectId string, sourceType string, sourceRef string, contentHash string, ingestVersion string, firstIngestedAt long, lastIngestedAt long"), spark.createDataFrame([], "id string, projectId string, kind string, sourceType string, title string, summary string, content string, tags array<string>, importance double, confidence double, sourceRef string, createdAt long, lastAccessedAt long"))
        out = ingest.run_ingestion(files(body), prints, rows, p, 100, force, chats(value))
        kept = [spark.createDataFrame(x.collect(), x.schema) for x in (out["fingerprints"], out["memories"])]
        return out["report"].first().asDict(), kept

    body = "function sum(a) { return a }\n" * 60
    first, kept = run(body, talk)
    assert first["filesScanned"] == 2 and first["codeChunks"] == 2 and first["chatTurns"] == 2 and first["memoriesStored"] == 4 and first["chatFilesScanned"] == 2 and first["errors"] == ["chat:bad.json"] and first["staleMemoriesRemoved"] == 0
    rows = kept[1].collect()
    assert len(rows) == 4 and {r["sourceType"] for r in rows} == {"code", "chat"} and not any("a.b@c.org" in r["content"] for r in rows) and {r["projectId"] for r in rows} == {"p"}
    again, kept2 = run(body, talk, kept)
    assert (again["codeFilesSkippedUnchanged"], again["chatFilesSkippedUnchanged"], again["memoriesStored"], again["staleMemoriesRemoved"]) == (1, 1, 0, 0) and kept2[1].count() == 4
    forced, kept3 = run(body, talk, kept2, True)
    assert (forced["codeFilesSkippedUnchanged"], forced["memoriesStored"], forced["staleMemoriesRemoved"]) == (0, 4, 0) and kept3[1].count() == 4
    changed, kept4 = run(body[: 29 * 40], json.dumps([{"role": "user", "content": "new"}]), kept3)
    assert changed["staleCodeMemoriesRemoved"] >= 1 and changed["staleChatMemoriesRemoved"] == 2 and kept4[1].count() == changed["memoriesStored"] == 2
