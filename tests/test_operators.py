import json
import random
import re

import pytest
from pyspark.sql import functions as F

from strata.functions import codec
from strata.operators import compaction, consolidation, context, evolution, graph, ingest, ngram, records, retrieval, scheduler, store, temporal
from strata.plans import catalog
from strata.plans.engine import MemoryEngine
from strata.sources import chat
from strata.sources import tables as T


def writes(spark):
    rows = [
        ("p", "main", "a", 1, "upsert", 10, "one", "x", "alpha", "s", 0.5, 0.7), ("p", "main", "b", 2, "upsert", 11, "bee", "x", "beta", "s", 0.5, 0.7),
        ("p", "release", "a", 3, "upsert", 20, "two", "x", "stricter checks", "s", 0.6, 0.7), ("p", "feature", "c", 4, "upsert", 25, "new", "x", "only here", "s", 0.6, 0.7),
        ("p", "release", "a", 5, "delete", 30, None, None, None, None, None, None), ("p", "feature", "a", 6, "upsert", 40, "again", "x", "made again", "s", 0.6, 0.7),
    ]
    return spark.createDataFrame(rows, "projectId string, branch string, logicalId string, event_id long, operation string, validFrom long, title string, summary string, content string, sourceRef string, importance double, confidence double")


BRANCHES = [("p", "release", "main"), ("p", "feature", "release"), ("p", "loop", "loop2"), ("p", "loop2", "loop"), ("p", "orphan", None)]


def branches(spark):
    return spark.createDataFrame(BRANCHES, "projectId string, branch string, parentBranch string")


@pytest.mark.parametrize(("branch", "want"), [("main", ["main"]), ("feature", ["feature", "release", "main"]), ("loop", ["loop", "loop2", "main"]), ("orphan", ["orphan", "main"]), ("unknown", ["unknown", "main"])])
def test_lineage(spark, branch, want):
    assert [r["branch"] for r in temporal.lineage(spark, branches(spark), "p", branch).orderBy("depth").collect()] == want


def test_as_of_sees_overrides_until_deleted(spark):
    snap = temporal.close_intervals(writes(spark))
    line = temporal.lineage(spark, branches(spark), "p", "release")

    def at(t):
        return {r["logicalId"]: (r["title"], r["operation"]) for r in temporal.state_as_of(snap, line, t).collect()}

    assert at(15) == {"a": ("one", "upsert"), "b": ("bee", "upsert")}
    assert at(20)["a"] == ("two", "upsert") and at(29)["a"] == ("two", "upsert")
    assert at(30)["a"] == (None, "delete") and at(5) == {}


def test_diff_is_empty_for_one_instant_and_mirrored(spark):
    snap = temporal.close_intervals(writes(spark))
    line = temporal.lineage(spark, branches(spark), "p", "feature")
    a, b = temporal.state_as_of(snap, line, 15), temporal.state_as_of(snap, line, 50)
    assert temporal.diff(a, a).isEmpty()
    assert {(r["logicalId"], r["change"]) for r in temporal.diff(a, b).collect()} == {("a", "modified"), ("c", "added")}
    assert {(r["logicalId"], r["change"]) for r in temporal.diff(b, a).collect()} == {("a", "modified"), ("c", "removed")}


def test_child_may_make_again_what_its_parent_deleted(spark):
    cur = writes(spark).where("event_id IN (1, 2, 4, 5, 6)")
    rows, gone = cur.where("operation = 'upsert'"), cur.where("operation = 'delete'").select("branch", "logicalId")
    line = temporal.lineage(spark, branches(spark), "p", "feature")
    ids = lambda aware: sorted(r["logicalId"] for r in temporal.branch_view(rows, gone, line, aware).collect())
    assert ids(True) == ["a", "b", "c"] and ids(False) == ["b", "c"]
    release = temporal.lineage(spark, branches(spark), "p", "release")
    assert [r["logicalId"] for r in temporal.branch_view(rows, gone, release).collect()] == ["b"]


def test_merge_twice_changes_nothing_more(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    delta = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    once = temporal.merge_rows(base, delta, ["k"])
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 3), ("c", 4)] == sorted(map(tuple, temporal.merge_rows(once, delta, ["k"]).collect()))
    kept, count = temporal.delete_rows(once, delta, ["k"])
    assert [r["k"] for r in kept.collect()] == ["a"] and count.first()["deleted"] == 2


def memories(spark, contents):
    rows = [(f"m{i}", "p", "semantic", f"title {i}", "summary", c, ["t"], 0.5, 0.75, i, i) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "id string, projectId string, kind string, title string, summary string, content string, tags array<string>, importance double, confidence double, createdAt long, lastAccessedAt long")


def test_compaction_life(spark):
    body = "repeated words of a long memory " * 80
    m = memories(spark, [codec.compact(body), body])
    s = compaction.stats(m).first()
    assert (s["totalRows"], s["compactedRows"], s["plainRows"]) == (2, 1, 1) and s["savedChars"] > 0
    summary, new = compaction.backfill(m)
    b = summary.first()
    assert (b["scanned"], b["eligible"], b["compacted"], b["skipped"]) == (2, 1, 1, 1)
    after = compaction.stats(temporal.merge_rows(m, new, ["id"])).first()
    assert (after["totalRows"], after["compactedRows"], after["plainRows"]) == (2, 2, 0)
    assert MemoryEngine(spark, m, now=10).search("LONG memory").count() == 2
    assert compaction.opportunities(m)[0].first()["candidates"] == 1


def test_audit_reports_damage(spark):
    good = codec.compact("some text " * 100)
    m = memories(spark, ["plain", good, good[:-30]])
    summary, issues = compaction.audit(m)
    assert summary.first()["totalRows"] == 3
    assert all(i["issue"] in ("decode_error", "invalid_checksum") for i in issues.collect())


def test_slo_windows_and_failures(spark):
    minute = 60_000
    now = 10_000 * minute
    runs = spark.createDataFrame([(1, "s", "applied", now - 170 * minute), (2, "s", "dry-run-only", now - 50 * minute), (3, "s", "error", now - 10 * minute), (4, "t", "error", now - 9 * minute), (5, "t", "skipped", now - 8 * minute), (6, "t", "error", now - 7 * minute)], "runId long, schedulerScope string, outcome string, startedAt long")
    got = {r["minutes"]: r for r in scheduler.slo_windows(runs.where("schedulerScope = 's'"), now, (5, 60, 180)).collect()}
    assert (got[60]["total"], got[60]["applied"], got[60]["dryRunOnly"], got[60]["error"]) == (2, 0, 1, 1)
    assert (got[180]["total"], got[180]["applied"], got[180]["dryRunOnly"], got[180]["error"]) == (3, 1, 1, 1)
    assert got[5]["total"] == 0 and got[5]["successRate"] == 1.0
    assert {r["schedulerScope"]: r["consecutiveFailures"] for r in scheduler.consecutive_failures(runs).collect()} == {"s": 1, "t": 2}


def test_turns_pair_and_the_rest_stays(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "system", "between"), (1, 3, "assistant", "a1"), (1, 4, "user", "q2"), (1, 5, "user", " "), (1, 6, "user", "q3"), (2, 0, "assistant", "first"), (2, 1, "user", "q"), (2, 2, "assistant", "a"), (2, 3, "assistant", "again"), (3, 0, None, "x"), (3, 1, "user", None)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, ingest.pair_turns(t).collect())) == [(1, 1, "q1", "a1"), (1, 4, "q2", ""), (1, 6, "q3", ""), (2, 0, "", "first"), (2, 1, "q", "a"), (2, 3, "", "again")]


SESSIONS = {
    "list.json": ([{"role": "user", "content": "q1", "files": ["a.ts"]}, {"role": "assistant", "content": "a1", "references": [{"uri": "b.ts"}]}, {"role": "tool", "content": "x"}, {"role": "user", "text": "q2"}], [("q1", "a1", ["a.ts", "b.ts"]), ("q2", "", [])]),
    "requests.json": ({"requests": [{"message": {"text": " ask "}, "response": [{"kind": "thinking", "value": "hm"}, {"value": "one"}, "two", {"value": "one"}], "timestamp": "1700"}, {"prompt": "only"}, {"nothing": 1}]}, [("ask", "one\ntwo", []), ("only", "", [])]),
    "data.json": ({"events": [{"type": "user.message", "data": {"content": "hi"}}, {"type": "assistant.message", "data": {"content": "there"}}, {"type": "assistant.message", "data": {"content": "alone"}}]}, [("hi", "there", []), ("", "alone", [])]),
    "parts.json": ({"prompt": "", "message": {"parts": [{"text": "a"}, "b", {"text": "a"}]}, "answer": {"output": "c"}}, [("a\nb", "c", [])]),
    "broken.json": ("{", []),
    "number.json": ("7", []),
}


def test_chat_sessions_of_every_form(spark, tmp_path):
    log = [{"v": {"requests": [{"message": "first"}, {"message": {"text": "second"}}]}}, "no json", {"k": ["requests", 1, "response"], "v": [{"value": "late"}]}, {"k": ["requests", 0, "timestamp"], "v": 5}, {"k": ["other", 0, "response"], "v": "no"}]
    rows = [(n, v if isinstance(v, str) else json.dumps(v)) for n, (v, _) in SESSIONS.items()] + [("log.jsonl", "\n".join(x if isinstance(x, str) else json.dumps(x) for x in log)), (None, None)]
    got = chat.chat_turns(spark.createDataFrame(rows, "path string, value string")).orderBy("path", "turn").collect()
    want = {n: w for n, (_, w) in SESSIONS.items()} | {"log.jsonl": [("first", "", []), ("second", "late", [])]}
    for n, w in want.items():
        assert [(r["prompt"], r["response"], r["files"]) for r in got if r["path"] == n] == w, n
    assert [r["timestamp"] for r in got if r["path"] in ("log.jsonl", "requests.json")] == [5, None, 1700, None]
    m = ingest.chat_memories(chat.chat_turns(spark.createDataFrame(rows[:1], "path string, value string")).withColumnRenamed("path", "ref"), "p", "ref").orderBy("summary").first()
    assert m["tags"] == ["copilot", "chat", "chat-file:list.json", "file:a.ts", "file:b.ts"] and m["content"] == "q1\n\n---\n\na1"


def test_transcripts_of_a_workspace(spark, tmp_path, monkeypatch):
    for k in ("HOME", "USERPROFILE", "APPDATA"):
        monkeypatch.delenv(k, raising=False)
    project, root = tmp_path / "work" / "app", tmp_path / "storage"
    project.mkdir(parents=True)
    for name, folder in (("one", project.as_uri()), ("two", (project / "sub").as_uri()), ("three", "file:///elsewhere")):
        (root / name / "chatSessions").mkdir(parents=True)
        (root / name / "workspace.json").write_text(json.dumps({"folder": folder}))
        (root / name / "chatSessions" / "s.json").write_text('[{"role": "user", "content": "hello"}]')
        (root / name / "chatSessions" / "note.txt").write_text("no")
    files = tmp_path / "app.code-workspace"
    files.write_text(json.dumps({"folders": [{"path": "work"}]}))
    (root / "four" / "GitHub.copilot-chat" / "transcripts").mkdir(parents=True)
    (root / "four" / "workspace.json").write_text(json.dumps({"workspace": str(files)}))
    (root / "four" / "GitHub.copilot-chat" / "transcripts" / "t.jsonl").write_text('{"role": "user", "content": "x"}\nbad\n')
    found = chat.discover(str(project), [str(root)])
    assert [f.split("/")[-3] for f in found] == ["GitHub.copilot-chat", "one", "two"] and len(chat.discover(str(project), [str(root)], most=2)) == 2
    assert len(chat.discover(str(tmp_path / "other"), [str(root)])) == 4  # none belongs to it, so all
    turns = chat.chat_turns(chat.chat_files(spark, found))
    assert sorted(r["prompt"] for r in turns.collect()) == ["hello", "hello", "x"] and chat.chat_files(spark, []).count() == 0


def test_changed_and_stale_sources(spark):
    new = ingest.fingerprints(spark.createDataFrame([("p", "a", "x"), ("p", "b", "y"), ("p", "c", "z")], "projectId string, sourceRef string, source string"))
    old = ingest.fingerprints(spark.createDataFrame([("p", "a", "x"), ("p", "b", "old")], "projectId string, sourceRef string, source string"))
    assert {r["sourceRef"]: r["state"] for r in ingest.changed_sources(new, old).collect()} == {"a": "unchanged", "b": "changed", "c": "new"}
    assert ingest.stale(old, new.where("sourceRef <> 'b'"), ["projectId", "sourceRef"]).first()["sourceRef"] == "b"


def test_code_facts(spark):
    src = "import x from 'y'\nfunction sum(a) { for (;;) { if (a) {} } }\nconst f = (a) => a\nclass K {}\n"
    f = ingest.code_facts(F.col("s"))
    r = spark.createDataFrame([(src,)], "s string").select(*(c.alias(k) for k, c in f.items())).first()
    assert (r["functions"], r["classes"], r["loops"], r["branches"]) == (["sum", "f"], ["K"], 1, 1)
    assert r["imports"] == ["import x from 'y'"] and r["complexityHint"].startswith("likely O(n) with")
    chunks = ingest.parse_code(spark.createDataFrame([("a.ts", src)], "path string, source string"), 40).orderBy("i").collect()
    assert [c["title"] for c in chunks][:3] == ["sum [1]", "f [2]", "K [3]"] and "".join(c["content"] for c in chunks) == src


def test_text_files(spark, tmp_path):
    (tmp_path / "a.ts").write_text("let a")
    (tmp_path / "big.ts").write_text("x" * 100)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "b.ts").write_text("let b")
    (tmp_path / "c.bin").write_text("no")
    got = T.text_files(spark, str(tmp_path), T.CODE_EXTENSIONS, most_bytes=50)
    assert [r["source"] for r in got.collect()] == ["let a"]
    (tmp_path / "t.jsonl").write_text('{"role": "user"}\nnot json\n')
    assert T.json_lines(spark, str(tmp_path / "t.jsonl"), "role string").count() == 1


def test_traversal_ends_in_cycles_and_caps(spark):
    e = spark.createDataFrame([("a", "b", "t", 0.9), ("b", "a", "t", 0.8), ("b", "c", "t", 0.7), ("a", "d", "t", 0.1)], "fromNode string, toNode string, type string, weight double")
    got = [(r["fromNode"], r["toNode"]) for r in graph.traverse(e, "a", 5, 64, 0.2).orderBy("place").collect()]
    assert got == [("a", "b"), ("b", "a"), ("b", "c")]
    assert graph.traverse(e, "a", 5, 2).count() == 2
    assert {r["node"] for r in graph.reachable(e, "a", 5).collect()} == {"a", "b", "c", "d"}


def test_greedy_packing_skips_and_goes_on(spark):
    a = spark.createDataFrame([("g", 3.0, "x", "a" * 40), ("g", 2.0, "y", "b" * 80), ("g", 1.0, "z", "c" * 20)], "g string, s double, k string, body string")
    got = {r["k"]: r["accepted"] for r in context.pack_greedy(a, "g", "s", "k", "body", 15).collect()}
    assert got == {"x": True, "y": False, "z": True}
    prefix = context.pack_prefix(a.withColumn("o", -F.col("s")), "g", "o", "body", 15)
    assert [r["k"] for r in prefix.collect()] == ["x"]


def test_intents(spark):
    q = spark.createDataFrame([("an error and a bug",), ("hello",), ("",)], "q string")
    got = context.infer_intent(q, "q").collect()
    assert [(r["category"], round(r["confidence"], 2), r["topK"]) for r in got] == [("debugging", 0.62, 16), ("general", 0.45, 12), ("general", 0.0, 12)]


def test_choice_prefers_accepted_then_action(spark):
    c = spark.createDataFrame([("k", "a", "merge", False, 0.9, 0.5), ("k", "b", "store", True, 0.6, 0.5), ("k", "c", "merge", True, 0.5, 0.1)], "k string, id string, action string, accepted boolean, score double, novelty double")
    assert evolution.choose(c, "k").first()["id"] == "c"


def test_model_and_novelty(spark):
    d = spark.createDataFrame([(1, "a b a b a b"), (2, "x"), (3, "b a c")], "doc_id long, text string")
    v = ngram.vocabulary(d, 10)
    t = ngram.transitions(d, v, 2)
    n = {r["doc_id"]: r["novelty"] for r in ngram.novelty(d, ngram.hydrated(v, t)).collect()}
    assert n[2] == 0.5 and 0 <= n[1] < n[3] <= 1
    assert v.count() == 5 and t.where("q < 1 OR q > 127").isEmpty()


def shingles(x):
    w = [t for t in re.split("[^a-z0-9_]+", x.lower()) if len(t) > 1]
    return set(w) | {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


def alike(x, y):
    return len(x & y) / len(x | y) if x and y else 0


def test_fuzzy_classes_equal_brute_force(spark):
    texts = ["alpha beta gamma delta", "alpha beta gamma delta epsilon", "alpha beta gamma", "other words here now", "alpha beta gamma delta", "ALPHA beta, gamma delta", "", "x"]
    m = memories(spark, ["x"] * len(texts)).withColumn("title", F.element_at(F.array(*map(F.lit, texts)), (F.col("createdAt") + 1).cast("int"))).withColumn("summary", F.lit(""))
    sets = [shingles(x) for x in texts]
    first = {i: f"m{next(j for j in range(len(texts)) if sets[j] == sets[i])}" for i in range(len(texts)) if sets[i]}
    classes, pairs = retrieval.fuzzy_classes(m)
    assert {r["id"]: r["class"] for r in classes.collect()} == {f"m{i}": c for i, c in first.items()}
    want = {(first[i], first[j]) for i in first for j in first if first[i] < first[j] and alike(sets[i], sets[j]) >= 0.72}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want == {("m0", "m1")}


def consolidated(rows):
    """The pass, row by row: id, project, kind, title, summary, content, tags, importance, confidence, created, accessed, source."""
    out = []
    for r in sorted(rows, key=lambda r: (r[9], r[0])):
        title, words = " ".join(r[3].lower().split()), shingles(f"{r[3]}\n{r[4]}")
        for k in out:
            if (k[1], k[2]) == (r[1], r[2]) and (" ".join(k[3].lower().split()) == title or alike(shingles(f"{k[3]}\n{k[4]}"), words) >= 0.72):
                if len(r[4]) > len(k[4]):
                    k[3:5] = r[3:5]
                k[5] = r[5] if len(r[5]) > len(k[5]) else k[5]
                k[6] = sorted({*k[6], *r[6]})
                k[7], k[8], k[10], k[11] = max(k[7], r[7]), max(k[8], r[8]), max(k[10], r[10]), k[11] or r[11]
                k[12] += 1
                break
        else:
            out.append([*r[:6], sorted(set(r[6])), *r[7:], 1])
    return sorted(map(tuple, out))


FULL = "id string, projectId string, kind string, title string, summary string, content string, tags array<string>, importance double, confidence double, createdAt long, lastAccessedAt long, sourceRef string"


def full_rows(titles, rng=None):
    rng = rng or random.Random(0)
    return [(f"m{i:04}", "p" if i % 7 else "q", "semantic", t, s, "c" * (i % 5), [f"t{i % 3}"], i % 10 / 10, i % 7 / 10, rng.randrange(50), i, None if i % 2 else f"s{i}") for i, (t, s) in enumerate(titles)]


def test_consolidation_replays_the_merges(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    cases = [
        # K, L near K, and two rows with the title of L
        [("one", words), ("two", words + " more"), ("two", "nothing of that"), ("two", "and other things")],
        # a merge brings a longer summary, and later rows are compared with that
        [("one", words), ("three", words + " lambda mu"), ("four", " ".join(words.split()[2:]) + " lambda mu nu xi"), ("one", "short")],
    ]
    rng = random.Random(5)
    pool = words.split()
    cases.append([(rng.choice(pool[:6]), " ".join(rng.sample(pool, rng.randint(4, 9)))) for _ in range(150)])
    chain = [f"w{i}" for i in range(240)]
    cases.append([(f"t{i}", " ".join(chain[i : i + 12])) for i in range(200)])
    cases.append([("the same", words)] * 60 + [("the same", words + " x")] * 40 + [("", "")] * 3)
    for case in cases:
        rows = full_rows(case, rng)
        got = consolidation.consolidate_fuzzy(spark.createDataFrame(rows, FULL).repartition(3))
        order = [c.split()[0] for c in FULL.split(", ")] + ["n"]
        assert sorted(map(lambda r: (*r[:6], tuple(r[6]), *r[7:]), map(tuple, got.select(order).collect()))) == [(*r[:6], tuple(r[6]), *r[7:]) for r in consolidated(rows)]


def test_only_what_may_be_similar_is_verified_and_linked(spark, monkeypatch):
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(pool, k=rng.randint(3, 90))) for _ in range(120)]
    texts += [" ".join([*t.split(), "more"]) for t in texts[:30]]
    rows = [(f"m{i:03}", None if i == 5 else "pq"[i % 2], "semantic", f"title {i}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, projectId string, kind string, title string, summary string").withColumn("createdAt", F.lit(0))
    sets = {r[0]: (r[1], shingles(f"{r[3]} {r[4]}")) for r in rows if r[1]}
    classes, pairs = retrieval.fuzzy_classes(df)
    want = {(a, b) for a, (g, x) in sets.items() for b, (h, y) in sets.items() if a < b and g == h and alike(x, y) >= 0.72}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and len(want) > 5
    assert {r["id"] for r in classes.collect()} == set(sets)
    # bits never differ in more places than the sets
    marked = spark.range(200).select(F.transform(F.sequence(F.lit(0), F.col("id") % 150), lambda x: F.xxhash64(x, F.col("id") % 3)).alias("x")).select("x", *retrieval.marks(F.col("x"))).collect()
    bits = lambda r: (r["low"] & (1 << 64) - 1) | (r["high"] & (1 << 64) - 1) << 64
    assert all((bits(a) ^ bits(b)).bit_count() <= len(set(a["x"]) ^ set(b["x"])) for a in marked[::7] for b in marked)
    # a title that one class has links nothing
    met = {}
    monkeypatch.setattr(consolidation, "groups", lambda links, original=consolidation.groups: met.setdefault("n", links.count()) and original(links) or original(links))
    case = [(f"t{i}", f"words of {i} alone here") for i in range(20)] + [("t3", "nothing of that"), ("t4", "")]
    assert consolidation.consolidate_fuzzy(spark.createDataFrame([r for r in full_rows(case)], FULL).withColumn("projectId", F.lit("p"))).count() == 20
    assert met["n"] == 4


def test_groups_of_a_long_chain(spark):
    links = [(f"n{i:03}", f"n{i + 1:03}") for i in range(70)] + [("x", "y")]
    got = {r["id"]: r["g"] for r in consolidation.groups(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {f"n{i:03}": "n000" for i in range(71)} | {"x": "x", "y": "x"}
    with pytest.raises(RuntimeError):
        consolidation.groups(spark.createDataFrame(links, "a string, b string"), most_rounds=1)


@pytest.mark.parametrize("n", [0, 1, 2, 50])
def test_every_chunk_has_a_negative_pair(spark, n):
    chunks = spark.createDataFrame([(str(i), f"text {i}", f"summary {i}") for i in range(n)], "id string, text string, summary string")
    got = sorted(map(tuple, ingest.training_pairs(chunks).collect()))
    negative = [(a, b) for a, b, label in got if label < 0.5]
    assert len(got) - len(negative) == n and len(negative) == (n if n > 1 else 0)
    assert len({a for a, _ in negative}) == len({b for _, b in negative}) == len(negative)
    assert all(a.split()[1] != b.split()[1] for a, b in negative)
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert sorted(map(tuple, ingest.training_pairs(chunks).collect())) == got
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)


def scores_of(words, followers, names):
    """Tag scores once more, for texts whose words are all tags."""
    out = {}

    def add(t, s):
        if t not in ngram.DOMAIN_STOP_WORDS:
            out[t] = out.get(t, 0) + s

    often = sorted(dict.fromkeys(words), key=lambda t: -words.count(t))[:24]
    for i, t in enumerate(often):
        add(t, 1.4 - 0.08 * i)
    terms = [t for t in dict.fromkeys(words) if len(t) >= 4 and t not in ngram.DOMAIN_STOP_WORDS][:12]
    for i, t in enumerate(terms):
        add(t, 2.6 - 0.1 * i)
    for t in dict.fromkeys(words):
        after = followers.get(t, [])[:10]
        for name, q in after:
            boost = 1.35 if name in terms else 1.15 if any(len(x) > 6 and name.startswith(x[:5]) for x in terms) else 1
            add(name, 0.8 + q / max(x for _, x in after) * boost)
    return [t for t, _ in sorted(out.items(), key=lambda x: (-round(x[1], 4), len(x[0]), x[0]))[:6]]


def test_tags_come_from_words_terms_and_followers(spark):
    made = [(1, "database index database query planner the query index planning database"), (2, "planner index the with cache"), (3, ""), (4, None), (5, "a b c 12 x9")]
    d = spark.createDataFrame(made, "doc_id long, text string")
    v = ngram.vocabulary(d)
    m = ngram.hydrated(v, ngram.transitions(d, v))
    followers = {m.names[a]: [(m.names[b], q) for b, q in after] for a, after in m.followers.items()}
    got = {}
    for r in ngram.suggest_tags(d, m, 6).orderBy("doc_id", "place").collect():
        got.setdefault(r["doc_id"], []).append(r["token"])
    assert {i: got.get(i, []) for i in (1, 2, 3, 4)} == {i: scores_of((t or "").split(), followers, m.names) for i, t in made[:4]}
    assert "the" not in got[1] and 5 not in got


def test_models_are_saved_and_checked(spark, tmp_path):
    d = spark.createDataFrame([("a b a b c",), ("b c d",), ("x",)], "snippet string")
    v, t, summary = ngram.train(d, d.limit(1), d.limit(0), size=5, most=2)
    s = summary.first()
    assert (s["snippets"], s["tokenCount"], s["vocabSize"], s["sourceCount"]) == (6, 26, 5, 4) and s["averageBranchingFactor"] > 0
    ngram.save(v, t, str(tmp_path / "m"))
    assert [sorted(map(tuple, x.collect())) for x in ngram.load(spark, str(tmp_path / "m"))] == [sorted(map(tuple, x.collect())) for x in (v, t)]
    spark.createDataFrame([('{"version": "other"}',)], "value string").write.mode("overwrite").text(str(tmp_path / "m" / "version"))
    with pytest.raises(ValueError, match="other"):
        ngram.load(spark, str(tmp_path / "m"))
    bad = t.selectExpr("fromId", "toId", "rank", "IF(rank = 1, 0, q) AS q").unionByName(spark.createDataFrame([(0, 99, 3, 5)], "fromId int, toId int, rank int, q int"))
    assert all(q > 0 and b < 5 for after in ngram.hydrated(v, bad).followers.values() for b, q in after)
    e = ngram.ephemeral("a b a b c")
    assert e.names[:2] == ["<unk>", "a"] and e.novelty("a b") < e.novelty("c a") == 1.0


def test_continuation_query_goes_on_from_the_end(spark, tmp_path):
    long = "beginning " * 10 + "alpha beta"
    spark.createDataFrame([(1, long), (2, "beta gamma delta " * 5)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["continuation"] for r in catalog.QUERIES["generate_continuation"](spark, str(tmp_path)).collect()}
    assert got[1].startswith("gamma delta") and got[2].startswith("beta gamma")


def test_tags_and_continuations_know_rarer_tokens(spark, tmp_path):
    many = " ".join(f"t{i:03}" for i in range(400))
    spark.createDataFrame([(1, many), (2, "t350")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["continuation"] for r in catalog.QUERIES["generate_continuation"](spark, str(tmp_path)).collect()}
    assert got[2].startswith("t351 t352")
    tags = {r["token"] for r in catalog.QUERIES["suggest_tags"](spark, str(tmp_path)).where("doc_id = 2").collect()}
    assert tags == {"t350", "t351"}


class Store:
    """The store, with dicts: rows and tombstones by (branch, logical id), a list of versions."""

    parents = {"feature": "release", "release": "main"}

    def __init__(self):
        self.rows, self.gone, self.log = {}, set(), []

    def line(self, branch):
        out = [branch]
        while out[-1] != "main":
            out.append(self.parents.get(out[-1], "main"))
        return out

    def upsert(self, branch, key, content, now):
        self.rows[branch, key] = (content, now)
        self.gone.discard((branch, key))
        self.log.append((branch, key, now, content))

    def view(self, branch):
        out, hidden = {}, set()
        for b in self.line(branch):
            # what a branch has itself isn't hidden by a tombstone of its parents
            out |= {k: c for (x, k), (c, _) in self.rows.items() if x == b and k not in out and k not in hidden and (b, k) not in self.gone}
            hidden |= {k for x, k in self.gone if x == b}
        return out

    def delete(self, branch, key, now):
        prior = self.view(branch).get(key)
        self.rows.pop((branch, key), None)
        if branch != "main":
            self.gone.add((branch, key))
        self.log.append((branch, key, now, None))
        return prior

    def at(self, branch, t):
        out, seen = {}, set()
        for b in self.line(branch):
            latest = {}
            for x, k, when, content in self.log:
                if x == b and when <= t:
                    latest[k] = content
            out |= {k: c for k, c in latest.items() if k not in seen and c is not None}
            seen |= set(latest)
        return out


def test_store_of_branches_equals_dicts(spark):
    rng = random.Random(3)
    want = Store()
    empty = spark.createDataFrame([], FULL)
    branches = spark.createDataFrame([("p", "release", "main", None, 1, 1), ("p", "feature", "release", None, 1, 1)], "projectId string, branch string, parentBranch string, forkedFromCommit string, createdAt long, updatedAt long")
    e = MemoryEngine(spark, empty, 0, branches=branches)
    long = "words that repeat " * 60
    for now in range(10, 90, 10):
        branch = rng.choice(["main", "release", "feature"])
        keys = rng.sample("abcd", 2)
        e.now = now
        if now < 40 or rng.random() < 0.6:
            rows = [("p", branch, k, f"title {k}", f"{long if k == 'a' else 'short'} version {now} {k}") for k in keys]
            e = e.upsert(spark.createDataFrame(rows, "projectId string, branch string, id string, title string, content string").selectExpr("*", "'semantic' AS kind", "'s' AS summary"))
            for r in rows:
                want.upsert(branch, r[2], r[4], now)
        else:
            e = e.delete(spark.createDataFrame([(keys[0],), (keys[0],)], "id string"), "p", branch)
            want.delete(branch, keys[0], now)
        t = e.tables()  # stored and read again, as a caller would
        e = e.having(store.Tables(*(spark.createDataFrame(x.collect(), x.schema) for x in (t.memories, t.overlays, t.tombstones, t.log, t.branches))))
    for b in ("main", "release", "feature"):
        assert {r["logicalId"]: r["content"] for r in e.view("p", b).collect()} == want.view(b)
        for t in (25, 55):
            assert {r["logicalId"]: r["content"] for r in e.as_of("p", b, t).collect()} == want.at(b, t)
        assert {r["logicalId"] for r in e.list("p", branch=b).collect()} == set(want.view(b))
        for k in "abcd":
            got = e.get(k, "p", b).collect()
            assert [r["content"] for r in got] == [c for x, c in want.view(b).items() if x == k]
            assert [r["content"] for r in e.get(k, "p", b, 55).collect()] == [c for x, c in want.at(b, 55).items() if x == k]
        assert {r["logicalId"] for r in e.search("VERSION", project="p", branch=b, at=55).collect()} == set(want.at(b, 55))
    stored = {(r["branch"], r["logicalId"]): codec.analyse(r["content"]) for r in e.tables().memories.unionByName(e.tables().overlays).collect()}
    assert {k: v[1] for k, v in stored.items()} == {k: c for k, (c, _) in want.rows.items()} and all(v[0] == (k[1] == "a") for k, v in stored.items())
    assert {(r["branch"], r["logicalId"]) for r in e.tables().tombstones.collect()} == want.gone
    gone, count = e.delete_everywhere(spark.createDataFrame([("a",), ("nothing",)], "id string"))
    assert count.first()["deleted"] == (("main", "a") in want.rows) and gone.get("a").count() == 0


def test_search_on_main_fills_up_from_packed_contents(spark):
    packed = [f"needle {i} " + "straw of the same kind " * 60 for i in range(4)]
    rows = [(f"m{i}", "p", "semantic", f"t{i}", "s", codec.compact(x), ["t"], 0.5, 0.5, i, i) for i, x in enumerate(packed)]
    rows += [(f"n{i}", "p" if i else "q", "semantic", "needle" if i == 2 else "t", "s", f"a needle {i}", ["t"], 0.9, 0.5, 100 + i, 100 + i) for i in range(4)]
    m = spark.createDataFrame(rows, "id string, projectId string, kind string, title string, summary string, content string, tags array<string>, importance double, confidence double, createdAt long, lastAccessedAt long")
    e = MemoryEngine(spark, m, 1000)
    got = e.search("Needle", k=3).collect()
    assert [r["id"] for r in got] == ["n2", "n3", "n1"] and got[0]["similarity"] == 0.82
    every = e.search("needle", k=10).collect()
    assert {r["id"] for r in every} == {f"m{i}" for i in range(4)} | {f"n{i}" for i in range(4)} and all("needle" in r["content"] for r in every)
    assert {r["id"] for r in e.search("needle", k=10, project="q").collect()} == {"n0"} and e.search("  ").count() == 0
    v = spark.createDataFrame([("m0", [1.0, 0.0]), ("n0", [0.0, 1.0]), ("x", [1.0, 0.0])], "id string, embedding array<double>")
    near = MemoryEngine(spark, m, 1000, vectors=v).search("nothing of this", [1.0, 0.1], k=5).collect()
    assert [r["id"] for r in near] == ["m0", "n0"] and near[0]["content"] == packed[0]


def test_diff_lists_changes_in_order(spark):
    snap = temporal.close_intervals(writes(spark)).withColumn("kind", F.lit("semantic"))
    line = temporal.lineage(spark, branches(spark), "p", "feature")
    totals, items = temporal.diff_items(temporal.state_as_of(snap, line, 10), temporal.state_as_of(snap, line, 50))
    assert tuple(totals.first()) == (2, 0, 1)
    got = items.collect()
    assert [(r["changeType"], r["logicalId"], r["title"]) for r in got] == [("modified", "a", "again"), ("added", "b", "bee"), ("added", "c", "new")]
    assert got[0]["before"]["content"] == "alpha" and got[0]["after"]["content"] == "made again" and got[1]["before"] is None
    assert temporal.diff_items(temporal.state_as_of(snap, line, 10), temporal.state_as_of(snap, line, 50), 1)[1].count() == 1


def test_graph_rows_keep_their_creation(spark):
    schema = "id string, type string, label string, createdAt long"
    after = graph.upsert_graph(spark.createDataFrame([("a", "memory", "old", 1), ("b", "chat", "stays", 2)], schema), spark.createDataFrame([("a", "function", "new", 9), ("c", "memory", "made", 9)], schema))
    assert sorted(map(tuple, after.collect())) == [("a", "function", "new", 1), ("b", "chat", "stays", 2), ("c", "memory", "made", 9)]
    first = spark.createDataFrame([("p", "code", "a", "h1", "v", 1, 1), ("p", "code", "b", "h2", "v", 1, 1)], "projectId string, sourceType string, sourceRef string, contentHash string, ingestVersion string, firstIngestedAt long, lastIngestedAt long")
    new = first.where("sourceRef = 'a'").select("projectId", "sourceType", "sourceRef", F.lit("h3").alias("contentHash"), "ingestVersion").unionByName(spark.createDataFrame([("p", "chat", "a", "h4", "v")], "projectId string, sourceType string, sourceRef string, contentHash string, ingestVersion string"))
    got = {(r["sourceType"], r["sourceRef"]): (r["contentHash"], r["firstIngestedAt"], r["lastIngestedAt"]) for r in records.upsert_fingerprints(first, new, 7).collect()}
    assert got == {("code", "a"): ("h3", 1, 7), ("code", "b"): ("h2", 1, 1), ("chat", "a"): ("h4", 7, 7)}


def test_graph_of_deleted_snapshots(spark):
    m = spark.createDataFrame([("code", "p", "code_entity", "code", "src\\auth.ts", ["file:src/auth.ts"], "auth", 86_400_000, 86_400_000), ("chat", "p", "chat_turn", "chat", " s/one.json ", ["file:src/auth.ts"], "talk", 86_400_001, 86_400_001)], "id string, projectId string, kind string, sourceType string, sourceRef string, tags array<string>, title string, createdAt long, lastAccessedAt long")
    s = spark.createDataFrame([("p", "main", "gone", "delete", 5, "chat_turn", "chat", "s/one.json", [], ""), ("p", "other", "x", "upsert", 5, "semantic", "manual", None, [], "t"), ("p", "main", "bad", "upsert", 0, "semantic", "manual", None, [], "t")], "projectId string, branch string, logicalId string, operation string, validFrom long, kind string, sourceType string, sourceRef string, tags array<string>, title string")
    nodes, edges = graph.index_memories(m, s)
    got = {(r["relation"], r["operation"]): r["weight"] for r in edges.collect()}
    assert got == {("memory_time_bucket", None): 0.62, ("memory_session", None): 0.88, ("session_time_bucket", None): 0.67, ("chat_to_code", None): 0.74, ("snapshot_event", "delete"): 0.45, ("session_snapshot", "delete"): 0.42}
    labels = {(r["type"], r["label"]) for r in nodes.collect()}
    assert labels == {("function", "auth"), ("chat", "talk"), ("chat", "Memory gone"), ("concept", "Day 1970-01-02"), ("concept", "Day 1970-01-01"), ("session", "Session one.json")}
    assert graph.index_memories(m, s, since=86_400_001)[1].count() == 3


def test_searched_memories_are_touched_and_vectors_written(spark):
    m = memories(spark, ["a", "b", "c"])
    after = retrieval.touched(m, m.where("id = 'm1'"), 99).orderBy("id").collect()
    assert [r["lastAccessedAt"] for r in after] == [0, 99, 2]
    v = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, embedding array<double>")
    new = spark.createDataFrame([("b", [3.0]), ("c", []), ("d", [4.0])], "id string, embedding array<double>")
    assert sorted(map(tuple, store.upsert_vectors(v, new).collect())) == [("a", [1.0]), ("b", [3.0]), ("d", [4.0])]


def test_names_inside_words_are_linked(spark):
    m = spark.createDataFrame([("m1", "Uses authService here", "t", ["en"], 0.5), ("m2", "nothing", "AUTH  service", [], 1.0), ("m3", "x", "y", ["Dep"], 0.0), ("m4", "x", None, [], 0.0)], "id string, summary string, title string, tags array<string>, importance double")
    e = spark.createDataFrame([("e1", "AuthService", []), ("e2", "auth service", ["dep", "other"]), ("e3", "", ["x"]), ("e4", "äü+", [])], "id string, name string, dependencies array<string>")
    want = {("m1", "e1", True, 0.0): 0.81, ("m2", "e2", True, 0.0): 0.82, ("m3", "e2", False, 0.5): 0.64}
    for size in (1 << 20, 1):
        got = {(r["id"], r["entityId"], r["lexicalMatch"], r["depMatch"]): r["weight"] for r in evolution.link_entities(m, e, size).collect()}
        assert got == pytest.approx(want)


def test_continuations_follow_the_policy(spark):
    text = "the parser reads a token . the parser reads a file ( large ) . the lexer reads a file , then it stops ! " * 3
    m = ngram.ephemeral(text)
    known = {(m.names[a], m.names[b]) for a, after in m.followers.items() for b, _ in after}
    outs = []
    for seed in ("the", "reads a", "the lexer", "nothing known", "", "a (", "token .", "parser file lexer stops"):
        w = ngram.Writer(m, seed)
        for k in range(60):
            if not w.step(k):
                break
        outs.append(w.tokens)
        assert w.tokens and all(p in known for p in zip(w.tokens, w.tokens[1:], strict=False)) and len(w.tokens) <= 60
        assert ngram.continuation(m, seed, 60) == ngram.continuation(m, seed, 60)
        assert len(w.tokens) < 60 or not ngram.repeats(w.ids, 4)
        depth = 0
        for t in w.tokens:
            depth += (t in "([{") - (t in ")]}")
            assert depth >= -1
    assert len({tuple(o) for o in outs}) > 3
    assert ngram.continuation(m, "x", 5)[0] not in ".,!)" and ngram.continuation(ngram.ephemeral(""), "x", 5) == ""
    first = ngram.generator(1)
    assert [round(next(first), 10) for _ in range(2)] == [0.6270739406, 0.0027357212] and not ngram.has_word("é") and ngram.has_word("a1")
    assert ngram.repeats([1, 2, 3, 9, 1, 2, 3], 3) and not ngram.repeats([1, 2, 3], 3) and ngram.repeats([1, 1, 1, 1], 3)
