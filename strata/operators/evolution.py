"""Heuristics of memory evolution: critics, decay, planning, drafts, refactoring advice."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, text

# Intents in order of precedence, tags of drafts, advice by keyword.
INTENTS = (("debugging", "(error|exception|failing|crash|debug)"), ("refactor", "(refactor|cleanup|rewrite|modulari[sz]e|simplif)"), ("feature", "(feature|implement|add|support|introduce)"), ("performance", "(performance|optimi[sz]e|latency|throughput|slow)"), ("testing", "(test|spec|coverage|regression)"))
DRAFT_TAGS = (("refactor", "(refactor|cleanup|rewrite)"), ("bugfix", "(bug|fix|error|exception)"), ("performance", "(optimi[sz]e|performance|latency)"), ("testing", "(test|spec|assert)"), ("typescript", r"(typescript|ts\b|node)"))
PROTECTED = ("critical", "keep", "pinned", "do-not-archive", "golden")
ADVICE = (
    (("duplicate", "redundant"), "Extract duplicated logic into a shared utility with a stable interface."), (("long", "complex", "nested"), "Split large or nested control flow into focused helper functions."),
    (("state", "mutable"), "Isolate mutable state behind explicit invariants and transition helpers."), (("recursion", "stack"), "Evaluate iterative or memoized strategy to reduce recursion overhead."),
    (("error", "exception"), "Normalize error handling boundaries and propagate typed failures consistently."),
)
NO_ADVICE = "Apply small, behavior-preserving refactors around the highest-friction area first."


def quality(body: Column, length: int, marks: int, weights: tuple[float, float]) -> Column:
    """Clarity from length and punctuation."""
    return scoring.clamp01(scoring.clamp01(F.length(body) / F.lit(length)) * weights[0] + scoring.clamp01(F.regexp_count(body, F.lit("[.;:!?]")) / F.lit(marks)) * weights[1])


def overlap_novelty(body: Column, snippets: Column) -> Column:
    """1 - the share of snippets that the text has in it, without regard to case."""
    low = F.lower(body)
    return scoring.clamp01(1 - F.size(F.filter(snippets, lambda s: F.contains(low, F.lower(s)))) / F.greatest(F.lit(1), F.size(snippets)))


def critic(body: Column, novelty: Column) -> list[Column]:
    """clarity from length and punctuation, score with novelty, and whether that is accepted (0.35 or more); blank texts score 0."""
    blank = text.trim(body) == ""
    clarity = F.when(blank, 0.0).otherwise(quality(body, 350, 6, (0.65, 0.35)))
    score = F.when(blank, 0.0).otherwise(scoring.clamp01(novelty * 0.6 + clarity * 0.4))
    return [clarity.alias("clarity"), score.alias("score"), (score >= 0.35).alias("accepted")]


def critic_action(score: Column) -> Column:
    return F.when(score >= 0.8, "merge").when(score >= 0.6, "store").when(score >= 0.42, "compress").otherwise("reject")


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def reviewed(m: Column, low: Column, otherwise: str) -> Column:
    """A review as a struct from title, novelty, redundancy, clarity and score; a merge has the title as its key."""
    action = critic_action(m["score"])
    key = F.regexp_replace(F.lower(m["title"]), "[^a-z0-9]+", "-")
    return F.struct((action != "reject").alias("accepted"), m["score"].alias("score"), m["novelty"].alias("novelty"), m["redundancy"].alias("redundancy"), m["clarity"].alias("clarity"), action.alias("action"), F.when(action == "reject", low).otherwise(otherwise).alias("reason"), F.when(action == "merge", key).alias("mergeKey"))


ACCEPTED, LOW, EMPTY = "accepted-by-heuristic", "low-signal", "empty-candidate"


def critic_fallback(title: Column, summary: Column, snippets: Column) -> Column:
    """The review of a candidate against snippets, as the mean of two judges; an empty candidate is rejected."""
    known = F.filter(F.transform(snippets, text.trim), lambda s: s != "")
    trimmed = F.struct(text.trim(title).alias("title"), text.trim(F.concat(text.trim(title), F.lit("\n"), text.trim(summary))).alias("body"), known.alias("known"))
    none = F.lit(0.0)
    empty = F.struct(F.lit(False).alias("accepted"), none.alias("score"), none.alias("novelty"), F.lit(1.0).alias("redundancy"), none.alias("clarity"), F.lit("reject").alias("action"), F.lit(EMPTY).alias("reason"), F.lit(None).cast("string").alias("mergeKey"))

    def measured(c: Column) -> Column:
        parts = F.struct(c["title"].alias("title"), overlap_novelty(c["body"], c["known"]).alias("novelty"), quality(c["body"], 320, 5, (0.7, 0.3)).alias("one"), quality(c["body"], 350, 6, (0.65, 0.35)).alias("two"))
        return F.when(c["body"] != "", let(parts, judged)).otherwise(empty)

    def judged(p: Column) -> Column:
        first, second = scoring.clamp01(p["novelty"] * 0.62 + p["one"] * 0.38), scoring.clamp01(p["novelty"] * 0.6 + p["two"] * 0.4)
        mean = F.struct(p["title"].alias("title"), p["novelty"].alias("novelty"), (1 - p["novelty"]).alias("redundancy"), ((p["one"] + p["two"]) / 2).alias("clarity"), ((first + second) / 2).alias("score"), second.alias("second"))
        return let(mean, lambda m: reviewed(m, F.when(m["second"] >= 0.35, ACCEPTED).otherwise(LOW), "fallback-heuristic"))

    return let(trimmed, measured)


def critic_ngram(title: Column, summary: Column, snippets: Column, expected: Column) -> Column:
    """The review with a model's novelty ``expected`` of title and summary."""
    given = F.struct(title.alias("title"), F.length(summary).alias("n"), text.trim(F.concat(title, F.lit("\n"), summary)).alias("body"), snippets.alias("known"), expected.alias("expected"))

    def measured(c: Column) -> Column:
        blank = c["body"] == ""
        parts = F.struct(c["title"].alias("title"), c["n"].alias("n"), blank.alias("blank"), c["expected"].alias("expected"), F.when(blank, 0.0).otherwise(overlap_novelty(c["body"], c["known"])).alias("base"), F.when(blank, 0.0).otherwise(quality(c["body"], 350, 6, (0.65, 0.35))).alias("clarity"))
        return let(parts, judged)

    def judged(p: Column) -> Column:
        novelty = scoring.clamp01(p["base"] * 0.7 + p["expected"] * 0.3)
        clear = scoring.clamp01(p["clarity"] * 0.9 + F.least(F.lit(1.0), p["n"] / F.lit(300)) * 0.1)
        low = F.when(p["blank"], EMPTY).when(scoring.clamp01(p["base"] * 0.6 + p["clarity"] * 0.4) >= 0.35, ACCEPTED).otherwise(LOW)
        both = F.struct(p["title"].alias("title"), novelty.alias("novelty"), scoring.clamp01(1 - novelty).alias("redundancy"), clear.alias("clarity"), scoring.clamp01(novelty * 0.62 + clear * 0.38).alias("score"), low.alias("low"))
        return let(both, lambda m: reviewed(m, m["low"], "ngram-review"))

    made = let(given, measured)
    return made.withField("mergeKey", F.regexp_replace(made["mergeKey"], "^-+|-+$", ""))


def choose(candidates: DataFrame, key: str) -> DataFrame:
    """The best candidate of each key: accepted first, then by action, score, novelty and id."""
    weight = F.element_at(F.create_map(*[F.lit(x) for p in {"merge": 3, "store": 2, "compress": 1, "reject": 0}.items() for x in p]), F.col("action"))
    order = F.struct(F.col("accepted").cast("int").alias("a"), weight.alias("w"), "score", "novelty", "id")
    return candidates.groupBy(key).agg(F.max_by(F.struct("id", "action", "score"), order).alias("best")).select(key, "best.*")


def choose_candidate(reviews: DataFrame, key: str) -> DataFrame:
    """The best reviewed candidate of each key, with ``index``, its place among them from 0, and ``n``, how many there
    are: accepted first, then by action, score and novelty; the first of equals."""
    weight = F.element_at(F.create_map(*[F.lit(x) for p in {"merge": 4, "store": 3, "compress": 2, "reject": 1}.items() for x in p]), F.col("action"))
    order = F.struct(F.col("accepted").cast("int"), weight, "score", "novelty", -F.col("place"))
    columns = [c for c in reviews.columns if c != key]
    best = reviews.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("b"), F.count("*").alias("n"), F.min("place").alias("first"))
    return best.select(key, "b.*", (F.col("b.place") - F.col("first")).cast("int").alias("index"), F.col("n").cast("int").alias("n"))


def decay(memories: DataFrame, now: int) -> DataFrame:
    """Importance and confidence after ageing, and whether a row is promoted or archived."""
    days = F.greatest(F.lit(0), F.lit(now) - F.col("createdAt")) / scoring.DAY
    kept = F.arrays_overlap(F.transform("tags", lambda t: F.lower(F.trim(t))), F.array(*map(F.lit, PROTECTED)))
    boost = F.when(F.col("kind") == "code_entity", 0.03).when(F.col("kind") == "procedural", 0.02).otherwise(0.0) + F.when(F.col("confidence") >= 0.85, 0.02).otherwise(0.0) + F.when(kept, 0.08).otherwise(0.0)
    after = memories.select("*", F.round(scoring.clamp01(F.col("importance") * F.greatest(F.lit(0.35), 1 - days * 0.002) + boost), 4).alias("importanceAfter"), F.round(scoring.clamp01(F.col("confidence") * F.greatest(F.lit(0.75), 1 - days * 0.0008)), 4).alias("confidenceAfter"), kept.alias("protected"))
    i, c = F.col("importanceAfter"), F.col("confidenceAfter")
    return after.withColumns({"promote": (i >= 0.82) & (c >= 0.82), "archive": (i < 0.22) & (c < 0.45) & ~F.col("protected")})


PROMOTED = "promoted"


def settle(reviewed: DataFrame, now: int) -> DataFrame:
    """Reviewed candidates (id, projectId, kind, title, summary, content, tags, action, score, clarity) as memories to
    store: rejected ones drop; those to compress are shortened; importance and confidence are score and clarity after
    ageing; promoted ones get at least 0.9 and a tag; ``stored`` is false for those that are archived at once."""
    short = F.col("action") == "compress"
    kept = reviewed.where(F.col("action") != "reject")
    made = kept.withColumns({
        "summary": F.when(short, text.compress_agent(F.col("summary"), 180)).otherwise(F.col("summary")), "content": F.when(short, text.compress_agent(F.col("content"), 1200, True)).otherwise(F.col("content")),
        "importance": scoring.clamp01(F.col("score")), "confidence": scoring.clamp01(F.col("clarity")), "createdAt": F.lit(now), "lastAccessedAt": F.lit(now), "sourceType": F.lit("system"),
    })
    aged = decay(made, now)
    importance = F.when(F.col("promote"), F.greatest(F.col("importanceAfter"), F.lit(0.9))).otherwise(F.col("importanceAfter"))
    tags = F.when(F.col("promote"), F.array_distinct(F.concat("tags", F.array(F.lit(PROMOTED))))).otherwise(F.col("tags"))
    return aged.withColumns({"importance": importance, "confidence": F.col("confidenceAfter"), "tags": tags, "stored": ~F.col("archive")}).drop("importanceAfter", "confidenceAfter", "protected", "archive")


def planner_intent(query: Column) -> Column:
    q = F.lower(query)
    out = F.when(q.rlike(INTENTS[0][1]), INTENTS[0][0])
    for name, pattern in INTENTS[1:]:
        out = out.when(q.rlike(pattern), name)
    return out.otherwise("general")


# Strategy, constraint, risk and steps of plans by intent; what all plans have; what compatibility calls for.
PLANS = {
    "debugging": ("diagnostic", "reproduce before patching", "fixing symptoms instead of root cause", (("Reproduce and isolate", "Capture a deterministic repro and isolate the smallest failing path."), ("Inspect signals", "Use logs, stack traces, and memory anchors to identify likely root causes."), ("Patch incrementally", "Implement a narrow fix, then verify with targeted regression tests."))),
    "refactor": ("refactor", "preserve public behavior", "behavior drift due to interface changes", (("Define invariants", "Preserve public behavior and identify contracts that cannot change."), ("Split and extract", "Break large units into focused modules with explicit boundaries."), ("Validate parity", "Run existing tests and add coverage for modified control flow."))),
    "feature": ("delivery", None, "scope creep and incomplete acceptance criteria", (("Define acceptance criteria", "Translate request into measurable behavior and edge cases."), ("Implement minimal vertical slice", "Ship the smallest end-to-end behavior before broadening scope."), ("Expand safely", "Iterate with tests, telemetry, and backward-compatible interfaces."))),
    "performance": ("incremental", "measure before and after optimization", "micro-optimizations without real impact", (("Profile hotspots", "Measure bottlenecks before optimization to avoid premature tuning."), ("Optimize dominant path", "Target the largest cost center with algorithmic or data-structure improvements."), ("Verify gains", "Re-measure and ensure correctness remains intact under representative load."))),
    "testing": ("incremental", None, None, (("Map risk boundaries", "Prioritize brittle paths and integration seams for deeper validation."), ("Add focused tests", "Cover high-risk behavior with deterministic assertions and fixtures."), ("Automate regression loop", "Ensure tests run in CI and gate merges for repeated confidence."))),
    "general": ("incremental", None, None, (("Clarify objective", "Convert request into explicit outcomes and constraints."), ("Execute in bounded steps", "Implement iteratively and validate each change before proceeding."), ("Close with verification", "Summarize outcomes and capture follow-up actions."))),
}
PLAN_LIMITS, PLAN_RISK, COMPATIBLE = ("token-bounded context", "small reversible changes"), "regression risk in related modules", "maintain backward compatibility"


def plans(queries: DataFrame, column: str, context: Column | None = None) -> DataFrame:
    """``queries`` with intent, objective, strategy, constraints, risks and three steps (title, detail) of a plan."""
    spark = queries.sparkSession
    rows = [(intent, strategy, [*PLAN_LIMITS, *([limit] if limit else [])], [PLAN_RISK, *([risk] if risk else [])], [{"id": i, "title": t, "detail": d} for i, (t, d) in enumerate(steps, 1)]) for intent, (strategy, limit, risk, steps) in PLANS.items()]
    table = spark.createDataFrame(rows, "intent string, strategy string, constraints array<string>, risks array<string>, steps array<struct<id: int, title: string, detail: string>>")
    asked = text.trim(F.col(column))
    made = queries.withColumns({"objective": asked, "intent": planner_intent(asked)}).join(F.broadcast(table), "intent")  # six rows
    if context is None:
        return made
    keeps = F.lower(F.coalesce(context, F.lit(""))).rlike("backward|compat")
    return made.withColumn("constraints", F.when(keeps, F.concat("constraints", F.array(F.lit(COMPATIBLE)))).otherwise(F.col("constraints")))


def draft(body: Column) -> list[Column]:
    """title, summary and tags of a note."""
    clean = text.trim(body)
    tags = F.array_compact(F.array(*(F.when(F.lower(clean).rlike(p), t) for t, p in DRAFT_TAGS)))
    title = F.substring(F.split(clean, "\r?\n")[0], 1, 72)
    return [F.when(title == "", "Untitled memory").otherwise(title).alias("title"), text.cut(clean, 180).alias("summary"), F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("general"))).alias("tags")]


def advice(body: Column) -> Column:
    """Refactoring advice by keyword, at least one."""
    low = F.lower(body)
    found = F.array_compact(F.array(*(F.when(low.rlike("|".join(words)), say) for words, say in ADVICE)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_ADVICE)))


KINDS_OF_MEMORY = ("episodic", "semantic", "procedural", "code_entity", "chat_turn", "refactor_plan")
DEFAULT_TITLE, DEFAULT_CONTENT, DEFAULT_TAG = "Generated Memory", "Generated memory content.", "auto-generated"


def shortened(value: Column, most: int) -> Column:
    """At most ``most`` characters, the last an ellipsis after no white space."""
    return F.when(F.length(value) <= most, value).otherwise(F.concat(F.regexp_replace(F.substring(value, 1, most - 1), rf"{text.WHITE}+\z", ""), F.lit("…")))


def normalize_candidates(candidates: DataFrame, key: str, project: Column, most: int = 5) -> DataFrame:
    """Candidates (``key``, place, kind, title, summary, content, tags, sourceRef) with bounded texts and defaults: the
    first of each kind and title, without regard to case, and at most ``most`` of a key."""
    given = lambda c: text.trim(F.coalesce(F.col(c), F.lit("")))
    content = given("content")
    summary = shortened(F.when(F.col("summary").isNull(), text.trim(F.substring(content, 1, 220))).otherwise(given("summary")), 220)
    title = shortened(F.when(F.col("title").isNull(), text.trim(F.split(summary, "\r?\n")[0])).otherwise(given("title")), 120)
    tags = F.slice(F.array_distinct(F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), text.trim), lambda t: t != "")), 1, 16)
    source = F.coalesce(F.nullif(given("sourceRef"), F.lit("")), project)
    made = candidates.select(
        key, "place", F.when(F.col("kind").isin(*KINDS_OF_MEMORY), F.col("kind")).otherwise("semantic").alias("kind"), F.coalesce(F.nullif(title, F.lit("")), F.lit(DEFAULT_TITLE)).alias("title"), F.coalesce(F.nullif(summary, F.lit("")), F.substring(content, 1, 120)).alias("summary"),
        F.coalesce(F.nullif(content, F.lit("")), F.nullif(summary, F.lit("")), F.nullif(title, F.lit("")), F.lit(DEFAULT_CONTENT)).alias("content"), F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit(DEFAULT_TAG))).alias("tags"), source.alias("sourceRef"),
    )
    first = made.groupBy(key, "kind", F.lower("title").alias("__t")).agg(F.min_by(F.struct(*made.columns), "place").alias("c"))
    best = first.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct(F.col("c.place").alias("place"), "c"))), 1, most).alias("cs"))  # candidates of one text
    return best.select(F.posexplode("cs").alias("i", "x")).select("x.c.*")


def entity_blocks(entities: DataFrame, block_bytes: int) -> list[list[tuple]]:
    """(id, lower-cased name, dependencies) in blocks of about so many bytes of names."""
    blocks: list[list[tuple]] = [[]]
    held = 0
    for r in entities.select("id", text.compact(F.lower("name")).alias("name")).where("name <> ''").distinct().toLocalIterator():
        if held > block_bytes:
            blocks.append([])
            held = 0
        blocks[-1].append((r["id"], r["name"]))
        held += len(r["name"]) + 80
    return blocks


def link_entities(memories: DataFrame, entities: DataFrame, block_bytes: int = 16 << 20) -> DataFrame:
    """(id, entityId, weight, lexicalMatch, depMatch): memories (id, title, summary, tags, importance) and entities
    (id, name, dependencies) whose name occurs anywhere in the title or summary, or that share a tag with a dependency.

    Pairs with neither aren't linked. Names are sought inside the scan by one automaton for each ``block_bytes`` of
    them, so names inside words and of any characters are found; tags meet dependencies in an equi-join.
    """
    spark = memories.sparkSession
    norm = lambda c: text.compact(F.lower(c))
    body = F.concat_ws("\x01", norm(F.coalesce("summary", F.lit(""))), norm(F.coalesce("title", F.lit(""))))
    scanned = memories.select("id", body.alias("body"))
    kind, entity_kind = memories.schema["id"].dataType.simpleString(), entities.schema["id"].dataType.simpleString()
    found = None
    for block in entity_blocks(entities, block_bytes):
        sent = spark.sparkContext.broadcast(block)

        def run(parts: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            import ahocorasick

            by_name: dict[str, list] = {}
            for i, name in sent.value:
                by_name.setdefault(name, []).append(i)
            automaton = ahocorasick.Automaton()
            for name, ids in by_name.items():
                automaton.add_word(name, ids)
            automaton.make_automaton()
            for p in parts:
                rows = [(k, e) for k, x in zip(p.id, p.body, strict=True) for e in ({i for _, ids in automaton.iter(x) for i in ids} if by_name else ())]
                yield pd.DataFrame(rows, columns=["id", "entityId"])

        part = scanned.mapInPandas(run, f"id {kind}, entityId {entity_kind}")
        found = part if found is None else found.unionByName(part)
    tags = memories.select("id", F.size("tags").alias("nt"), F.explode("tags").alias("t")).select("id", "nt", norm("t").alias("t"))
    deps = entities.select(F.col("id").alias("entityId"), F.size("dependencies").alias("nd"), F.explode(F.array_distinct(F.transform("dependencies", norm))).alias("t"))
    shared = tags.join(deps, "t").groupBy("id", "entityId").agg((F.count("*") / F.greatest(F.first("nt"), F.first("nd"))).alias("dep"))
    both = found.distinct().withColumn("lexical", F.lit(True)).join(shared, ["id", "entityId"], "full_outer").join(memories.select("id", "importance"), "id")
    lexical, dep = F.coalesce("lexical", F.lit(False)), F.coalesce("dep", F.lit(0.0))
    return both.select("id", "entityId", scoring.link_weight(lexical.cast("double"), dep, F.col("importance")).alias("weight"), lexical.alias("lexicalMatch"), F.round(dep, 4).alias("depMatch"))


# Weights of a dependency that has the other's name, and of entities that are only at hand together.
DEPENDS, TOGETHER = (0.82, "dependency-name-match"), (0.41, "co-located")


def link_dependencies(pairs: DataFrame) -> DataFrame:
    """Pairs of entities (fromId, dependencies, toId, toName) with the weight and reason of their edge."""
    name = text.compact(F.lower("toName"))
    relates = F.exists("dependencies", lambda d: F.contains(text.compact(F.lower(d)), name))
    return pairs.select("fromId", "toId", F.lit("depends_on").alias("type"), F.when(relates, DEPENDS[0]).otherwise(TOGETHER[0]).alias("weight"), F.when(relates, DEPENDS[1]).otherwise(TOGETHER[1]).alias("reason"))
