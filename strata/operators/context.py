"""Context assembly within token budgets, and intent of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring, text
from .lineage import kept

# Intents with their patterns, top-k and token budgets; the first of the most hits wins.
INTENT_RULES = (
    ("debugging", (r"\berror\b", r"\bexception\b", r"\bbug\b", r"\bfail(?:ed|ing)?\b", r"\bcrash\b", r"stack trace"), 16, 5600, "runtime + diagnostics + memory", ("prioritize failure context", "prefer latest affected entities")),
    ("testing", (r"\btest(?:s|ing)?\b", r"\bunit\b", r"\bintegration\b", r"\be2e\b", r"\bcoverage\b"), 14, 5200, "tests + related implementation", ("include assertions and edge cases", "surface flaky points")),
    ("refactor", (r"\brefactor\b", r"\bcleanup\b", r"\bsimplif(?:y|ication)\b", r"\bextract\b", r"\brename\b"), 12, 4600, "design + dependencies + hotspots", ("preserve behavior", "highlight coupling")),
    ("performance", (r"\bperformance\b", r"\bslow\b", r"\blatency\b", r"optimi[sz]e", r"\bthroughput\b", r"\bmemory leak\b"), 15, 5200, "hot paths + algorithmic complexity", ("prioritize hot-path code", "highlight complexity drivers")),
    ("security", (r"\bsecurity\b", r"\bvuln(?:erability)?\b", r"\bcve\b", r"\bauth(?:entication|orization)?\b", r"\bxss\b", r"\bcsrf\b"), 16, 5400, "auth + input validation + secret handling", ("surface trust boundaries", "flag dangerous defaults")),
    ("documentation", (r"\bdocs?\b", r"\breadme\b", r"\bexplain\b", r"\bguide\b", r"\bhow to\b"), 10, 3800, "architecture + APIs + examples", ("prefer concise context", "include canonical references")),
    ("feature", (r"\bimplement\b", r"\badd\b", r"\bbuild\b", r"\bcreate\b", r"\bsupport\b", r"\bfeature\b"), 13, 4800, "requirements + touched modules", ("identify dependencies", "capture migration impacts")),
)
GENERAL = ("general", 12, 4200, "project + memory + retrieval", ("prefer high-confidence memories", "keep context concise"))


def infer_intent(queries: DataFrame, column: str, history: Column | None = None) -> DataFrame:
    """category, confidence, topK, maxTokens, scope, constraints and reason; ``history``: how often the category came up
    before in a row. Of intents with equally many hits the first counts."""
    q = F.col(column)
    listed = lambda xs: F.array(*map(F.lit, xs))
    hits = F.array(*(F.struct(sum((q.rlike("(?i)" + text.ascii_bounds(p)).cast("int") for p in patterns), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("category"), F.lit(k).alias("topK"), F.lit(m).alias("maxTokens"), F.lit(scope).alias("scope"), listed(limits).alias("constraints")) for i, (name, patterns, k, m, scope, limits) in enumerate(INTENT_RULES)))
    best = queries.withColumn("__b", F.array_max(hits))
    some, n = F.coalesce(F.col("__b.n") > 0, F.lit(False)), F.col("__b.n")
    bonus = F.least(F.lit(0.12), F.lit(0.02) * history) if history is not None else F.lit(0.0)
    base = F.when(F.coalesce(text.trim(q), F.lit("")) == "", 0.0).when(some, scoring.clamp01(F.lit(0.38) + n * 0.12)).otherwise(0.45)
    chosen = {name: F.when(some, F.col(f"__b.{name}")).otherwise(listed(v) if isinstance(v, tuple) else F.lit(v)) for name, v in zip(("category", "topK", "maxTokens", "scope", "constraints"), GENERAL, strict=True)}
    reason = F.when(some, F.concat(F.lit("Detected "), F.col("__b.category"), F.lit(" intent from query signals; proactively tuned context packing."))).otherwise("No dominant intent detected. Using balanced context defaults.")
    return best.withColumns(chosen | {"confidence": scoring.clamp01(base + bonus), "reason": reason}).drop("__b")


def atom_rank(priority: Column, recency: Column, relevance: Column, tags: Column) -> Column:
    return F.lit(0.42) * priority + F.lit(0.22) * recency + F.lit(0.28) * relevance + F.when(F.size(tags) > 0, 0.08).otherwise(0.0)


def ranged(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` sorted by range into partitions whose number is ``part``, so that a group may lie in any number of them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")


def pack_prefix(parts: DataFrame, group: str, order: str, body: str, budget: int) -> DataFrame:
    """The longest prefix of each group whose joined text fits: parts before the first that overflows, with ``tokens`` so far.
    Parts of one place in the order count together.

    Lengths are summed within ranges first; texts meet the sums only where their range may still be in the prefix.
    """
    sizes = ranged(parts.select(F.col(group).alias("__g"), F.col(order).alias("__o"), (F.length(body) + 1).alias("n")), F.col("__g"), F.col("__o"))
    sums = sizes.groupBy("__g", "part").agg(F.sum("n").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("__g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per partition of a group
    may = sums.select(F.col("__g").alias("og"), F.col("part").alias("op"), earlier.alias("earlier")).where(F.col("earlier") <= 4 * budget)
    near = sizes.join(may, F.col("__g").eqNullSafe(F.col("og")) & (F.col("part") == F.col("op")))
    run = F.col("earlier") + F.sum("n").over(Window.partitionBy("__g", "part").orderBy("__o").rangeBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    tokens = F.greatest(F.lit(1), F.ceil(run / 4)).cast("long")
    fits = near.select("__g", "__o", tokens.alias("tokens")).where(F.col("tokens") <= budget).groupBy("__g", "__o").agg(F.max("tokens").alias("tokens"))
    return parts.join(fits, parts[group].eqNullSafe(fits["__g"]) & parts[order].eqNullSafe(fits["__o"])).drop("__g", "__o")


def prefix_of_few(parts: DataFrame, order: str, body: str, budget: int) -> DataFrame:
    """The same of a few rows, as a top-k has, which are one group."""
    run = F.sum(F.length(body) + 1).over(Window.partitionBy().orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - 1
    tokens = F.greatest(F.lit(1), F.ceil(run / 4)).cast("long")
    return parts.withColumn("tokens", tokens).where(F.col("tokens") <= budget)  # totals only grow, so this is a prefix


def pack_greedy(atoms: DataFrame, group: str, score: str, key: str, body: str, budget: int) -> DataFrame:
    """(group, key, tokens, accepted): in descending order of score an atom that overflows is skipped, later ones are tried.

    A group of any size is many tasks. Atoms are sorted by range; what a range does to the room that is left when it
    begins is a table with an entry for each possible room, so all ranges are gone through at once. A pass over these
    tables, one for each range, tells the room with which each begins, and a second pass decides its atoms.
    """
    rows = atoms.select(F.col(group).alias("g"), F.col(score).cast("double").alias("s"), F.col(key).alias("k"), text.estimate_tokens(F.col(body)).cast("long").alias("tokens"))
    kinds = dict(rows.dtypes)
    order = (F.col("g"), F.desc("s"), F.col("k"))
    sorted_rows = ranged(rows, *order)

    def through(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each range: its first and last group, where each possible room ends in the first, and the room after the last."""
        at, first, room, table, most = None, None, budget, None, -1
        for p in parts:
            for part, g, t in zip(p["part"], p["g"], p["tokens"], strict=True):
                if part != at:
                    if at is not None:
                        yield told(at, first, last, table, room)
                    at, first, last, table, room, most = part, g, g, np.arange(budget + 1), budget, budget
                elif g != last:
                    last, room = g, budget
                if g == first and t <= most:  # less room at first may leave more of it
                    table = np.where(table >= t, table - t, table)
                    most = table.max()
                room -= t if t <= room else 0
        if at is not None:
            yield told(at, first, last, table, room)

    def told(part: int, first: object, last: object, table: np.ndarray, room: int) -> pd.DataFrame:
        return pd.DataFrame({"part": [part], "first": [first], "last": [last], "table": [table.astype(np.int32)], "room": [int(room)]})

    def along(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The room with which each range begins."""
        before, room = None, budget
        for p in parts:
            starts = []
            for first, last, table, after in zip(p["first"], p["last"], p["table"], p["room"], strict=True):
                start = room if before is not None and first == before else budget
                starts.append(start)
                before, room = last, int(table[start]) if first == last else int(after)
            yield pd.DataFrame({"part": p["part"], "start": starts})

    def decide(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last, room = None, None, 0
        for p in parts:
            accepted = []
            for part, start, g, t in zip(p["part"], p["start"], p["g"], p["tokens"], strict=True):
                if part != at:
                    at, last, room = part, g, start
                elif g != last:
                    last, room = g, budget
                accepted.append(bool(t <= room))
                room -= t if t <= room else 0
            yield pd.DataFrame({"g": p["own"], "k": p["k"], "tokens": p["tokens"], "accepted": accepted})

    # equal groups lie together in a range; null ones are told by a mark, as null equals nothing in Python
    marked = sorted_rows.select("part", F.coalesce(F.sha2(F.col("g").cast("string"), 256), F.lit("")).alias("g"), "tokens", F.col("g").alias("own"), "s", "k")
    n = int(atoms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = marked.repartition(n, "part").sortWithinPartitions("part", "own", F.desc("s"), "k")
    tables = kept(dealt.select("part", "g", "tokens").mapInPandas(through, "part int, first string, last string, table array<int>, room long"), "rooms")
    starts = tables.coalesce(1).sortWithinPartitions("part").mapInPandas(along, "part int, start long")  # a row per range
    begun = marked.join(F.broadcast(starts), "part").repartition(n, "part").sortWithinPartitions("part", "own", F.desc("s"), "k")
    made = begun.select("part", "start", "g", "own", "k", "tokens").mapInPandas(decide, f"g {kinds['g']}, k {kinds['k']}, tokens long, accepted boolean")
    return made.withColumnsRenamed({"g": group, "k": key})


def compile_context(ranked: DataFrame, max_tokens: int = 4000) -> DataFrame:
    """One row: the text of the best parts within the budget, how many were used and dropped, and the tokens."""
    body = F.concat(F.lit("- "), "title", F.lit(": "), text.compress_summary(F.col("content"), 240))
    parts = ranked.select("id", "score", body.alias("body"), F.lit(0).alias("g"))
    parts = parts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # of top-k rows
    used = prefix_of_few(parts, "place", "body", max(256, max_tokens - 300))
    made = used.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "body"))), lambda x: x["body"]), "\n").alias("context"), F.count("*").alias("used"))
    return made.crossJoin(parts.agg(F.count("*").alias("n"))).select("context", "used", (F.col("n") - F.col("used")).alias("dropped"), text.estimate_tokens(F.col("context")).alias("tokens"))  # one row each


def two(name: str) -> Column:
    return F.format_string("%.2f", F.col(name).cast("double"))


def render_atoms(atoms: DataFrame, mode: str = "compact") -> DataFrame:
    """``text`` of each atom (title, kind, body, tags, sourceRef, priority, recency, relevance) in one of three modes."""
    c = F.col
    tags, plain = F.when(F.size("tags") > 0, F.array_join("tags", ", ")), F.when(F.size("tags") > 0, F.array_join("tags", ","))
    source = F.nullif(c("sourceRef"), F.lit(""))
    dot = F.concat(F.lit("• "), c("title"))
    if mode == "symbolic":
        out = F.concat(dot, F.lit(" :: "), F.upper("kind"), F.lit(" p="), two("priority"), F.lit(" r="), two("relevance"), F.coalesce(F.concat(F.lit(" tags="), plain), F.lit("")))
    elif mode == "compact":
        out = F.concat_ws("\n", dot, F.concat(F.lit("  "), text.cut(text.compact(c("body")), 180)), F.concat(F.lit("  tags: "), tags), F.concat(F.lit("  source: "), source))
    else:
        measures = F.concat(F.lit("priority: "), two("priority"), F.lit("  recency: "), two("recency"), F.lit("  relevance: "), two("relevance"))
        out = F.concat_ws("\n", dot, F.concat(F.lit("kind: "), c("kind")), measures, F.concat(F.lit("source: "), source), F.concat(F.lit("tags: "), tags), F.nullif(c("body"), F.lit("")))
    return atoms.withColumn("text", out)


TABLE_HEAD = "| # | kind | title | priority | relevance | recency |\n|---:|---|---|---:|---:|---:|"


def render_context(atoms: DataFrame, query: str, mode: str = "compact", table: bool = False, head: str = "[CONTEXT]") -> DataFrame:
    """One row, ``rendered``: a heading, a table if asked for, and the text of each atom, in order of ``place``. Atoms
    are those that a budget took, so they are few."""
    escape = lambda x: F.replace(x, F.lit("|"), F.lit("\\|"))
    cells = F.concat_ws(" | ", F.col("place").cast("string"), escape(F.col("kind")), escape(text.cut(text.compact(F.col("title")), 48)), two("priority"), two("relevance"), two("recency"))
    rows = render_atoms(atoms, mode).select(F.struct("place", F.concat(F.lit("| "), cells, F.lit(" |")).alias("cells"), "text").alias("r"))
    made = rows.agg(F.array_sort(F.collect_list("r")).alias("rs"))
    joined = lambda name: F.array_join(F.transform("rs", lambda r: r[name]), "\n")
    begin = F.concat(F.lit(f"{head}\nintent: "), F.lit(query), F.lit("\natoms: "), F.size("rs").cast("string"), F.lit("\n"))
    listing = F.when((F.size("rs") > 0) & F.lit(table), F.concat(F.lit("\n" + TABLE_HEAD + "\n"), joined("cells"), F.lit("\n"))).otherwise(F.lit(""))
    return made.select(F.concat(begin, listing, F.when(F.size("rs") > 0, F.concat(F.lit("\n"), joined("text"))).otherwise(F.lit(""))).alias("rendered"))


def format_context(memories: DataFrame, query: str, scope: str = "current_file + project + memory", constraints: tuple[str, ...] = (), scores: bool = False, head: str = "[CONTEXT]") -> DataFrame:
    """One row, ``formatted``: memories (kind, title, summary, tags, score) in order of ``place`` under a heading, with
    the constraints below; of the few memories that a search gave."""
    lines = F.concat_ws("\n", F.concat(F.lit("  - ["), "kind", F.lit("] "), "title"), F.concat(F.lit("    summary: "), "summary"), F.when(F.lit(scores), F.format_string("    score: %.4f", F.col("score").cast("double"))), F.when(F.size("tags") > 0, F.concat(F.lit("    tags: "), F.array_join("tags", ", "))))
    made = memories.select(F.struct("place", lines.alias("t")).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    body = F.when(F.size("rs") > 0, F.array_join(F.transform("rs", lambda r: r["t"]), "\n")).otherwise("  - none")
    end = "".join(["\n\nconstraints:", *(f"\n  - {c}" for c in constraints)]) if constraints else ""
    return made.select(F.concat(F.lit(f"{head}\n\nintent: {query}\nscope: {scope}\n\nmemories:\n"), body, F.lit(end)).alias("formatted"))


def prompt_envelope(rendered: Column, query: str, system: str = "", stats: dict[str, Column] | None = None) -> Column:
    """A prompt: guidance, context, its counts of tokens, atoms and dropped atoms, and the query."""
    parts = [F.lit(f"[SYSTEM]\n{system}")] if system else []
    parts.append(F.nullif(rendered, F.lit("")))
    if stats:
        parts.append(F.concat(F.lit("\n[CONTEXT_STATS]\ntokens="), stats["tokens"].cast("string"), F.lit(" atoms="), stats["atoms"].cast("string"), F.lit(" dropped="), stats["dropped"].cast("string")))
    asked = query.strip()
    return F.concat_ws("\n\n", *parts, F.lit("\n[USER_QUERY]"), *([F.lit(asked)] if asked else []))


def bundle(memories: DataFrame, query: str, health: DataFrame, agent: str = "daemon") -> DataFrame:
    """One row: the memories (id, kind, title, summary, content, tags, sourceRef, importance, recency, similarity,
    place) that a search gave as atoms, what the agent's budget takes of them rendered and as an envelope, the same
    as sections, and the health of memory."""
    m = memories
    body = text.trim(F.concat("summary", F.lit("\n"), text.preview(F.col("content"), 320)))
    atoms = m.select("id", "place", F.lit("memory").alias("kind"), "title", body.alias("body"), F.col("importance").alias("priority"), "recency", F.col("similarity").alias("relevance"), "sourceRef", "tags")
    taken = resolve_context(atoms, agent).withColumn("place", F.row_number().over(Window.orderBy(F.desc("rank"), "id")))
    tokens, most, mode = HUB_POLICIES[agent]
    rendered = render_context(taken, query, mode)
    used = taken.agg(F.count("*").alias("atoms"), F.coalesce(F.sum(text.estimate_tokens(F.concat_ws("\n", "title", "body"))), F.lit(0)).alias("tokens"))
    listed = m.agg(F.array_sort(F.collect_list(F.struct("place", "title", F.concat("kind", F.lit(" -> "), "title").alias("link")))).alias("ms"))
    names = lambda f: F.slice(F.transform("ms", lambda x: x[f]), 1, 10)
    one = listed.crossJoin(rendered).crossJoin(used).crossJoin(health.select(F.col("status").alias("healthStatus"), "recommendation"))  # one row each
    stats = {"tokens": F.col("tokens"), "atoms": F.col("atoms"), "dropped": F.size("ms") - F.col("atoms")}
    return one.select(F.lit(query).alias("query"), names("title").alias("concepts"), names("link").alias("graph"), F.array(*map(F.lit, BUNDLE_LIMITS)).alias("constraints"), "rendered", prompt_envelope(F.col("rendered"), query, stats=stats).alias("envelope"), "tokens", "atoms", "healthStatus", "recommendation")


# Constraints of a bundle.
BUNDLE_LIMITS = ("local-first", "token-bounded", "high-confidence-preferred")


# Token and atom budgets and render modes by agent.
HUB_POLICIES = {"copilot": (2000, 20, "compact"), "cli": (4000, 40, "full"), "gpt": (8000, 60, "compact"), "daemon": (4000, 24, "compact")}


def resolve_context(atoms: DataFrame, agent: str = "daemon") -> DataFrame:
    """The atoms that an agent's budget takes, best first, with their text: at most its number, then greedily its tokens."""
    tokens, most, mode = HUB_POLICIES[agent]
    ranked = atoms.withColumn("rank", atom_rank(F.col("priority"), F.col("recency"), F.col("relevance"), F.col("tags"))).orderBy(F.desc("rank"), "id").limit(3 * most)
    packed = pack_greedy(ranked.withColumns({"g": F.lit(0), "whole": F.concat_ws("\n", "title", "body")}), "g", "rank", "id", "whole", tokens).where("accepted").select("id")
    return render_atoms(ranked.join(F.broadcast(packed), "id").orderBy(F.desc("rank"), "id").limit(most), mode)


def retrieve_top_k(scored: DataFrame, k: int, project: str | None = None, least: float = 0.0) -> DataFrame:
    """Of scored rows: those with a summary, of the project, the best per id, scoring enough; then by score and similarity."""
    from .retrieval import dedupe_best

    rows = scored.where(F.length(text.trim(F.col("summary"))) > 0)
    rows = rows.where(F.col("projectId") == project) if project else rows
    return dedupe_best(rows).where(F.col("score") >= least).orderBy(F.desc("score"), F.desc("similarity"), "id").limit(k)


# The steps before and after the anchors of a plan.
PLAN_HEAD = (("Confirm objective and constraints", "Clarify the primary goal for: "), ("Collect relevant context", "Review top-ranked memory/code entities and extract high-confidence facts."))
PLAN_ANCHOR = ("Inspect memory anchor: ", "Validate dependencies and potential side effects before execution.")
PLAN_TAIL = (("Execute change in bounded increments", "Apply updates in small steps, validate after each change, and track regressions early."), ("Verify and summarize", "Run validation checks, capture outcomes, and document follow-up actions."))


def execution_plan(ranked: DataFrame, query: str, anchors: int = 5, raw: bool = False) -> DataFrame:
    """(step, title, detail): two fixed steps, one per best memory with a title, two fixed steps.

    Titles are trimmed and cut to 160 characters; ``raw`` ones are told as they are, blank and missing ones too.
    """
    shown = F.col("title") if raw else F.substring(text.trim(F.col("title")), 1, 160)
    top = (ranked if raw else ranked.where(shown != "")).orderBy(F.desc("score"), "id").limit(anchors)
    titles = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", shown.alias("t")))), lambda x: F.struct(F.concat(F.lit(PLAN_ANCHOR[0]), x["t"]).alias("title"), F.lit(PLAN_ANCHOR[1]).alias("detail")))
    fixed = lambda steps: F.array(*(F.struct(F.lit(t).alias("title"), F.lit(d).alias("detail")) for t, d in steps))
    head = ((PLAN_HEAD[0][0], PLAN_HEAD[0][1] + query), PLAN_HEAD[1])
    return top.agg(F.concat(fixed(head), titles, fixed(PLAN_TAIL)).alias("p")).select(F.posexplode("p").alias("i", "x")).select((F.col("i") + 1).alias("step"), "x.title", "x.detail")
