"""Code facts, chunks, chat turns and change detection."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hashing, lexing, text

# Patterns of code facts.
NAME = "[A-Za-z_][A-Za-z0-9_]*"
FUNCTIONS = (rf"\bfunction\s+({NAME})\s*\(", rf"\bdef\s+({NAME})\s*\(", rf"\b({NAME})\s*=\s*\([^)]*\)\s*=>")
IMPORTS = r"(?m)^\s*(?:import\s+.*from\s+[\"'][^\"']+[\"']|#include\s+[<\"][^>\"]+[>\"])"
CLASSES = (rf"\bclass\s+({NAME})", rf"\bstruct\s+({NAME})")


def found(source: Column, *patterns: str, group: int = 1) -> Column:
    """Distinct matches, pattern by pattern, in order."""
    return F.array_distinct(F.concat(*(F.regexp_extract_all(source, F.lit(p), F.lit(group)) for p in patterns)))


def count(source: Column, pattern: str) -> Column:
    return F.regexp_count(source, F.lit(pattern))


def code_facts(source: Column) -> dict[str, Column]:
    """imports, functions, classes, loops, branches and a hint of the complexity."""
    loops, branches = count(source, r"\b(?:for|while)\b"), count(source, r"\b(?:if|switch|case)\b")
    hint = (
        F.when(text.trim(source) == "", "empty source").when(loops >= 2, "likely O(n^k) due to nested loops").when((loops == 1) & (branches > 0), "likely O(n) with branch-dependent flow")
        .when(loops == 1, "likely O(n)").when(branches > 0, "branch-heavy, data-dependent complexity").otherwise("likely bounded helper or direct mapping")
    )
    return {"imports": F.transform(found(source, IMPORTS, group=0), text.trim), "functions": found(source, *FUNCTIONS), "classes": found(source, *CLASSES), "loops": loops, "branches": branches, "complexityHint": hint}


# Words that are no identifiers and no calls, and patterns of structural counts; lines end as Python's do.
KEYWORDS = (
    "if", "else", "for", "while", "switch", "case", "return", "class", "function", "def", "import", "from", "try", "catch", "finally", "public", "private", "protected", "static", "new", "const", "let", "var", "async", "await", "true", "false", "null", "undefined", "None",
)
IMPORT_LINES = r"(?mdU)^\s*(?:import\s+.+|from\s+\S+\s+import\s+.+|#include\s+[<\"][^>\"]+[>\"])"
FUNCTION_LINES = (rf"^\s*(?:async\s+)?function\s+({NAME})\s*\(", rf"^\s*def\s+({NAME})\s*\(", rf"\b({NAME})\s*=\s*\([^\)]*\)\s*=>")
CLASS_LINES = rf"(?mdU)^\s*(?:export\s+)?class\s+({NAME})"
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: The order of a feature vector.
STRUCT_NAMES = (
    "num_functions", "num_classes", "num_interfaces", "num_loops", "num_branches", "num_calls", "num_imports", "num_returns", "max_depth", "line_count", "identifier_count", "recursion_flag", "cyclomatic_proxy", "avg_identifier_len", "unique_dependency_count",
)


def stripped(x: Column) -> Column:
    """Without white space of any kind at the ends, as Python has it."""
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def dependency(line: Column) -> Column:
    """What an import line names: an included file, the module after ``from``, or the first one after ``import``."""
    bare = stripped(line)
    first = stripped(F.split(F.split(F.substring(bare, 8, 1 << 30), " as ")[0], ",")[0])
    return F.when(bare.startswith("#include"), F.regexp_extract(bare, r"#include\s+[<\"]([^>\"]+)[>\"]", 1)).when(bare.startswith("from "), F.split(bare, r"\s+")[1]).when(bare.startswith("import "), first).otherwise("")


def nesting(source: Column) -> Column:
    """The greater of the depth of braces, where one that closes nothing is skipped, and of four-space indents."""
    marks = F.filter(F.split(F.regexp_replace(source, r"[^{}]", ""), ""), lambda x: x != "")
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))
    step = lambda a, x: F.struct(F.when(x == "{", a["d"] + 1).otherwise(F.greatest(F.lit(0), a["d"] - 1)).alias("d"), F.when(x == "{", F.greatest(a["m"], a["d"] + 1)).otherwise(a["m"]).alias("m"))
    written = F.filter(F.split(source, LINE_ENDS), lambda x: stripped(x) != "")
    indent = F.array_max(F.transform(written, lambda x: F.floor((F.length(x) - F.length(F.ltrim(x))) / 4).cast("int")))
    return F.greatest(F.aggregate(marks, start, step, lambda a: a["m"]), F.coalesce(indent, F.lit(0)))


def structure(source: Column) -> Column:
    """A struct of ``stats`` (the fifteen counts of ``STRUCT_NAMES``), ``identifiers`` (sorted, at most 120), sorted
    ``dependencies`` and ``imports``; word boundaries are those of Unicode. Null is as empty."""
    s = F.coalesce(source, F.lit(""))
    whole = "(?mdU)" + "|".join(FUNCTION_LINES)
    named = lambda m: F.coalesce(*(F.nullif(F.regexp_extract(m, f"(?mdU){p}", 1), F.lit("")) for p in FUNCTION_LINES))
    words = F.regexp_extract_all(s, F.lit(r"(?U)\b[A-Za-z_][A-Za-z0-9_]{2,}\b"), F.lit(0))
    last = F.element_at(F.split(s, LINE_ENDS), -1)
    parts = F.struct(
        F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(whole), F.lit(0)), named)).alias("functions"), F.size(F.array_distinct(F.regexp_extract_all(s, F.lit(CLASS_LINES), F.lit(1)))).alias("classes"), count(s, r"(?U)\b(for|while|do)\b").alias("loops"),
        count(s, r"(?U)\b(if|switch|case|elif|else\s+if)\b").alias("branches"), F.size(F.filter(F.regexp_extract_all(s, F.lit(rf"(?U)\b({NAME})\s*\("), F.lit(1)), lambda x: ~x.isin(*KEYWORDS))).alias("calls"), F.regexp_extract_all(s, F.lit(IMPORT_LINES), F.lit(0)).alias("imports"),
        count(s, r"(?U)\breturn\b").alias("returns"), nesting(s).alias("depth"), (F.size(F.split(s, LINE_ENDS)) - F.when(last == "", 1).otherwise(0)).alias("lines"), F.array_sort(F.array_distinct(F.filter(words, lambda x: ~x.isin(*KEYWORDS)))).alias("identifiers"), s.alias("source"),
    )

    def told(p: Column) -> Column:
        calls_itself = F.exists(p["functions"], lambda f: F.length(p["source"]) - F.length(F.replace(p["source"], F.concat(f, F.lit("(")))) >= 2 * (F.length(f) + 1))
        needed = F.array_sort(F.array_distinct(F.filter(F.transform(p["imports"], dependency), lambda x: x != "")))
        n = F.size(p["identifiers"])
        letters = F.aggregate(p["identifiers"], F.lit(0), lambda a, x: a + F.length(x))
        counts = (F.size(p["functions"]), p["classes"], F.lit(0), p["loops"], p["branches"], p["calls"], F.size(p["imports"]), p["returns"], p["depth"], p["lines"], n, calls_itself, 1 + p["loops"] + p["branches"], F.when(n > 0, letters / n).otherwise(0.0), F.size(needed))
        return F.struct(F.struct(*(c.alias(x) for x, c in zip(STRUCT_NAMES, counts, strict=True))).alias("stats"), F.slice(p["identifiers"], 1, 120).alias("identifiers"), needed.alias("dependencies"), p["imports"].alias("imports"))

    return F.get(F.transform(F.array(parts), told), F.lit(0))


def code_summary(path: Column, made: Column) -> Column:
    """A line about a piece of code from its ``structure``: counts, first identifiers and dependencies."""
    counts = (("functions", "num_functions"), ("classes", "num_classes"), ("loops", "num_loops"), ("branches", "num_branches"), ("calls", "num_calls"), ("imports", "num_imports"), ("depth", "max_depth"), ("cyclomatic_proxy", "cyclomatic_proxy"))
    told = F.concat_ws(", ", *(F.concat(F.lit(f"{n}="), made["stats"][c].cast("string")) for n, c in counts))
    some = lambda xs, n, none: F.when(F.size(xs) > 0, F.array_join(F.slice(xs, 1, n), ", ")).otherwise(none)
    return F.concat(path, F.lit(": "), told, F.lit("; top_identifiers=["), some(made["identifiers"], 6, "n/a"), F.lit("], dependencies=["), some(made["dependencies"], 4, "none"), F.lit("]"))


def parse_code(files: DataFrame, most: int = 1400, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per chunk of (path, source): index, title, content, tags; the i-th function or class names the i-th chunk."""
    f = code_facts(F.col("source"))
    named = files.select("*", F.concat(f["functions"], f["classes"]).alias("names"), f["complexityHint"].alias("hint"), text.detect_language(F.col("path")).alias("language"))
    each = named.select(*keep, "path", "names", "hint", "language", F.posexplode(text.fixed_chunks(F.col("source"), most)).alias("i", "content"))
    anchor = F.coalesce(F.get("names", F.col("i")), text.basename(F.col("path")))
    return each.select(*keep, "path", "i", F.concat(anchor, F.lit(" ["), (F.col("i") + 1).cast("string"), F.lit("]")).alias("title"), text.redact(F.col("content")).alias("content"), F.array("language", F.concat(F.lit("file:"), "path")).alias("tags"), F.when(F.size("names") > 0, 0.72).otherwise(0.58).alias("importance"), F.lit(0.7).alias("confidence"), hashing.stable_id("code", F.col("path"), F.col("i"), F.col("content")).alias("id"))


def pair_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, prompt, response): each user message with the assistant's right after it.

    Other roles and blank messages don't count. An unanswered prompt has an empty response, an answer that doesn't
    follow a prompt an empty prompt; ``turn`` is that of the prompt, if there is one.
    """
    t = turns.select("conv_id", "turn", F.lower(text.trim(F.col("role"))).alias("role"), text.trim(F.col("text")).alias("text")).where("role IN ('user', 'assistant') AND text <> ''")
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    p = t.withColumns({"before": F.lag("role").over(w), "after": F.lead("role").over(w), "reply": F.lead("text").over(w)})
    asked = F.col("role") == "user"
    kept = p.where(asked | F.col("before").isNull() | (F.col("before") == "assistant"))
    answer = F.when(F.col("after") == "assistant", F.col("reply")).otherwise("")
    return kept.select("conv_id", "turn", F.when(asked, F.col("text")).otherwise("").alias("prompt"), F.when(asked, answer).otherwise(F.col("text")).alias("response"))


# Title, tags and scores of a chat turn, and how many of its files are tags.
CHAT_TITLE, CHAT_TAGS, CHAT_FILES = "Copilot Interaction", ("copilot", "chat"), 25


def chat_memories(turns: DataFrame, project: str | Column = "default", ref: str = "conv_id") -> DataFrame:
    """Turns (``ref``, turn, prompt, response, and timestamp and files if there are any) as redacted memories."""
    project = F.lit(project) if isinstance(project, str) else project
    prompt, response = text.redact(F.col("prompt")), text.redact(F.col("response"))
    source = F.col(ref).cast("string")
    at = F.col("timestamp") if "timestamp" in turns.columns else F.lit(None)
    files = F.transform(F.slice("files", 1, CHAT_FILES), lambda f: F.concat(F.lit("file:"), text.trim(F.regexp_replace(f, r"\\", "/")))) if "files" in turns.columns else F.array().cast("array<string>")
    made = turns.withColumns({"__p": prompt, "__r": response}).where("__p <> '' OR __r <> ''")
    return made.select(
        hashing.stable_id("chat", project, source, F.col("turn"), at, F.col("prompt"), F.col("response")).alias("id"), project.alias("projectId"), F.lit("chat_turn").alias("kind"), F.lit("chat").alias("sourceType"), F.lit(CHAT_TITLE).alias("title"),
        text.cut(F.when(F.col("__p") != "", F.col("__p")).otherwise(F.col("__r")), 240).alias("summary"), text.trim(F.concat("__p", F.lit("\n\n---\n\n"), "__r")).alias("content"),
        F.slice(F.array_distinct(F.concat(F.array(*map(F.lit, CHAT_TAGS), F.concat(F.lit("chat-file:"), source)), files)), 1, 24).alias("tags"), F.lit(0.65).alias("importance"), F.lit(0.75).alias("confidence"), source.alias("sourceRef"),
    )


def fingerprints(sources: DataFrame, most: int = 1400, version: str = "ingest-v2") -> DataFrame:
    """contentHash of each source and the settings that it was cut with."""
    return sources.withColumn("contentHash", F.sha1(F.concat(F.lit(f"{version}|code|maxChunkChars:{most}|"), "source"))).withColumn("ingestVersion", F.lit(version))


def changed_sources(new: DataFrame, old: DataFrame, keys: tuple[str, ...] = ("projectId", "sourceRef")) -> DataFrame:
    """new, unchanged or changed, against the stored fingerprints."""
    o = old.select(*keys, F.col("contentHash").alias("oldHash"))
    state = F.when(F.col("oldHash").isNull(), "new").when(F.col("oldHash") == F.col("contentHash"), "unchanged").otherwise("changed")
    return new.join(o, list(keys), "left").withColumn("state", state)


def stale(existing: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that this run hasn't produced again."""
    return existing.join(current.select(*keys).distinct(), keys, "left_anti")


# Syntax nodes by what they stand for.
NODE_KINDS = {
    "method": ("method_definition",), "loop": ("for_statement", "while_statement", "do_statement", "for_in_statement", "for_of_statement"), "branch": ("if_statement", "switch_statement", "conditional_expression", "ternary_expression"),
    "function": ("function_declaration", "function_definition", "arrow_function"), "interface": ("interface_declaration",), "class": ("class_declaration",), "struct": ("struct_specifier",), "module": ("program", "translation_unit"),
}


def classify_node(kind: Column) -> Column:
    """What a syntax node stands for; null for others."""
    return F.coalesce(*(F.when(kind.isin(*nodes), name) for name, nodes in NODE_KINDS.items()))


def entity_summary(kind: Column, name: Column, signature: Column, hint: Column, dependencies: Column, preview: Column) -> Column:
    """Five lines about an entity; at most 8 dependencies and 180 characters of its text."""
    listed = F.array_join(F.slice(dependencies, 1, 8), ", ")
    return F.concat_ws("\n", F.concat(F.upper(kind), F.lit(" "), name), F.concat(F.lit("signature: "), signature), F.concat(F.lit("complexity: "), hint), F.concat(F.lit("dependencies: "), F.when(listed == "", "none").otherwise(listed)), F.concat(F.lit("preview: "), text.cut(text.compact(preview), 180)))


ENTITY = "path string, kind string, name string, signature string, complexityHint string, dependencies array<string>, startLine int, endLine int, startIndex int, endIndex int, sourceHash string, id string, preview string, tokens int"


def entities(files: DataFrame) -> DataFrame:
    """The entities of files (path, source): functions, methods, classes, interfaces, structs, loops and branches of
    TypeScript and C++, functions of Python, else the module; with signature, what they call (at most 16), a hint of
    their complexity, places, hashes and a ``summary``. Blank files have none; see ``functions.lexing``."""
    told = files.select("path", "source", text.detect_language(F.col("path")).alias("language"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in ENTITY.split(", ")]
        out: list[dict] = []
        for p in parts:
            for path, source, language in zip(p["path"], p["source"], p["language"], strict=True):
                out += [{"path": path} | e for e in lexing.entities(path or "", source, language)]
                if len(out) > 1000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        yield pd.DataFrame(out, columns=columns)

    made = told.mapInPandas(run, ENTITY)
    return made.withColumn("summary", entity_summary(F.col("kind"), F.col("name"), F.col("signature"), F.col("complexityHint"), F.col("dependencies"), F.col("preview")))


def feature_vector(stats: Column, n: int = len(STRUCT_NAMES)) -> Column:
    """The structural counts in their order as floats, cut or filled with zeros to ``n``."""
    each = F.array(*(stats[c].cast("float") for c in STRUCT_NAMES))
    return F.slice(F.concat(each, F.array_repeat(F.lit(0.0).cast("float"), n)), 1, n)


#: Buckets of hashes in which the order of pairs is made; a fixed number, so that no setting changes the pairs.
PAIR_BUCKETS = 4096


def training_pairs(chunks: DataFrame, key: str = "id", seed: int = 42) -> DataFrame:
    """(left, right, label): each chunk with its own summary at 0.92, and with the summary of the next chunk in a
    seeded ring of hashes at 0.08; a single chunk has no other. Neighbours are found by buckets of hashes, and the
    last chunk of a bucket goes on with the first of the next one that has any."""
    own = chunks.select(F.col("text").alias("left"), F.col("summary").alias("right"), F.lit(0.92).alias("label"))
    h = F.xxhash64(F.lit(seed), key)
    bucketed = chunks.select("text", "summary", h.alias("h")).withColumn("b", F.pmod(F.col("h"), F.lit(PAIR_BUCKETS)))
    order = ("h", "text", "summary")
    firsts = bucketed.groupBy("b").agg(F.min(F.struct(*order)).alias("f"), F.count("*").alias("n")).select("b", F.struct("f.summary").alias("first"), "n")
    ring, whole = Window.orderBy("b"), Window.partitionBy()  # at most a row per bucket
    after = firsts.select("b", F.coalesce(F.lead("first").over(ring), F.min_by("first", "b").over(whole)).alias("first"), F.sum("n").over(whole).alias("total"))
    following = F.lead(F.struct(*order)).over(Window.partitionBy("b").orderBy(*order))
    linked = bucketed.withColumn("following", following).join(F.broadcast(after), "b").where("total > 1")
    other = linked.select(F.col("text").alias("left"), F.when(F.col("following").isNotNull(), F.col("following.summary")).otherwise(F.col("first.summary")).alias("right"), F.lit(0.08).alias("label"))
    return own.unionByName(other)


#: Columns that ingestion writes of a memory.
INGESTED = ("id", "projectId", "kind", "sourceType", "title", "summary", "content", "tags", "importance", "confidence", "sourceRef")


def run_ingestion(files: DataFrame, stored: DataFrame, memories: DataFrame, policy, now: int, force: bool = False, chats: DataFrame | None = None) -> dict[str, DataFrame]:
    """memories, fingerprints and one-row report after reading code (projectId, path, bytes, source) and chats (projectId,
    path, value) under a policy.

    Sources whose fingerprint is stored are skipped unless forced; chunks and turns are redacted and stored; what a
    source that was read no longer has is removed. Files that are too large count as scanned, and chats that can't be
    parsed as errors. ``memories`` have ``INGESTED`` and any other columns.
    """
    from ..sources.chat import chat_turns, readable
    from ..sources.policy import extensions, path_matches
    from .records import upsert_fingerprints
    from .temporal import merge_rows

    found = files.where(path_matches(F.col("path"), policy.include, policy.exclude))
    if policy.languages:
        found = found.where(text.extension(F.col("path")).isin(*extensions(policy.languages)[0]))
    read = found.where(F.col("bytes") <= policy.max_file_bytes).withColumnRenamed("path", "sourceRef").withColumn("sourceType", F.lit("code"))
    prints = fingerprints(read)
    keys = ("projectId", "sourceType", "sourceRef")
    code = changed_sources(prints, stored, keys)
    code_work = code if force else code.where("state <> 'unchanged'")
    chunks = parse_code(code_work.select("projectId", F.col("sourceRef").alias("path"), "source"), keep=("projectId",))
    facts = F.concat(F.lit("chunk "), (F.col("i") + 1).cast("string"), F.lit(" of "), "path")
    fresh = chunks.select("id", "projectId", F.lit("code_entity").alias("kind"), F.lit("code").alias("sourceType"), "title", facts.alias("summary"), "content", "tags", "importance", "confidence", F.col("path").alias("sourceRef"))
    none = chats if chats is not None else files.select("projectId", "path", F.lit("").alias("value")).limit(0)
    talk = none.withColumnRenamed("path", "sourceRef").withColumns({"sourceType": F.lit("chat"), "contentHash": F.sha1(F.concat(F.lit("ingest-v2|chat|"), "value")), "ingestVersion": F.lit("ingest-v2")})
    talk = changed_sources(talk, stored, keys)
    talk_work = (talk if force else talk.where("state <> 'unchanged'")).withColumn("fine", readable(F.col("sourceRef"), F.col("value")))
    turns = chat_turns(talk_work.where("fine"), "sourceRef", "value").withColumnRenamed("path", "ref").join(talk_work.select(F.col("sourceRef").alias("ref"), F.col("projectId").alias("project")), "ref")
    said = chat_memories(turns, F.col("project"), "ref")
    every = fresh.unionByName(said.select(*INGESTED))
    done = code_work.select(*keys).unionByName(talk_work.where("fine").select(*keys))
    touched = memories.join(done.distinct(), list(keys), "left_semi")
    gone = stale(touched, every, ["id"])
    left = memories.join(gone.select("id"), "id", "left_anti")
    one = [
        found.agg(F.count("*").alias("filesScanned")), code.agg(F.count_if(F.lit(not force) & (F.col("state") == "unchanged")).alias("codeFilesSkippedUnchanged")),
        talk.agg(F.count("*").alias("chatFilesScanned"), F.count_if(F.lit(not force) & (F.col("state") == "unchanged")).alias("chatFilesSkippedUnchanged")),
        fresh.agg(F.count("*").alias("codeChunks")), said.agg(F.count("*").alias("chatTurns")),
        gone.agg(F.count("*").alias("staleMemoriesRemoved"), F.count_if(F.col("sourceType") == "code").alias("staleCodeMemoriesRemoved"), F.count_if(F.col("sourceType") == "chat").alias("staleChatMemoriesRemoved")),
        talk_work.agg(F.sort_array(F.collect_list(F.when(~F.col("fine"), F.concat(F.lit("chat:"), "sourceRef")))).alias("errors")),
    ]
    report = reduce(DataFrame.crossJoin, one).withColumns({"memoriesStored": F.col("codeChunks") + F.col("chatTurns"), "ingestVersion": F.lit("ingest-v2"), "skipUnchanged": F.lit(not force)})  # one row each
    kept_prints = prints.select(*keys, "contentHash", "ingestVersion").unionByName(talk_work.where("fine").select(*keys, "contentHash", "ingestVersion")).unionByName(talk.where("state = 'unchanged'").select(*keys, "contentHash", "ingestVersion")).distinct()
    stamped = every.withColumns({"createdAt": F.lit(now), "lastAccessedAt": F.lit(now)})
    return {"memories": merge_rows(left, stamped, ["id"]), "fingerprints": upsert_fingerprints(stored, kept_prints, now), "report": report}
