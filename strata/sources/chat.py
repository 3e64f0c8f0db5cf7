"""Chat transcripts: finding the files of a workspace, reading them, and their turns."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Where transcripts lie in a workspace's storage, their extensions, and parts of an answer that aren't text.
TRANSCRIPT_FOLDERS = ("chatSessions", "GitHub.copilot-chat/transcripts", "ms-vscode.copilot-chat/transcripts")
EXTENSIONS = (".json", ".jsonl")
NO_ANSWER = ("thinking", "preparetoolinvocation", "toolinvocationserialized", "texteditgroup", "mcpserversstarting")

# The names under which a thing is sought, the first that has text wins.
LISTS = ("requests", "messages", "turns", "events", "items")
PROMPT_NAMES, PROMPT_NAMES_OF_ITEM = ("prompt", "request", "user", "input"), ("prompt", "request", "user")
ANSWER_NAMES, ANSWER_NAMES_OF_ITEM = ("response", "answer", "assistant", "output"), ("response", "answer", "assistant")
TEXT_NAMES, PART_NAMES = ("text", "prompt", "message", "content", "body", "value"), ("value", "text", "content", "message")
CONTENT_NAMES, CONTENT_NAMES_OF_ITEM = ("content", "message", "text", "body"), ("content", "message", "text")
FILE_NAMES, REF_NAMES = ("files", "references", "attachments"), ("path", "file", "uri")
TIMES = ("timestamp", "time")


def string(value: object) -> str:
    return value.strip() if isinstance(value, str) else ""


def named(record: dict, names: tuple[str, ...]) -> str:
    return next(filter(None, (string(record.get(n)) for n in names)), "")


def lines(values: Iterator[str]) -> str:
    return "\n".join(dict.fromkeys(filter(None, (v.strip() for v in values))))


def said(value: object) -> str:
    """The text of a prompt: a string, a record with one, or a record of parts."""
    if not isinstance(value, dict):
        return string(value)
    parts = value.get("parts")
    return named(value, TEXT_NAMES) or (lines(map(said, parts)) if isinstance(parts, list) else "")


def answered(value: object) -> str:
    """The text of an answer: as a prompt's, or a list whose thoughts and tool calls don't count."""
    if isinstance(value, list):
        told = [x for x in value if isinstance(x, str) or isinstance(x, dict) and string(x.get("kind")).lower() not in NO_ANSWER]
        return lines(x if isinstance(x, str) else named(x, PART_NAMES) or said(x.get("message")) for x in told)
    if isinstance(value, dict):
        return next(filter(None, (answered(value.get(n)) for n in ("response", "answer", "output"))), "") or said(value)
    return string(value)


def moment(value: object) -> float | None:
    """Epoch milliseconds from a number, a string of one, or a date."""
    if isinstance(value, bool) or not isinstance(value, int | float | str):
        return None
    try:
        number = float(value) if string(value) or not isinstance(value, str) else math.nan
    except ValueError:
        try:
            at = datetime.fromisoformat(string(value))
        except ValueError:
            return None
        number = (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000
    return number if math.isfinite(number) else None


def strings(value: object) -> list[str]:
    if isinstance(value, list):
        return [s for v in value for s in strings(v)]
    if isinstance(value, dict):
        return [s for n in REF_NAMES if (s := string(value.get(n)))]
    return [s] if (s := string(value)) else []


def from_log(records: list[dict]) -> list[dict]:
    """The requests that a log of events has built up: whole ones under ``v``, later fields by ``k`` (requests, index, field)."""
    requests: dict[int, dict] = {}
    for r in records:
        whole = r.get("v")
        if isinstance(whole, dict) and isinstance(whole.get("requests"), list):
            for i, x in enumerate(whole["requests"]):
                if isinstance(x, dict):
                    requests[i] = requests.get(i, {}) | x
        at = r.get("k")
        if isinstance(at, list) and len(at) >= 3 and str(at[0]) == "requests" and str(at[1]).isdigit() and str(at[2]) in ("response", "message", *TIMES):
            requests.setdefault(int(at[1]), {})[str(at[2])] = r.get("v")
    return [requests[i] for i in sorted(requests)]


def items_of(raw: object) -> list[dict]:
    if isinstance(raw, list):
        records = [r for r in raw if isinstance(r, dict)]
        return from_log(records) or records
    if not isinstance(raw, dict):
        return []
    found = next((raw[n] for n in LISTS if isinstance(raw.get(n), list)), [raw])
    return [r for r in found if isinstance(r, dict)]


def role_of(item: dict, inner: dict) -> str | None:
    kind = f"{string(item.get('type'))} {string(inner.get('type'))}".lower()
    role = string(inner.get("role")).lower()
    return next((r for r in ("user", "assistant") if r in kind), role if role in ("user", "assistant") else None)


def item_of(item: dict) -> tuple[str | None, str, str, float | None, list[str]]:
    """(kind, prompt, response, time, files): a ``turn`` has either or both texts, a message of a ``user`` or
    ``assistant`` one; kind is None for what is neither."""
    inner = item["data"] if isinstance(item.get("data"), dict) else item
    at = next((t for r in (inner, item) for n in TIMES if (t := moment(r.get(n))) is not None), None)
    files = [s for n in FILE_NAMES for r in (inner, item) for s in strings(r.get(n))]
    prompt = named(inner, PROMPT_NAMES) or said(inner.get("message")) or named(item, PROMPT_NAMES_OF_ITEM) or said(item.get("message"))
    response = named(inner, ANSWER_NAMES) or next(filter(None, (answered(inner.get(n)) for n in ("response", "answer", "output"))), "") or named(item, ANSWER_NAMES_OF_ITEM) or answered(item.get("response")) or answered(item.get("answer"))
    if prompt or response:
        return "turn", prompt, response, at, files
    role, content = role_of(item, inner), named(inner, CONTENT_NAMES) or named(item, CONTENT_NAMES_OF_ITEM)
    if not role or not content:
        return None, "", "", at, files
    return (role, content, "", at, files) if role == "user" else (role, "", content, at, files)


def turns_of(raw: object) -> list[tuple[str, str, float | None, list[str]]]:
    """(prompt, response, time, files) of a session: items that have both or either by themselves, else messages by
    role, where an answer belongs to the prompt before it; unanswered prompts and answers without a prompt stay."""
    turns: list[tuple[str, str, float | None, list[str]]] = []
    waiting: tuple[str, float | None, list[str]] | None = None

    def unanswered() -> None:
        if waiting:
            turns.append((waiting[0], "", *waiting[1:]))

    for kind, prompt, response, at, files in map(item_of, items_of(raw)):
        if kind == "turn":
            turns.append((prompt, response, at, files))
            waiting = None
        elif kind == "user":
            unanswered()
            waiting = (prompt, at, files)
        elif kind == "assistant" and waiting:
            turns.append((waiting[0], response, waiting[1] if at is None else at, list(dict.fromkeys([*waiting[2], *files]))))
            waiting = None
        elif kind == "assistant":
            turns.append(("", response, at, files))
    unanswered()
    return turns


def parsed(path: str, raw: str) -> object:
    """The JSON of a transcript; of ``.jsonl`` a list of the lines that are JSON. Broken documents are None."""
    try:
        if not path.lower().endswith(".jsonl"):
            return json.loads(raw)
    except ValueError:
        return None
    out = []
    for line in raw.splitlines():
        try:
            out.append(json.loads(line))
        except ValueError:
            continue
    return out


def readable(path: Column, value: Column) -> Column:
    """Whether a transcript can be parsed."""

    @F.pandas_udf("boolean")
    def run(names: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([parsed(n or "", v or "") is not None for n, v in zip(names, values, strict=True)], dtype="bool")

    return run(path, value)


def chat_turns(files: DataFrame, path: str = "path", value: str = "value") -> DataFrame:
    """(path, turn, prompt, response, timestamp, files) of whole transcripts, one per row; broken ones have none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for name, raw in zip(p["path"], p["value"], strict=True):
                for i, (prompt, response, at, refs) in enumerate(turns_of(parsed(name or "", raw or ""))):
                    out.append((name, i, prompt, response, None if at is None else int(at), refs))
            yield pd.DataFrame(out, columns=["path", "turn", "prompt", "response", "timestamp", "files"]).astype({"timestamp": "Int64"})

    return files.select(F.col(path).alias("path"), F.col(value).alias("value")).mapInPandas(run, "path string, turn int, prompt string, response string, timestamp long, files array<string>")


#: What a line of a log holds: a field of a request, by its place, or an item of its own, whose place is -1.
PIECE = "path string, block long, row long, n int, request long, field string, value string"

ITEM = "path string, block long, row long, request long, kind string, prompt string, response string, timestamp long, files array<string>"


def pieces_of(line: str) -> list[tuple[int, str | None, str]]:
    """(request, field, JSON) of a line: whole requests under ``v`` field by field, with an empty field for each so that none
    is lost, a later field by its path under ``k``; and the line itself as an item."""
    try:
        r = json.loads(line)
    except ValueError:
        return []
    if not isinstance(r, dict):
        return []
    out: list[tuple[int, str | None, str]] = [(-1, None, line)]
    whole, at = r.get("v"), r.get("k")
    if isinstance(whole, dict) and isinstance(whole.get("requests"), list):
        for i, x in enumerate(whole["requests"]):
            if isinstance(x, dict):
                out += [(i, None, ""), *((i, n, json.dumps(v)) for n, v in x.items())]
    if isinstance(at, list) and len(at) >= 3 and str(at[0]) == "requests" and str(at[1]).isdigit() and str(at[2]) in ("response", "message", *TIMES):
        out.append((int(at[1]), str(at[2]), json.dumps(r.get("v"))))
    return out


def log_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, block, row, value): lines of logs of any length; block and row are in the order of the lines."""
    if not paths:
        return spark.createDataFrame([], "path string, block long, row long, value string")
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")


def log_turns(log: DataFrame) -> DataFrame:
    """(path, turn, prompt, response, timestamp, files) of logs given as lines (path, block, row, value), as
    ``chat_turns`` has them of whole ones.

    Of each field of a request the last writer counts; a log without requests has its lines as items. No log is in one
    row or one task: fields and items are rows, and answers find their prompts by ``ordered.placed``.
    """
    from ..operators.lineage import kept
    from ..operators.ordered import placed

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = [(*at, n, *piece) for *at, value in zip(p["path"], p["block"], p["row"], p["value"], strict=True) for n, piece in enumerate(pieces_of(value or ""))]
            yield pd.DataFrame(out, columns=["path", "block", "row", "n", "request", "field", "value"])

    def told(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for path, block, row, request, value, fields in zip(p["path"], p["block"], p["row"], p["request"], p["value"], p["fields"], strict=True):
                item = {f["field"]: json.loads(f["value"]) for f in fields} if fields is not None else json.loads(value)
                kind, prompt, response, at, files = item_of(item)
                if kind:
                    out.append((path, block, row, request, kind, prompt, response, None if at is None else int(at), files))
            yield pd.DataFrame(out, columns=["path", "block", "row", "request", "kind", "prompt", "response", "timestamp", "files"]).astype({"timestamp": "Int64"})

    pieces = kept(log.select("path", "block", "row", "value").mapInPandas(cut, PIECE), "log-pieces")
    fields = pieces.where("request >= 0")
    last = fields.groupBy("path", "request", "field").agg(F.max_by("value", F.struct("block", "row", "n")).alias("value"))
    named_fields = F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "value")))  # fields of one request
    requests = last.groupBy("path", "request").agg(named_fields.alias("fields"))
    nowhere = F.lit(0).cast("long")
    requests = requests.select("path", nowhere.alias("block"), nowhere.alias("row"), "request", F.lit(None).cast("string").alias("value"), "fields")
    alone = pieces.where("request < 0").join(fields.select("path").distinct(), "path", "left_anti").select("path", "block", "row", "request", "value", F.lit(None).cast("array<struct<field: string, value: string>>").alias("fields"))
    items = requests.unionByName(alone).mapInPandas(told, ITEM)
    look = ["kind", "prompt", "timestamp", "files"]
    met = placed(items, ["path"], ["request", "block", "row"], look)
    answered_next = (F.col("kind") == "user") & F.coalesce(F.col("after.kind") == "assistant", F.lit(False))
    dropped = (F.col("kind") == "user") & F.coalesce(F.col("after.kind") == "turn", F.lit(False))
    pair = (F.col("kind") == "assistant") & F.coalesce(F.col("before.kind") == "user", F.lit(False))
    made = met.where(~answered_next & ~dropped).select(
        "path", "place", F.when(pair, F.col("before.prompt")).otherwise(F.col("prompt")).alias("prompt"), "response", F.when(pair, F.coalesce("timestamp", "before.timestamp")).otherwise(F.col("timestamp")).alias("timestamp"),
        F.when(pair, F.array_distinct(F.concat("before.files", "files"))).otherwise(F.col("files")).alias("files"),
    )
    return placed(made.withColumnRenamed("place", "at"), ["path"], ["at"], ["at"]).select("path", F.col("place").cast("int").alias("turn"), "prompt", "response", "timestamp", "files")


def located(value: str, base: Path | None = None) -> Path | None:
    """An absolute folder from a path or a file URL; relative ones need a base."""
    text = value.strip()
    if text.lower().startswith("file://"):
        return Path(os.path.normpath(unquote(urlparse(text).path)))
    if not text or not (os.path.isabs(text) or base):
        return None
    return Path(os.path.normpath(base / text if base else text))


def folders_of(storage: Path) -> list[Path]:
    """The folders that a workspace's storage belongs to, by its workspace.json or the workspace file named there."""

    def read(path: Path) -> dict:
        try:
            made = json.loads(path.read_text())
        except (OSError, ValueError):
            return {}
        return made if isinstance(made, dict) else {}

    about = read(storage / "workspace.json")
    out = [located(about["folder"])] if isinstance(about.get("folder"), str) else []
    if isinstance(about.get("workspace"), str) and (file := located(about["workspace"])):
        listed = read(file).get("folders")
        for x in listed if isinstance(listed, list) else []:
            name = x.get("path") if isinstance(x, dict) else x
            out += [located(name, file.parent)] if isinstance(name, str) else []
    return [p for p in out if p]


def storage_roots(project: Path, roots: list[str]) -> list[Path]:
    env = os.environ.get
    own = [project / ".vscode" / "workspaceStorage", *(project / r for r in roots if r.strip())]  # an absolute root stays as it is
    homes = [Path(h) / ".config" for h in (env("HOME") or env("USERPROFILE"),) if h]
    return list(dict.fromkeys([*own, *(base / code / "User" / "workspaceStorage" for base in [*(Path(a) for a in (env("APPDATA"),) if a), *homes] for code in ("Code", "Code - Insiders"))]))


def discover(project: str, roots: list[str] | None = None, most: int = 400) -> list[str]:
    """Sorted paths of at most ``most`` transcripts: of workspaces whose folder is the project, above or below it; in
    a root without such a workspace, of all. Only the driver's own files are seen."""
    at = Path(os.path.abspath(project))
    key = at.as_posix().lower()
    found: dict[str, None] = {}
    for root in storage_roots(at, roots or []):
        stores = sorted(p for p in root.iterdir() if p.is_dir()) if root.is_dir() else []
        mine = [s for s in stores if any(k == key or k.startswith(key + "/") or key.startswith(k + "/") for k in (f.as_posix().lower() for f in folders_of(s)))]
        for folder in (s / t for s in mine or stores for t in TRANSCRIPT_FOLDERS):
            for f in sorted(folder.iterdir()) if folder.is_dir() else []:
                if f.suffix.lower() in EXTENSIONS and len(found) < most:
                    found[str(f)] = None
    return sorted(found)


def chat_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, value) of whole transcripts; no rows without paths."""
    if not paths:
        return spark.createDataFrame([], "path string, value string")
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
