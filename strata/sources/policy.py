"""Ingestion policies: which files, which languages, how large, and what is redacted."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by language.
LANGUAGES = {
    "typescript": (".ts", ".tsx"), "javascript": (".js", ".jsx"), "python": (".py",), "java": (".java",), "go": (".go",), "rust": (".rs",), "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".h"),
    "c": (".c", ".h"), "csharp": (".cs",), "ruby": (".rb",), "php": (".php",), "kotlin": (".kt", ".kts"), "swift": (".swift",),
}


def extensions(languages: list[str]) -> tuple[set[str], list[str]]:
    """Extensions of the named languages, ``.ext`` entries and shorthands of at most four characters; unknown names."""
    found: set[str] = set()
    unknown = []
    for entry in languages:
        name = entry.strip().lower()
        if not name:
            continue
        if name.startswith("."):
            found.add(name)
            continue
        name = "cpp" if name == "c++" else name
        short = re.sub("[^a-z0-9]", "", name)
        mapped = LANGUAGES.get(name) or LANGUAGES.get(short)
        if 0 < len(short) <= 4:
            found.add("." + short)
        elif not mapped:
            unknown.append(entry)
        found.update(mapped or ())
    return found, unknown


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob: ``**`` crosses folders, a pattern without a slash fits base names, case is ignored."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(map(re.escape, pattern[i + 1 : end].split(","))) + ")", end + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"(?i)^{'' if '/' in pattern else '(?:.*/)?'}{out}$"


def path_matches(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Excluded paths never; with no include globs all others."""
    path = F.regexp_replace(path, r"\\", "/")
    some = lambda globs: path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))
    ok = some(include) if include else F.lit(True)
    return ok & ~some(exclude) if exclude else ok


@dataclass
class Policy:
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    max_file_bytes: int = 786_432
    mask_secrets: bool = True
    mask_personal: bool = True
    custom: list[str] = field(default_factory=list)


def parse(text: str) -> tuple[Policy | None, list[str]]:
    """The policy of a JSON document, or what is wrong with it."""
    try:
        raw = json.loads(text)
    except ValueError as e:
        return None, [f"not JSON: {e}"]
    if not isinstance(raw, dict):
        return None, ["not an object"]
    wrong = []
    for key in ("includeGlobs", "excludeGlobs", "languages"):
        if not (isinstance(raw.get(key, []), list) and all(isinstance(x, str) for x in raw.get(key, []))):
            wrong.append(f"{key} must be a list of strings")
    size = raw.get("maxFileBytes", Policy.max_file_bytes)
    if isinstance(size, bool) or not isinstance(size, int) or size <= 0:
        wrong.append("maxFileBytes must be a positive number")
    redaction = raw.get("redaction", {})
    for pattern in redaction.get("customPatterns", []):
        try:
            re.compile(pattern)
        except re.error as e:
            wrong.append(f"custom pattern {pattern!r}: {e}")
    if wrong:
        return None, wrong
    return Policy(raw.get("includeGlobs", []), raw.get("excludeGlobs", []), raw.get("languages", []), size, redaction.get("maskSecrets", True), redaction.get("maskPII", True), redaction.get("customPatterns", [])), []
