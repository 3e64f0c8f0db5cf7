"""What column expressions can't say, as Arrow-batched functions; ``register`` makes them SQL functions."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import codec, hashing

#: Factor and modulus of the three deterministic embeddings: the core's, the package's and the service's.
EMBEDDINGS = {"core": (17, 997), "package": (13, 1009), "service": (19, 1009)}


def embed(text: str, n: int = 256, kind: str = "core") -> list[float]:
    """A vector from the characters alone: each adds ((code * (place + k)) mod m) / m to bucket place mod n; length 1."""
    k, m = EMBEDDINGS[kind]
    codes = np.frombuffer(text.encode("utf-32-le" if kind == "service" else "utf-16-le"), np.uint32 if kind == "service" else np.uint16).astype(np.int64)
    at = np.arange(len(codes))
    out = np.bincount(at % n, (codes * (at + k)) % m / m, n) if len(codes) else np.zeros(n)
    length = math.sqrt(float((out * out).sum()))
    return (out / length if length else out).tolist()


def embedding(text: Column, n: int = 256, kind: str = "core") -> Column:
    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: embed(v or "", n, kind))

    return run(text)


# Marks that join to the left, and that join to the right.
CLOSING, OPENING = set(".,!?;:)]}%"), set("([{")


def detokenize(tokens: list[str]) -> str:
    out: list[str] = []
    for t in tokens:
        if t:
            out.append(t if not out or t in CLOSING or out[-1][-1] in OPENING else " " + t)
    return "".join(out).strip()


def of_text(text: Column, f, kind: str) -> Column:
    """``f`` of each text that isn't null, in Arrow batches."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else f(v))

    return run(text)


def detokenized(tokens: Column) -> Column:
    """Texts from arrays of tokens."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else detokenize(list(v)))

    return run(tokens)


def paragraphs(text: str, most: int = 1200) -> list[str]:
    """Paragraphs packed in order into chunks of ``most`` characters; without any, slices."""
    out, now = [], ""
    for p in filter(None, (x.strip() for x in re.split(r"\n{2,}", text))):
        joined = f"{now}\n\n{p}" if now else p
        if now and len(joined) > most:
            out.append(now)
            joined = p
        now = joined
    if now:
        out.append(now)
    return out or [text[i : i + most] for i in range(0, len(text), most)]


def code_chunks(text: str, most: int = 1800, least: int = 180) -> list[str]:
    """Blocks between blank lines packed into chunks; longer blocks are sliced; chunks below ``least`` drop."""
    out, now = [], ""
    for block in filter(None, (x.strip() for x in re.split(r"\n\s*\n", text))):
        joined = f"{now}\n\n{block}" if now else block
        if len(joined) <= most:
            now = joined
            continue
        out.append(now)
        now = block if len(block) <= most else ""
        if not now:
            out += [block[i : i + most].strip() for i in range(0, len(block), most)]
    return [x for x in (*out, now) if len(x) >= least]


SECTIONS = ("concepts", "graph", "history", "constraints")


def to_cxf(intent: str, scope: str, head: str = "[CONTEXT]", **sections: list[str]) -> str:
    lines = [head, f"intent: {intent}", f"scope: {scope}"]
    for name in SECTIONS:
        rows = list(dict.fromkeys(x.strip() for x in sections.get(name) or [] if x.strip()))
        lines += [f"{name}:", *(f"  - {r}" for r in rows or ["none"])]
    return "\n".join(lines)


def from_cxf(text: str) -> dict:
    out: dict = {"intent": "", "scope": ""} | {s: [] for s in SECTIONS}
    section = None
    for line in filter(None, (x.strip() for x in text.splitlines())):
        name, colon, rest = line.partition(":")
        if colon and name in ("intent", "scope"):
            out[name], section = rest.strip(), None
        elif line[:-1] in SECTIONS and line[-1] == ":":
            section = line[:-1]
        elif line[:2] in ("- ", "• ", "* ", "+ ") and section and (value := line[2:].strip()) not in ("", "none") and value not in out[section]:
            out[section].append(value)
    return out


def depth(code: str) -> int:
    """The deepest nesting by braces or by four spaces of indent."""
    level = most = 0
    for c in re.findall(r"[{}]", code):
        level = max(0, level + (1 if c == "{" else -1))
        most = max(most, level)
    return max([most, *((len(x) - len(x.lstrip(" "))) // 4 for x in code.splitlines() if x.strip())])


def register(spark: SparkSession) -> None:
    """SQL functions: compact_memory, restore_memory, embed_text, fnv1a_float, paragraph_chunks, code_chunks, nesting_depth."""

    def series(kind: str, f):
        @F.pandas_udf(kind)
        def run(values: pd.Series) -> pd.Series:
            return values.map(lambda v: None if v is None else f(v))

        return run

    for name, kind, f in (
        ("compact_memory", "string", codec.compact), ("restore_memory", "string", lambda v: codec.analyse(v)[1]), ("embed_text", "array<double>", embed), ("fnv1a_float", "bigint", hashing.fnv1a_float),
        ("paragraph_chunks", "array<string>", paragraphs), ("code_chunks", "array<string>", code_chunks), ("nesting_depth", "int", depth),
    ):
        spark.udf.register(name, series(kind, f))
