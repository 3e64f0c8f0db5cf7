"""Agents over tables of texts, and what a model writes for them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import evolution, ngram

# What each agent is for.
AGENTS = {
    "writer": "Generate memory candidate draft from raw input.", "critic": "Score novelty and clarity of candidate memory content.", "compressor": "Compress and deduplicate text for token-efficient storage/context.",
    "planner": "Produce execution plan with constraints, risks, and ordered steps.", "refactor": "Generate refactor recommendations and validation strategy.",
}


def run_agent(texts: DataFrame, agent: str, column: str = "text", snippets: Column | None = None, context: Column | None = None, most: int = 320) -> DataFrame:
    """``texts`` with ``output``, what an agent makes of each trimmed text; blank texts have none. Unknown agents are refused.

    ``snippets`` are known texts that a critic compares with, or anchors of refactoring; ``context`` is a plan's.
    """
    if agent not in AGENTS:
        raise ValueError(f"unknown agent {agent!r}; there are {', '.join(AGENTS)}")
    body = text.trim(F.coalesce(F.col(column), F.lit("")))
    rows = texts.withColumn("__body", body)
    known = snippets if snippets is not None else F.array().cast("array<string>")
    if agent in ("planner", "refactor"):
        rows = evolution.plans(rows, "__body", context)
        plan = F.struct("intent", "objective", "strategy", "constraints", "risks", "steps")
        made = plan if agent == "planner" else F.struct(plan.alias("plan"), evolution.advice(F.col("__body")).alias("recommendations"), known.alias("snippets"))
        rows = rows.withColumn("output", F.when(F.col("__body") != "", made)).drop("intent", "objective", "strategy", "constraints", "risks", "steps")
        return rows.select(*texts.columns, "output")
    b = F.col("__body")
    if agent == "writer":
        made = F.struct(*evolution.draft(b), b.alias("content"))
    elif agent == "critic":
        novelty = evolution.overlap_novelty(b, known)
        made = F.struct(novelty.alias("novelty"), *evolution.critic(b, novelty))
    else:
        short = text.compress_agent(b, most, True)
        made = F.struct(F.length(b).alias("originalChars"), F.length(short).alias("compressedChars"), short.alias("compressed"))
    return rows.withColumn("output", F.when(b != "", made)).select(*texts.columns, "output")


def loop(texts: DataFrame, column: str = "text", context: Column | None = None) -> DataFrame:
    """``texts`` with what writer, critic, compressor, planner and refactorer make of each, one column each; nothing is written."""
    out = texts
    for agent in AGENTS:
        out = run_agent(out, agent, column, context=context).withColumnRenamed("output", agent)
    return out


def top_tags(value: str, most: int = 6) -> list[str]:
    """The most frequent words that may be tags; of equals the first."""
    counts: dict[str, int] = {}
    for t in ngram.TOKEN.findall(value.lower()):
        if len(t) <= 24 and ngram.TAG.fullmatch(t):
            counts[t] = counts.get(t, 0) + 1
    return sorted(counts, key=lambda t: -counts[t])[:most]


def cut_flat(value: str, most: int) -> str:
    """On one line, at most ``most`` characters and an ellipsis, after a phrase that ends beyond 55 % of them."""
    flat = " ".join(value.split())
    if len(flat) <= most:
        return flat
    end = max(flat[:most].rfind(m) for m in (". ", "; ", ", "))
    return (flat[: end + 1] if end > int(most * 0.55) else flat[:most]).rstrip() + "…"


def continued(model: ngram.Model | None, value: str, n: int) -> str:
    return ngram.continuation(model, value, n) if model else ""


def consolidator_output(candidate: dict, neighbors: list[dict], generated: str) -> dict:
    """A candidate with its first four neighbours' summaries and what a model added."""
    title = (candidate.get("title") or "").strip()[:180] or "Generated Memory"
    summary = (candidate.get("summary") or "").strip()[:5000] or title
    content = (candidate.get("content") or "").strip()[:24_000] or summary
    digest = " ".join(filter(None, ((n.get("summary") or "").strip()[:500] or (n.get("title") or "").strip()[:160] for n in neighbors[:4])))
    tags = list(dict.fromkeys([*(candidate.get("tags") or [])[:24], *top_tags(digest), *top_tags(generated), "consolidated"]))[:20]
    parts = [content, f"Neighbor overlap summary:\n{digest}" if digest else "", f"Model synthesis:\n{generated}" if generated else ""]
    given = candidate.get("confidence")
    confidence = min(1.0, max(0.0, 0.55 if given is None else given)) + min(0.2, len(neighbors) * 0.02 + (0.04 if generated else 0.0))
    return {"title": title, "summary": cut_flat(" ".join(filter(None, (summary, digest, generated))), 220), "content": "\n\n".join(filter(None, parts)), "tags": tags, "confidence": min(1.0, confidence)}


OUTPUT = "title string, summary string, content string, tags array<string>, confidence double"


def consolidate_candidates(rows: DataFrame, model: ngram.Model | None = None, key: str = "id") -> DataFrame:
    """Rows (``key``, candidate: struct of title, summary, content, tags, confidence; neighbors: array of structs of
    title and summary, a bounded list) as consolidated memories."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for k, c, near in zip(p["key"], p["candidate"], p["neighbors"], strict=True):
                c, near = c if isinstance(c, dict) else c.asDict(), [n if isinstance(n, dict) else n.asDict() for n in (near if near is not None else [])]
                c["tags"] = list(c["tags"]) if c.get("tags") is not None else []
                first = consolidator_output(c, near, "")
                digest = first["content"].partition("Neighbor overlap summary:\n")[2]
                made = consolidator_output(c, near, continued(model, f"{first['title']}\n{c.get('summary') or first['title']}\n{digest}", 72))
                out.append((k, *made.values()))
            yield pd.DataFrame(out, columns=["key", "title", "summary", "content", "tags", "confidence"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), "candidate", "neighbors").mapInPandas(run, f"key {kind}, {OUTPUT}").withColumnRenamed("key", key)


def write_candidates(texts: DataFrame, model: ngram.Model | None = None, key: str = "id", column: str = "text", project: str = "default") -> DataFrame:
    """A candidate for each text: its draft, and what the model goes on with."""
    d = texts.select(F.col(key).alias("key"), text.trim(F.coalesce(F.col(column), F.lit(""))).alias("body")).select("key", "body", *evolution.draft(F.when(F.col("body") == "", "generated memory candidate").otherwise(F.col("body"))))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for k, body, title, summary, tags in zip(p["key"], p["body"], p["title"], p["summary"], p["tags"], strict=True):
                more = continued(model, f"{title}\n{summary}\n{body}", 80)
                content = body or "generated memory candidate"
                out.append((k, title, cut_flat(" ".join(filter(None, (summary, more))), 220), f"{content}\n\nModel-guided continuation:\n{more}" if more else content, list(dict.fromkeys([*tags, *top_tags(more), "mini-llm"]))[:16], 0.72 if model else 0.46))
            yield pd.DataFrame(out, columns=["key", "title", "summary", "content", "tags", "confidence"])

    kind = texts.schema[key].dataType.simpleString()
    return d.mapInPandas(run, f"key {kind}, {OUTPUT}").withColumnRenamed("key", key).withColumn("sourceRef", F.lit(project))
