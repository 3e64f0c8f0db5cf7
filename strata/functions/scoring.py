"""Scores as column expressions; times in milliseconds, ``now`` always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000.0, 86_400_000.0


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def temporal_score(age_ms: Column) -> Column:
    return F.exp(F.lit(-1e-8) * F.greatest(F.lit(0), age_ms))


def hybrid_score(similarity: Column, importance: Column, age_ms: Column) -> Column:
    return F.lit(0.5) * similarity + F.lit(0.3) * clamp01(importance) + F.lit(0.2) * temporal_score(age_ms)


def contains_any(text: Column, needle: str) -> Column:
    return F.contains(F.lower(text), F.lit(needle.lower()))


def lexical_similarity(title: Column, summary: Column, content: Column, query: str) -> Column:
    """0.82 for a hit in title or summary, 0.72 in the content, else 0.6."""
    return F.when(contains_any(title, query) | contains_any(summary, query), 0.82).when(contains_any(content, query), 0.72).otherwise(0.6)


def token_similarity(title: Column, summary: Column, content: Column, query: str) -> Column:
    """Hits of the whole query by field, and the share of its words that occur anywhere."""
    import re

    from .text import tokenize_words

    words = [w for w in re.split(r"[^a-z0-9_]+", query.lower()) if len(w) > 1]
    q = query.strip().lower()
    score = F.lit(0.0)
    for field, weight in ((title, 0.45), (summary, 0.35), (content, 0.2)):
        score = score + F.when(contains_any(field, q), weight).otherwise(0.0)
    if words:
        have = tokenize_words(F.concat_ws("\n", title, summary, content))
        hits = sum((F.array_contains(have, w).cast("int") for w in words), F.lit(0))
        score = score + hits / F.lit(float(len(words))) * 0.35
    return F.least(F.lit(1.0), score)


def memory_score(importance: Column, confidence: Column, age_ms: Column, lexical: Column, same_project: Column, preferred_tags: Column) -> Column:
    recency = F.exp(F.lit(-0.06) * F.greatest(F.lit(0.0), age_ms / HOUR))
    return F.round(F.lit(0.38) * importance + F.lit(0.24) * confidence + F.lit(0.18) * recency + F.lit(0.2) * lexical + F.when(same_project, 0.06).otherwise(0.0) + F.least(F.lit(0.12), F.lit(0.04) * preferred_tags), 6)


def rerank_signal(importance: Column, confidence: Column, age_ms: Column, affinity: Column, favor_recent: bool = True) -> Column:
    recency = F.exp(F.lit(-0.07) * F.greatest(F.lit(0.0), age_ms / HOUR)) if favor_recent else F.lit(0.5)
    return F.lit(0.42) * importance + F.lit(0.28) * confidence + F.lit(0.2) * recency + F.lit(0.1) * affinity


def lexical_affinity(title: Column, summary: Column, content: Column, query: str) -> Column:
    score = sum((F.when(contains_any(c, query), w).otherwise(0.0) for c, w in ((title, 0.6), (summary, 0.3), (content, 0.1))), F.lit(0.0))
    return F.least(F.lit(1.0), score)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 where either is empty or has no length."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    length = norm(x) * norm(y)
    return F.when(length > 0, dot(x, y) / length).otherwise(0.0)


def resized(a: Column, n: int) -> Column:
    """Cut or filled with zeros to ``n``, then of length 1."""
    x = F.slice(F.concat(F.transform(a, lambda v: v.cast("double")), F.array_repeat(F.lit(0.0), n)), 1, n)
    length = norm(x)
    return F.when(length > 0, F.transform(x, lambda v: v / length)).otherwise(x)


def quantize_weight(p: Column) -> Column:
    return F.least(F.lit(127), F.greatest(F.lit(1), F.round(p * 127))).cast("int")


def link_weight(lexical: Column, dependency: Column, importance: Column) -> Column:
    return F.round(F.least(F.lit(0.98), F.lit(0.55) + F.lit(0.25) * lexical + F.lit(0.18) * dependency + F.lit(0.02) * importance), 4)


def backoff_delay(interval: Column, multiplier: float, failures: Column, cap: int, jitter: Column) -> Column:
    grown = F.least(F.lit(float(cap)), interval * F.pow(F.lit(multiplier), F.greatest(F.lit(0), failures - 1)))
    return F.greatest(F.lit(1000), F.floor(grown + jitter)).cast("long")


def project_risk(anomalies: Column, rows: Column, rate: Column, saved_percent: Column, few: int = 25, many: int = 100) -> Column:
    return F.when(anomalies > 0, "critical").when((rows >= few) & (rate < 0.5), "warning").when((rows >= many) & (saved_percent < 5), "warning").otherwise("healthy")


def in_apply_window(hour: Column, start: Column, end: Column) -> Column:
    return F.when(start == end, F.lit(True)).when(start < end, (hour >= start) & (hour < end)).otherwise((hour >= start) | (hour < end))
