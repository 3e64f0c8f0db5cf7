"""Stable ids and checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix, underscore and 24 hexadecimal digits of SHA-1 over the parts joined by bars; null parts are empty."""
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(joined), 1, 24))


def checksum(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 24)


def fnv1a(text: str) -> int:
    """32-bit FNV-1a over UTF-16 units."""
    h = 0x811C9DC5
    for unit in memoryview(text.encode("utf-16-le")).cast("H"):
        h = (h ^ unit) * 0x01000193 & 0xFFFFFFFF
    return h


def fnv1a_float(text: str) -> int:
    """The same in double arithmetic, whose products lose bits beyond 53, as stream checksums have it."""
    h = 0x811C9DC5
    for unit in memoryview(text.encode("utf-16-le")).cast("H"):
        signed = (h ^ unit) & 0xFFFFFFFF
        signed -= (signed >> 31) << 32  # exclusive or gives a signed 32-bit number
        h = int(float(signed) * 16777619.0) & 0xFFFFFFFF
    return h
