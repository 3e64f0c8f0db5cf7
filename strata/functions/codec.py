"""The compact envelope: a prefix and base64url of JSON with a Brotli payload, a preview and a checksum."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The envelope's marks.
PREFIX, VERSION, CODEC = "memory://compact/v1/", 1, "brotli-base64"

ANALYSIS = "compacted boolean, restored string, storedChars long, originalChars long, invalidChecksum boolean, decodeError boolean"


def sha24(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def preview_of(text: str, most: int = 320) -> str:
    lines = [" ".join(x.split()) for x in text.replace("\r\n", "\n").split("\n")]
    out = " | ".join([x for x in lines if x][:6])
    return out if len(out) <= most else out[: most - 1] + "…"


def compact(text: str, least: int = 240) -> str:
    """The envelope of ``text`` if that is shorter; else the text."""
    if len(text) < least or text.startswith(PREFIX):
        return text
    payload = bytes(pa.Codec("brotli", compression_level=5).compress(text.encode()))
    body = {"v": VERSION, "codec": CODEC, "originalChars": len(text), "preview": preview_of(text), "payload": base64.b64encode(payload).decode(), "checksum": sha24(text)}
    made = PREFIX + base64.urlsafe_b64encode(json.dumps(body).encode()).decode().rstrip("=")
    return made if len(made) < len(text) else text


def envelope(content: str | None) -> dict | None:
    if not content or not content.startswith(PREFIX):
        return None
    raw = content[len(PREFIX) :]
    try:
        body = json.loads(base64.urlsafe_b64decode(raw + "=" * (-len(raw) % 4)))
    except (ValueError, binascii.Error):
        return None
    strings = ("preview", "payload", "checksum")
    ok = isinstance(body, dict) and body.get("v") == VERSION and body.get("codec") == CODEC and isinstance(body.get("originalChars"), int) and all(isinstance(body.get(k), str) for k in strings)
    return body if ok else None


def analyse(content: str | None) -> tuple[bool, str, int, int, bool, bool]:
    """(compacted, restored, stored, original, invalid checksum, decode error); broken payloads restore the preview."""
    content = content or ""
    body = envelope(content)
    if body is None:
        return False, content, len(content), len(content), False, False
    original = max(body["originalChars"], len(content))
    try:
        text = pa.CompressedInputStream(pa.py_buffer(base64.b64decode(body["payload"], validate=True)), "brotli").read().decode()
    except (OSError, ValueError, binascii.Error):
        return True, body["preview"], len(content), original, False, True
    if sha24(text) != body["checksum"]:
        return True, body["preview"], len(content), original, True, False
    return True, text, len(content), original, False, False


def analysed(df: DataFrame, content: str = "content", texts: bool = True) -> DataFrame:
    """``df`` with the analysis of its contents, in one scan; only contents with the prefix enter Python.

    Without ``texts`` neither contents nor restored texts are kept, so that only lengths and packed contents travel.
    """

    @F.pandas_udf(ANALYSIS)
    def of_packed(values: pd.Series) -> pd.DataFrame:
        rows = [analyse(v) if v else (False, None, 0, 0, False, False) for v in values]
        return pd.DataFrame(rows, columns=["compacted", "restored", "storedChars", "originalChars", "invalidChecksum", "decodeError"])

    c = F.coalesce(F.col(content), F.lit(""))
    kept = df.columns if texts else [x for x in df.columns if x != content]
    made = df.select(*kept, F.length(c).cast("long").alias("__n"), F.when(F.startswith(c, F.lit(PREFIX)), c).alias("__packed"))
    made = made.withColumn("__a", of_packed("__packed"))
    packed = F.col("__a.compacted")
    out = {"compacted": packed, "storedChars": F.col("__n"), "originalChars": F.when(packed, F.col("__a.originalChars")).otherwise(F.col("__n")), "invalidChecksum": F.col("__a.invalidChecksum"), "decodeError": F.col("__a.decodeError")}
    if texts:
        out["restored"] = F.when(packed, F.col("__a.restored")).otherwise(c)
    return made.select(*kept, *(v.alias(k) for k, v in out.items()))


def compacted(content: Column) -> Column:
    """The stored form of each content."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else compact(v))

    return run(content)
