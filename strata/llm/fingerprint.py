"""Quartile bucket digests of texts.

Every byte triplet of a text (three consecutive bytes, and two spread over a window of five) is hashed into
one of 256 buckets; each bucket is coded by the quartile its count falls in, two bits a bucket. With the
length on a logarithmic scale and a checksum byte that makes the digest. Digests are compared by a bounded
difference: bucket codes by their distance (3 apart counts double), the length code with a limited weight.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import columns_of, parts_of, pieces, text_batches

BUCKETS = 256
#: The most the length codes may add to a difference, and the most bucket codes can.
LENGTH_CAP = 60
WORST = 6 * BUCKETS + LENGTH_CAP


def permutation(seed: int) -> np.ndarray:
    """A fixed permutation of the bytes, made by a linear congruential shuffle."""
    out, state = list(range(256)), seed
    for i in range(255, 0, -1):
        state = (state * 1103515245 + 12345) & 0x7FFFFFFF
        j = state >> 8
        out[i], out[j % (i + 1)] = out[j % (i + 1)], out[i]
    return np.array(out, np.uint8)


MIX = permutation(7)
#: Bucket of two hashed bytes' exclusive or; pair table for the first two bytes of a triplet.
PAIR = MIX[MIX[np.arange(256)][:, None] ^ np.arange(256)[None, :]].ravel()
#: Bytes counted at a time, so that long texts need little memory.
CHUNK = 1 << 16


def bucket_counts(data: bytes) -> np.ndarray:
    """How often triplets fall in each bucket, over the whole text."""
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(1, len(data) - 2), CHUNK):
        x = np.frombuffer(data[at : at + CHUNK + 4], np.uint8)
        n = min(CHUNK, len(x) - 2)
        if n <= 0:
            break
        pair = PAIR[x[:-1].astype(np.uint16) * 256 + x[1:]]  # of neighbours
        total += np.bincount(MIX[pair[:n] ^ x[2 : n + 2]], minlength=BUCKETS)
        m = min(CHUNK, len(x) - 4)
        if m > 0:
            total += np.bincount(MIX[pair[:m] ^ x[4 : m + 4] ^ 0x5A], minlength=BUCKETS)
    return total


def digest(text: str | None) -> str:
    """Hexadecimal: 1 byte of checksum, 1 of length, 64 of bucket quartiles. Null as the empty text."""
    data = (text or "").encode()
    counts = bucket_counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = codes.reshape(-1, 4) @ np.array([64, 16, 4, 1], np.uint8)
    length = min(255, round(math.log(len(data) + 1) * 12))
    return bytes([hashlib.sha256(data).digest()[0], length]).hex() + packed.astype(np.uint8).tobytes().hex()


def codes_of(fingerprint: str) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return int(raw[1]), (raw[2:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).ravel()


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray], same: bool) -> float:
    """1 - difference / the largest possible difference; 1 for equal digests."""
    if same:
        return 1.0
    apart = np.abs(a[1].astype(np.int8) - b[1].astype(np.int8))
    length = min(LENGTH_CAP, 2 * max(0, abs(a[0] - b[0]) - 1))
    return 1.0 - min(WORST, 1 + int(apart.sum()) + 3 * int((apart == 3).sum()) + length) / WORST


def compare(a: str, b: str) -> float:
    """Likeness of two digests, 0 to 1."""
    return likeness(codes_of(a), codes_of(b), a == b)


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, fingerprint of every row; null texts as empty; equal texts have equal fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 512):
            texts = columns_of(batch, "text")[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x or "") for x in texts], pa.int64()), pa.array([digest(x) for x in texts])], ["key", "n_chars", "fingerprint"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_chars long, fingerprint string").withColumnRenamed("key", key)


def edited_text(text: str, following: str) -> str:
    """The last third replaced by as many characters of the following text, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


#: Bytes of texts that a run of neighbouring rows should have, and the most runs there are.
RUN_BYTES, MOST_RUNS = 128 << 20, 1 << 16


def literal(values: list, kind: str) -> Column:
    """A constant array."""
    return F.expr(f"from_json('{json.dumps(values)}', '{kind}')")


def count_below(edges: list[int], key: Column) -> Column:
    """How many of the sorted ``edges`` are less than ``key``, found in two steps of about the root of their number."""
    g = max(1, math.isqrt(len(edges)))
    groups = [edges[i : i + g] for i in range(0, len(edges), g)]
    below = lambda a: F.size(F.filter(a, lambda e: e < key))
    at = below(literal([x[-1] for x in groups], "array<bigint>"))
    return at * g + F.coalesce(below(F.get(literal(groups, "array<array<bigint>>"), at)), F.lit(0))


def edit_likeness(documents: DataFrame, key: str = "doc_id", text: str = "text", partitions: int | None = None, run_bytes: int = RUN_BYTES) -> DataFrame:
    """One row per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Rows are ordered by descending ``key`` (null keys last; rows of one key by a hash of their text). Each is
    compared with its edited text, whose last third comes from the next row, and with the next row; the last
    row's next is the first. Texts travel once: rows go to runs of neighbouring rows, whose number follows from
    their bytes, and the first row of each run also to the run before. A key of many rows has runs of its own;
    only rows equal in key and text are never parted, and a task streams through its run. A single row is its own
    next. Null texts are empty, texts of any length are used whole; an empty table gives no rows; other columns
    are ignored. Keys are integers.
    """
    documents = text_batches(documents)
    spark = documents.sparkSession
    parallel = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = documents.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    sizes = whole.select("key", (F.octet_length("text") + 1).cast("long").alias("bytes"))
    total = sizes.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    n = min(MOST_RUNS, max(parallel, -(-total // run_bytes)))
    bounds = sizes.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10 * n).alias("b")).first()["b"] if n > 1 else []
    large = max(run_bytes, 4 * total // n)
    heavy = {r["key"]: min(MOST_RUNS, -(-r["b"] // run_bytes)) for r in sizes.groupBy("key").agg(F.sum("bytes").alias("b")).where(F.col("b") > large).collect()}  # fewer than n
    parts_of_null = heavy.pop(None, 1)
    edges = sorted({*(bounds or []), *heavy, *(k - 1 for k in heavy)})
    # place 0 has the largest keys; a heavy key lies alone between two edges, null keys after all others
    place = (F.lit(len(edges)) - count_below(edges, F.col("key"))) if edges else F.lit(0)
    place = F.when(F.col("key").isNull(), F.lit(len(edges) + 1)).otherwise(place)
    keys = sorted(heavy)
    part_count = F.coalesce(F.get(literal([heavy[k] for k in keys], "array<int>"), F.array_position(literal(keys, "array<bigint>"), F.col("key")).cast("int") - 1), F.lit(1)) if keys else F.lit(1)
    part_count = F.when(F.col("key").isNull(), F.lit(parts_of_null)).otherwise(part_count)
    part = F.least(part_count - 1, F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * part_count).cast("int"))
    placed = whole.withColumn("to", place.cast("long") * MOST_RUNS + F.greatest(F.lit(0), part))
    # the first row of each run: its largest key, then its least hash
    firsts = placed.groupBy("to").agg(F.min(F.struct((-F.col("key")).alias("k"), "h")).alias("f")).orderBy("to").collect()  # a row per run
    runs = [r["to"] for r in firsts]
    before = [(r["to"], runs[i - 1], None if r["f"]["k"] is None else -r["f"]["k"], r["f"]["h"]) for i, r in enumerate(firsts)]
    copies = spark.createDataFrame(before, "to long, previous long, first_key long, first_h long")
    first = placed.join(F.broadcast(copies), "to").where(F.col("key").eqNullSafe(F.col("first_key")) & (F.col("h") == F.col("first_h"))).dropDuplicates(["to"])
    both = placed.select("key", "text", "h", "to", F.lit(False).alias("copy")).unionByName(first.select("key", "text", "h", F.col("previous").alias("to"), F.lit(True).alias("copy")))
    dealt = both.repartition(max(parallel, len(runs)), "to").sortWithinPartitions("to", "copy", F.desc_nulls_last("key"), "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        held: tuple | None = None  # a row that waits for its next
        out: list[list] = [[] for _ in range(7)]

        def emit(row: tuple, after: tuple) -> None:
            edited = edited_text(row[1], after[1])
            d = digest(edited)
            c, e, f = codes_of(row[3]), codes_of(d), codes_of(after[3])
            for column, value in zip(out, (row[0], len(row[1]), hashlib.sha256(edited.encode()).hexdigest(), row[3], d, likeness(c, e, row[3] == d), likeness(c, f, row[3] == after[3])), strict=True):
                column.append(value)

        def batch_out() -> pa.RecordBatch:
            made = [pa.array(out[0], kind), pa.array(out[1], pa.int64()), *(pa.array(c, pa.string()) for c in out[2:5]), *(pa.array(c, pa.float64()) for c in out[5:])]
            for column in out:
                column.clear()
            return pa.RecordBatch.from_arrays(made, ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in pieces(batches, 256):
            kind = batch.schema.field("key").type
            for k, x, to, copy in zip(*columns_of(batch, "key", "text", "to", "copy"), strict=True):
                row = (k, x, to, digest(x))
                if held is not None and held[2] == to:
                    emit(held, row)
                held = None if copy else row
            if out[0]:
                yield batch_out()

    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])
    made = dealt.select("key", "text", "to", "copy").coalesce(parts_of(documents)).mapInArrow(run, schema)
    return made.withColumn("key", F.col("key").cast(documents.schema[key].dataType)).withColumnRenamed("key", key)
