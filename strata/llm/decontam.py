"""Benchmark decontamination by Wu-Manber search over words.

The patterns are all windows of 13 consecutive words of the benchmark's items; an item of fewer words is one
pattern. A table of shifts by the last block of words under the window skips positions where no pattern can
end; where the shift is 0, the block's bucket selects patterns, their first word is compared, then all words.
The benchmark is cut into blocks, each with tables of its own, and one scan searches a row for all of them, so
documents never meet it in a join. A benchmark whose tables exceed ``SCAN_BYTES`` takes several scans, over rows
that are numbered and written first; results don't depend on the number of blocks or scans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import checked_broadcast, columns_of, fresh, lowered, pieces, text_batches, written
from .words import forgetting

#: Runs of digits, a-z and everything beyond ASCII; for texts whose A-Z are lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


#: Bytes of benchmark text in a block, and of all tables that a scan may hold, as estimated.
BLOCK_BYTES, SCAN_BYTES = 4 << 20, 256 << 20


def words_of(text: str | None) -> list[str]:
    return WORD.findall(lowered(text)) if text else []


class WuManber:
    """Patterns are (words of an item, start, length); all of at least ``least`` words."""

    def __init__(self, patterns: list[tuple[int, int, int]], items: list[list[str]]):
        self.items = items
        self.least = least = min(n for _, _, n in patterns)
        self.block = block = min(2, least)
        self.shift: dict[str, int] = {}
        self.bucket: dict[str, list[tuple[str, int, int, int]]] = {}
        for item, start, n in patterns:
            w = items[item]
            for end in range(block, least + 1):
                b = " ".join(w[start + end - block : start + end])
                self.shift[b] = min(self.shift.get(b, least), least - end)
            self.bucket.setdefault(b, []).append((w[start], item, start, n))

    def search(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(start in words, length, item) of every occurrence of every pattern."""
        least, get, bucket, items = self.least, self.shift.get, self.bucket, self.items
        free = least - self.block + 1
        two = self.block == 2
        at, end = least - 1, len(words)
        while at < end:
            b = words[at - 1] + " " + words[at] if two else words[at]
            step = get(b, free)
            if step:
                at += step
                continue
            start = at - least + 1
            first = words[start]
            for head, item, s, n in bucket[b]:
                if head == first and words[start : start + n] == items[item][s : s + n]:
                    yield start, n, item
            at += 1


class Searcher:
    """One table for the whole windows and one for shorter items, which would spoil the shifts."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int):
        self.ids = [i for i, _ in items]
        words = [w for _, w in items]
        full = [(k, s, window) for k, w in enumerate(words) if len(w) >= window for s in range(len(w) - window + 1)]
        short = [(k, 0, len(w)) for k, w in enumerate(words) if 0 < len(w) < window]
        self.tables = [WuManber(p, words) for p in (full, short) if p]

    def hits(self, words: list[str]) -> tuple[list[list[int]], set[str]]:
        """Merged [start, end) spans of words, and the ids of the items met."""
        spans, met = [], set()
        for t in self.tables:
            for start, n, item in t.search(words):
                spans.append([start, start + n])
                met.add(item)
        return merged(spans), {self.ids[k] for k in met}


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def table_bytes(block: list[tuple[str, list[str]]]) -> int:
    """About what the tables of a block take in memory."""
    return sum(sum(map(len, ws)) + 400 * len(ws) for _, ws in block)


def benchmark_scans(benchmark: DataFrame, item: str, text: str, window: int, block_bytes: int, scan_bytes: int) -> list[list]:
    """Broadcast searchers for all blocks, grouped by scan; items without an id or words have no part.

    Each block is read, built and sent in turn: the driver holds the tables of one.
    """
    spark = benchmark.sparkSession
    total = benchmark.agg(F.sum(F.octet_length(F.col(text))).alias("n")).first()["n"] or 0
    n = max(1, -(-total // block_bytes))
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()
    scans: list[list] = [[]]
    held = 0
    for k in range(n):
        block = [(r["item"], w) for r in rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).toLocalIterator() if (w := words_of(r["text"]))]
        size = table_bytes(block)
        if scans[-1] and held + size > scan_bytes:
            scans.append([])
            held = 0
        held += size
        scans[-1].append(checked_broadcast(Searcher(block, window), size, spark, "a block of the benchmark", scan_bytes))
    return scans


def hits_of(words: list[str], searchers: list) -> tuple[list[list[int]], list[str]]:
    """What all searchers find together."""
    found = [s.value.hits(words) for s in searchers]
    if len(found) == 1:
        return found[0][0], sorted(found[0][1])
    return merged([x for spans, _ in found for x in spans]), sorted({i for _, items in found for i in items})


HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType())))])


def with_hits(rows: DataFrame, searchers: list) -> DataFrame:
    """``rows`` (one column, text) as (that column, n_words, items, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            counts, items, spans = [], [], []
            for x in columns_of(batch, "text")[0]:
                w = words_of(x)
                s, i = hits_of(w, searchers)
                counts.append(len(w))
                items.append(i)
                spans.append(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int32())))], [batch.schema.names[0], "n_words", "items", "spans"])

    return rows.mapInArrow(forgetting(run), T.StructType([rows.schema.fields[0], *HITS.fields]))


def numbered(rows: DataFrame) -> tuple[DataFrame, str]:
    """``rows`` with a number that is written, so that every scan sees the same one, and its name."""
    name = fresh(rows, "row")
    return written(rows.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def of_all_scans(rows: DataFrame, scans: list[list]) -> DataFrame:
    """``with_hits`` of numbered rows (number, text), each scan's hits put together by the number."""
    number = rows.columns[0]
    parts = [with_hits(rows, s) for s in scans]
    hits = reduce(DataFrame.unionByName, [parts[0], *(p.where(F.size("spans") > 0) for p in parts[1:])])
    lists = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")  # one of each a scan
    together = hits.groupBy(number).agg(F.first("n_words").alias("n_words"), *lists)

    def grown(done: Column, s: Column) -> Column:  # overlapping and touching spans become one
        last = F.element_at(done, -1)
        one = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.array(last[0], F.greatest(last[1], s[1]))))
        return F.when(F.size(done) == 0, F.array(s)).when(s[0] <= last[1], one).otherwise(F.concat(done, F.array(s)))

    return together.withColumn("spans", F.aggregate("spans", F.array().cast("array<array<int>>"), grown))


def n_hit(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda t, s: t + (s[1] - s[0]))


def contaminated(hit: Column, words: Column, ratio: int) -> Column:
    return (hit > 0) & (hit * ratio >= words)


def contamination(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, ratio: int = 20, block_bytes: int = BLOCK_BYTES, scan_bytes: int = SCAN_BYTES) -> DataFrame:
    """One row per row of ``documents``: key, n_words, n_hit, n_items, items_sha256, contaminated, items, spans.

    ``spans`` are the hit words as [start, end) in words. A document is contaminated if it has hit words and
    they are at least one in ``ratio``. Null, empty and wordless texts have no words and aren't contaminated; a
    text of any length is searched whole; repeated rows stay separate rows; repeated items count once per id; an
    empty benchmark hits nothing, and an empty table gives no rows; other columns are ignored.
    """
    scans = benchmark_scans(benchmark, item, item_text, window, block_bytes, scan_bytes)
    slim = text_batches(documents).select(F.col(key).alias("key"), F.col(text).alias("text"))
    if len(scans) == 1:
        found = with_hits(slim, scans[0])
    else:
        rows, number = numbered(slim)
        found = rows.select(number, "key").join(of_all_scans(rows.select(number, "text"), scans), number)
    out = found.select("key", "n_words", n_hit("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "items", "spans")
    return out.select(F.col("key").alias(key), "n_words", "n_hit", "n_items", "items_sha256", contaminated(F.col("n_hit"), F.col("n_words"), ratio).alias("contaminated"), "items", "spans")


def clean(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, ratio: int = 20, block_bytes: int = BLOCK_BYTES, scan_bytes: int = SCAN_BYTES) -> DataFrame:
    """The rows of ``documents`` that aren't contaminated, with all their columns; see ``contamination``.

    Each row is judged by itself, whatever its key: repeated rows stay or go together, rows without a key too.
    """
    scans = benchmark_scans(benchmark, item, item_text, window, block_bytes, scan_bytes)
    if len(scans) > 1:
        rows, number = numbered(text_batches(documents))
        gone = of_all_scans(rows.select(number, F.col(text).alias("text")), scans).where(contaminated(n_hit("spans"), F.col("n_words"), ratio))
        return rows.join(gone.select(number), number, "left_anti").select(documents.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            keep = []
            for x in columns_of(batch, text)[0]:
                w = words_of(x)
                hit = sum(b - a for a, b in hits_of(w, scans[0])[0])
                keep.append(not (hit > 0 and hit * ratio >= len(w)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return text_batches(documents).mapInArrow(forgetting(run), documents.schema)
