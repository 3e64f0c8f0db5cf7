"""Token counts without token ids.

Pass 1 counts how often each distinct pre-token occurs in the corpus; the tokenizer then runs once per
distinct pre-token. Pass 2 makes the frequencies of pre-tokens per document and joins them to those counts.
The most frequent pre-tokens (at most ``head`` of them, so a bounded broadcast) are joined inside the scan;
the rest, of which no single one is frequent, are joined by a shuffle. No document's ids are ever made.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import pretokenizer
from .shared import checked_broadcast, columns_of, parts_of, pieces, text_batches, written

#: Distinct pre-tokens a worker holds before it hands them on.
FLUSH = 200_000


def pretoken_counts(documents: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(pretoken, n): how often each pre-token occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = pretokenizer(path).cut, Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pretoken", "n"])

        for batch in pieces(batches, 256):
            for x in columns_of(batch, "text")[0]:
                if x:
                    seen.update(cut(x))
            if len(seen) > FLUSH:
                yield out()
                seen.clear()
        yield out()

    return documents.select(F.col(text).alias("text")).mapInArrow(count, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))


def piece_counts(distinct: DataFrame, path: str) -> DataFrame:
    """(pretoken, n, n_pieces): the ids that each distinct pre-token has, counted once."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = pretokenizer(path).counts
        for batch in pieces(batches, 4096):
            made = pa.array(counts(columns_of(batch, "pretoken")[0]), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], ["pretoken", "n", "n_pieces"])

    return distinct.mapInArrow(measure, "pretoken string, n long, n_pieces int")


def token_counts(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 512, head: int = 131_072) -> DataFrame:
    """One row per row of ``documents``: key, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    Null and empty texts have 0 bytes and 0 tokens. Special strings inside texts count as the tokenizer's
    default has them (one id each). Rows with the same key, null keys among them, stay separate rows; texts of any
    length count whole; other columns are ignored; an empty table gives an empty result. ``head`` only decides
    which pre-tokens take the broadcast: any value gives the same result. Rows are told apart by their place in
    a partition, so ``documents`` must come in the same order when a lost task is run again, as tables do: write
    the result of a shuffle first.
    """
    documents = text_batches(documents)
    spark, parts = documents.sparkSession, parts_of(documents)
    counted = written(piece_counts(pretoken_counts(documents, path, text), path), "pieces", parts)
    most = {r[0]: r[1] for r in counted.where(F.octet_length("pretoken") <= 64).orderBy(F.desc("n"), "pretoken").limit(head).select("pretoken", "n_pieces").toLocalIterator()}
    sent = checked_broadcast(most, 160 * len(most), spark, "frequent pre-tokens")
    key_type = documents.schema[key].dataType.simpleString()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, known = pretokenizer(path).cut, sent.value
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        for batch in pieces(batches, 256):
            rows, at, found, times = [], [], [], []
            for k, x in enumerate(columns_of(batch, "text")[0]):
                row += 1
                total = 0
                for token, n in Counter(cut(x)).items() if x else ():
                    have = known.get(token)
                    if have is None:
                        rows.append(row)
                        at.append(k)
                        found.append(token)
                        times.append(n)
                    else:
                        total += n * have
                rows.append(row)
                at.append(k)
                found.append(f"\0{row}")  # the document's own row; such keys spread, while nulls would meet in one task
                times.append(-1 - total)
            taken = batch.select(["key", "n_bytes"]).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), taken.column(0), taken.column(1), pa.array(found, pa.string()), pa.array(times, pa.int64())], ["row", "key", "n_bytes", "pretoken", "times"])

    slim = documents.select(F.col(key).alias("key"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    per_document = slim.mapInArrow(frequencies, f"row long, key {key_type}, n_bytes long, pretoken string, times long")
    joined = per_document.join(counted.select("pretoken", "n_pieces"), "pretoken", "left")
    tokens = F.sum(F.when(F.col("times") < 0, -1 - F.col("times")).otherwise(F.col("times") * F.col("n_pieces"))).alias("n_tokens")
    summed = joined.groupBy("row", "key", "n_bytes").agg(tokens)
    return summed.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")).coalesce(parts)
