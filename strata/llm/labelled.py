"""Bounded, repeatable samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: crc32 of the id as text, modulo FOLDS; this remainder is never learned from.
FOLDS, HELD_OUT = 4, 2


def held_out(key: Column) -> Column:
    """Whether a row belongs to the part that no model learns from; null keys don't."""
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, label: str, key: str, text: str, most_rows: int) -> DataFrame:
    """(key, text, label): at most ``most_rows`` labelled documents outside the held-out part, least hashes first.

    Rows without key, text or label have no part; of several labels or texts of one key the largest counts.
    """
    fit = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("key").isNotNull() & ~held_out(F.col("key")))
    fit = fit.groupBy("key").agg(F.max("label").alias("label")).orderBy(F.xxhash64("key"), "key").limit(most_rows)
    texts = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    return texts.join(F.broadcast(fit), "key").groupBy("key").agg(F.max("text").alias("text"), F.max("label").alias("label"))
