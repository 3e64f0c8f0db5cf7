"""The corpus pipeline: stages that each keep part of the documents and hand them on as Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import decontam, neardup, packing, suffixdedup, toxicity
from strata.llm.queries import tokenizer_path
from strata.llm.shared import MADE, remove_written, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model doesn't reject.

    Each row is judged by its whole text alone: null and empty texts stay, equal rows stay or go together. Without
    labels nothing is rejected.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    Of several rows with one doc_id one stays, that of the least hash of its text. Rows without a doc_id, and texts
    without words, are duplicates of nothing and stay.
    """
    found = written(neardup.near_duplicates(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("n")), "kept")
    kept = neardup.sent(docs, found.where("NOT kept").select("doc_id"), "doc_id", "left_anti")
    several = found.where("kept AND n > 1").select("doc_id")
    if several.isEmpty():
        return kept.select(docs.columns)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = neardup.sent(kept, several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.xxhash64("text")).alias("row")).select("row.*")
    return neardup.sent(kept, several, "doc_id", "left_anti").select(docs.columns).unionByName(one)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words or more that occurred before; see ``suffixdedup.cut_passages``."""
    return suffixdedup.cut_passages(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark.

    Each row is judged by its whole text alone: null and wordless texts stay, equal rows stay or go together. With
    an empty benchmark all stay.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 tokens; null and empty texts are the end id alone; see ``packing.pack``."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_windows),
]

#: The model, the tokenizer and the hashes have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from ``documents``; each result is written and read again, and what the stage needed goes."""
    docs = table(spark, sf_dir, "documents")
    before = len(MADE)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        remove_written(spark, before, but=docs)
    return docs
