"""An inverted index of memories by word, kept as two Parquet tables that only grow until they are packed.

``postings`` (token, id, projectId, tf, seq) is partitioned by a hash of the token, so a query opens the buckets of
its own words and no others; files are sorted, so that statistics skip within a bucket too. ``heads`` (id, projectId, seq, state)
says which write of an id counts: the greatest ``seq``, unless that was a removal. A change writes its postings
first and its heads last, so one that was cut off has no effect and can be done again with the same ``seq``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .retrieval import best_by_words

LIVE, ARCHIVED, REMOVED = "live", "archived", "removed"

POSTINGS = "token string, id string, projectId string, tf int, seq long, bucket int"
HEADS = "id string, projectId string, seq long, state string, part int"

#: Rows of a sorted run of postings, about.
RUN = 1_000_000


def query_words(query: str) -> list[str]:
    """The distinct words of a query, as ``text.tokenize_words`` has them."""
    return sorted({w for w in re.split(r"[^a-z0-9_]+", query.lower()) if len(w) > 1})


def postings_of(memories: DataFrame, seq: int) -> DataFrame:
    """(token, id, projectId, tf, seq): the words of title, summary and tags."""
    body = F.concat_ws("\n", "title", "summary", F.array_join("tags", " "))
    each = memories.select("id", "projectId", F.explode(text.tokenize_words(body)).alias("token"))
    return each.groupBy("token", "id", "projectId").agg(F.count("*").cast("int").alias("tf")).withColumn("seq", F.lit(seq).cast("long"))


@dataclass
class TokenIndex:
    """The index in a folder that executors share; ``buckets`` stay as they were when it was made."""

    spark: SparkSession
    path: str
    buckets: int = 64

    def bucket(self, token: Column) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def _append(self, made: DataFrame, heads: DataFrame, mode: str = "append") -> None:
        postings = made.withColumn("bucket", self.bucket(F.col("token")))
        runs = max(1, min(1 << 16, -(-postings.count() // RUN)))
        sorted_runs = postings.repartitionByRange(runs, "bucket", "token", "id").sortWithinPartitions("bucket", "token", "id")
        sorted_runs.write.partitionBy("bucket").mode(mode).parquet(f"{self.path}/postings")
        of = heads.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int"))
        of.repartition("part").write.partitionBy("part").mode(mode).parquet(f"{self.path}/heads")

    def build(self, memories: DataFrame, seq: int = 0) -> TokenIndex:
        """Makes the index anew; ids are unique."""
        self._append(postings_of(memories, seq), self._heads(memories, seq, LIVE), "overwrite")
        return self

    def _heads(self, rows: DataFrame, seq: int, state: str) -> DataFrame:
        return rows.select("id", "projectId", F.lit(seq).cast("long").alias("seq"), F.lit(state).alias("state"))

    def upsert(self, delta: DataFrame, seq: int) -> None:
        """New or changed memories; ``seq`` is greater than that of any earlier change. Archived ones stay so."""
        was = self.heads().where(F.col("state") == ARCHIVED).select("id", F.lit(ARCHIVED).alias("was"))
        heads = self._heads(delta, seq, LIVE).join(was, "id", "left").select("id", "projectId", "seq", F.coalesce("was", "state").alias("state"))
        self._append(postings_of(delta, seq), heads)

    def _mark(self, ids: DataFrame, seq: int, state: str, of: str) -> None:
        """A new state for ids in the state ``of``. Postings are written again under the new ``seq``, as that is what counts."""
        hit = self.heads().where(F.col("state") == of).join(ids.select("id").distinct(), "id", "left_semi")
        heads = hit.select("id", "projectId", F.lit(seq).cast("long").alias("seq"), F.lit(state).alias("state"))
        again = self.postings().join(hit.select("id", "seq"), ["id", "seq"], "left_semi") if state != REMOVED else self.postings().limit(0)
        self._append(again.select("token", "id", "projectId", "tf", F.lit(seq).cast("long").alias("seq")), heads)

    def remove(self, ids: DataFrame, seq: int) -> None:
        self._mark(ids, seq, REMOVED, LIVE)

    def archive(self, ids: DataFrame, seq: int) -> None:
        self._mark(ids, seq, ARCHIVED, LIVE)

    def restore(self, ids: DataFrame, seq: int) -> None:
        self._mark(ids, seq, LIVE, ARCHIVED)

    def heads(self) -> DataFrame:
        """The last write of each id that isn't removed."""
        found = self.spark.read.schema(HEADS).parquet(f"{self.path}/heads")
        return found.groupBy("id").agg(F.max_by(F.struct("projectId", "seq", "state"), "seq").alias("h")).select("id", "h.*").where(F.col("state") != REMOVED)

    def postings(self, tokens: list[str] | None = None) -> DataFrame:
        """All postings ever written, or those of some tokens, from their buckets alone."""
        found = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")
        if tokens is None:
            return found
        buckets = sorted({r[0] for r in self.spark.createDataFrame([(t,) for t in tokens], "token string").select(self.bucket(F.col("token"))).collect()}) if tokens else []
        return found.where(F.col("bucket").isin(buckets) & F.col("token").isin(tokens))

    def matching(self, query: str, project: str | None = None, archived: bool = False) -> DataFrame:
        """(id, hits, tf): memories that share a word with the query."""
        found = self.postings(query_words(query))
        found = found.where(F.col("projectId") == project) if project is not None else found
        heads = self.heads() if archived else self.heads().where(F.col("state") == LIVE)
        now = found.join(heads.select("id", "seq"), ["id", "seq"], "left_semi")
        return now.groupBy("id").agg(F.count_distinct("token").cast("int").alias("hits"), F.sum("tf").cast("int").alias("tf"))

    def search(self, memories: DataFrame, query: str, now: int, k: int = 10, project: str | None = None, preferred: tuple[str, ...] = (), archived: bool = False) -> DataFrame:
        """The best ``k`` of ``memories``, the table that the index is of, by the weighted score: those that share a word
        with the query or, where no memory does, archived ones included, all of the project."""
        pool = memories.where(F.lit(bool(query.strip())))
        pool = pool.where(F.col("projectId") == project) if project is not None else pool
        if query_words(query) and not self.matching(query, project, archived=True).isEmpty():
            pool = pool.join(self.matching(query, project, archived).select("id"), "id", "left_semi")
        elif not archived:
            pool = pool.join(self.heads().where(F.col("state") == ARCHIVED).select("id"), "id", "left_anti")
        return best_by_words(pool, query, now, k, project, preferred)

    def packed(self, path: str) -> TokenIndex:
        """A new index in another folder that has only what counts."""
        heads = self.heads()
        new = TokenIndex(self.spark, path, self.buckets)
        new._append(self.postings().drop("bucket").join(heads.select("id", "seq"), ["id", "seq"], "left_semi"), heads, "overwrite")
        return new
