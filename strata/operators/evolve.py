"""Evolution of a memory: candidates are reviewed against their neighbours, chosen, merged or compressed, aged, and stored."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, text
from .evolution import choose_candidate, critic_fallback, settle, shortened
from .lineage import kept
from .overlap import top_overlaps
from .temporal import merge_rows

#: Neighbours that a review looks at, and that a merge takes in.
REVIEW, MERGE = 3, 5

#: Columns of an evolved memory.
STORED = ("id", "projectId", "kind", "sourceType", "title", "summary", "content", "tags", "importance", "confidence", "createdAt", "lastAccessedAt", "sourceRef")

#: (candidate, neighbours) -> title, summary, content, tags, confidence of the merged memory.
Merge = Callable[[Column, Column], dict[str, Column]]


@dataclass
class Evolved:
    """``results``: a row per key; ``reviews``: a row per candidate; ``memories``: the table afterwards."""

    results: DataFrame
    reviews: DataFrame
    memories: DataFrame


def unmerged(candidate: Column, neighbours: Column) -> dict[str, Column]:
    """Without a model a merged memory is the candidate itself."""
    return {}


def union_of_tags(candidate: Column, neighbours: Column) -> dict[str, Column]:
    """The candidate with the tags of its neighbours, at most 24."""
    return {"tags": F.slice(F.array_distinct(F.concat(candidate["tags"], F.flatten(F.transform(neighbours, lambda n: n["tags"])))), 1, 24)}


def neighbours(candidates: DataFrame, memories: DataFrame, k: int = MERGE) -> DataFrame:
    """(cid, near): the ``k`` memories of a candidate's project, other than ``own``, whose titles share most words with
    its title and summary, best first, as structs of id, title, summary and tags; see ``overlap.top_overlaps``."""
    asking = candidates.select(F.col("cid").alias("id"), F.col("projectId").alias("grp"), F.concat_ws("\n", "title", "summary").alias("t"), "own")
    listed = memories.select(F.col("projectId").alias("grp"), F.lower("title").alias("t"), "id")
    found = top_overlaps(asking, listed, k)
    rows = found.join(memories.select(F.col("id").alias("near"), "title", "summary", "tags"), "near")
    one = F.struct("place", F.struct(F.col("near").alias("id"), "title", "summary", "tags").alias("n"))
    return rows.groupBy(F.col("id").alias("cid")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["n"]).alias("near"))


def snippet(near: Column) -> Column:
    """The title and summary of a neighbour in at most 180 characters."""
    return shortened(text.trim(F.concat_ws(" ", near["title"], near["summary"])), 180)


def stage(name: str, ok: Column, detail: Column) -> Column:
    return F.struct(F.lit(name).alias("stage"), ok.alias("ok"), detail.alias("detail"))


def evolve(candidates: DataFrame, memories: DataFrame, now: int, key: str = "key", merge: Merge = unmerged) -> Evolved:
    """Candidates (``key``, place, projectId, kind, title, summary, content, tags, sourceRef, and ``own`` if there is a
    memory that they are made from) of each key, against all memories at once, and what becomes of them.

    Each candidate is reviewed against its three nearest; of a key the best is taken: accepted before rejected, then
    by action, score, novelty and place. A merged one is what ``merge`` makes of it and its five nearest, a
    compressed one is shortened; score and clarity become importance and confidence and age; promoted ones get
    a tag, and those that would be archived at once aren't stored. ``memories`` afterwards has the stored ones, each
    under an id made of its project and texts, in place of any with that id. ``at`` of all stages is ``now``.
    """
    own = F.col("own") if "own" in candidates.columns else F.lit(None).cast("string")
    given = candidates.select(F.col(key).alias("key"), "place", F.coalesce(F.nullif(text.trim(F.col("projectId")), F.lit("")), F.lit("default")).alias("projectId"), "kind", "title", "summary", "content", "tags", "sourceRef", own.alias("own"))
    given = kept(given.withColumn("cid", F.monotonically_increasing_id()), "candidates")
    near = given.select("cid").join(neighbours(given, memories), "cid", "left").select("cid", F.coalesce("near", F.expr("CAST(array() AS array<struct<id: string, title: string, summary: string, tags: array<string>>>)")).alias("near"))
    # contents stay behind until a candidate of each key is chosen
    judged = given.drop("content").join(near, "cid").withColumn("known", F.filter(F.transform(F.slice("near", 1, REVIEW), snippet), lambda s: s != ""))
    reviews = kept(judged.withColumn("r", critic_fallback(F.col("title"), F.col("summary"), F.col("known"))).select("*", "r.*").drop("r", "known", "own"), "reviews")

    best = kept(choose_candidate(reviews, "key"), "best")
    rejected = best.where("action = 'reject'")
    best = best.where("action <> 'reject'").join(given.select("cid", "content"), "cid")
    merged = (F.col("action") == "merge") & (F.size("near") > 0)
    row = F.struct(*best.columns)
    best = best.withColumns({"merged": merged, **{c: F.when(merged, v).otherwise(F.col(c)) for c, v in merge(row, F.col("near")).items() if c != "confidence"}})
    best = best.withColumn("clarity", F.when(merged, merge(row, F.col("near")).get("confidence", F.col("clarity"))).otherwise(F.col("clarity")))
    stored_id = hashing.stable_id("mem", F.col("projectId"), F.col("title"), F.col("content"))
    done = kept(settle(best.withColumn("id", stored_id), now), "evolved")
    head = [F.col("key").alias(key), "projectId"]
    found = F.concat(F.lit("writer-produced-"), F.col("n").cast("string"), F.lit("-candidate(s)"))
    chosen = F.concat(F.lit("selected-candidate-"), F.col("index").cast("string"), F.lit("-action-"), F.col("action"))
    what = F.when(F.col("merged"), F.concat(F.lit("merged-with-"), F.size("near").cast("string"), F.lit("-neighbor(s)"))).when(F.col("action") == "compress", "compressed-candidate-content").otherwise("no-consolidation-required")
    yes = F.lit(True)
    stages = F.concat(
        F.array(stage("propose", yes, found), stage("review", yes, chosen)),
        F.when(F.col("action") == "compress", F.array(stage("compress", yes, F.lit("compressor-agent-applied")))).otherwise(F.array().cast("array<struct<stage: string, ok: boolean, detail: string>>")),
        F.array(
            stage("consolidate", yes, what), stage("archivist", yes, F.concat(F.lit("decay=1 promote="), F.col("promote").cast("string"), F.lit(" archive="), (~F.col("stored")).cast("string"))),
            stage("persist", yes, F.when(F.col("stored"), "upserted").otherwise("candidate-not-stored-low-importance")),
        ),
    )
    kept_rows = done.select(
        *head, "stored", F.when(F.col("stored"), F.col("action")).otherwise("archive").alias("action"), F.when(F.col("stored"), F.col("reason")).otherwise("low-importance").alias("reason"), "id", F.col("n").alias("proposed"),
        F.col("index").alias("selected"), F.col("score"), "merged", F.size("near").alias("neighbors"), F.col("promote").alias("promoted"), (~F.col("stored")).alias("archived"), stages.alias("stages"),
    )
    no = F.lit(False)
    none = {"selected": F.lit(None).cast("int"), "score": F.lit(None).cast("double"), "merged": no, "neighbors": F.lit(0), "promoted": no, "archived": no}
    refused = rejected.select(*head, no.alias("stored"), "action", "reason", F.lit(None).cast("string").alias("id"), F.col("n").alias("proposed"), *(v.alias(c) for c, v in none.items()), F.array(stage("propose", yes, found), stage("review", no, F.col("reason"))).alias("stages"))
    # of candidates with one id, as equal texts have, the one of the least key stays
    fresh = done.where("stored").groupBy("id").agg(F.min_by(F.struct(*STORED[1:]), "key").alias("row")).select("id", "row.*")
    whole = reviews.join(given.select("cid", "content"), "cid").drop("cid")
    return Evolved(kept_rows.unionByName(refused), whole.withColumnRenamed("key", key), merge_rows(memories, fresh, ["id"]))
