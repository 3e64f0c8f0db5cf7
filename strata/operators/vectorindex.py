"""An inverted-file index of vectors whose searches are exact.

Vectors are scaled to length 1, where the greatest cosine is the least distance. Each belongs to the list of its
nearest centroid and is stored in blocks of that list ordered by the distance to the centroid. By the triangle
inequality no vector of a block is nearer to a query than the difference of their distances to the centroid, so
once a query has k results, every block whose least possible distance is greater is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import kept

#: Vectors that centroids are fitted on, those of the least hashes; every vector is indexed.
SAMPLE = 20_000

#: Vectors in a block, at most; queries that meet a block at a time.
BLOCK, QUERIES = 1024, 512

#: Room for rounding in the bounds, and the places to which similarities are told and ranked.
MARGIN, PLACES = 1e-6, 9

#: What rounding may hide of a squared distance.
ROUNDED = 2 * 10.0**-PLACES


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; those without a length stay zero."""
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]).reshape(len(column), dim) if len(column) else np.zeros((0, dim))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]))


def fit_centroids(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Centroids by the usual rounds from every n-th vector; as many as there are vectors at most."""
    centres = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)].copy() if len(x) else x
    for _ in range(rounds if len(x) else 0):
        near = distances(x, centres).argmin(1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = x[near == c].mean(0)
    return centres


def whole_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """(id, v): the vectors of ``dim`` finite components, as doubles."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == dim) & finite).select("id", v.alias("v"))


@dataclass
class VectorIndex:
    """``blocks`` (list, block, n, low, high, ids, vectors): vectors of a list from distance low to high of its centroid."""

    blocks: DataFrame
    centroids: np.ndarray
    dim: int
    id_type: str

    def nearest(self, queries: DataFrame, k: int, others: bool = True) -> tuple[DataFrame, DataFrame]:
        """((query, place, id, similarity), (query, blocks, met)): the ``k`` vectors of greatest cosine for each of
        ``queries`` (id, embedding), but its own id with ``others``; and how many of the blocks it met.

        Exact: similarities, rounded to nine places, ties by id, are those of a comparison with all. Queries that are
        null, of another dimension or not finite find nothing.
        """
        centres, dim, k_all = self.centroids, self.dim, k + int(others)
        asked = whole_vectors(queries, dim)
        groups = max(1, -(-asked.count() // QUERIES))
        stats = self.blocks.groupBy("list").agg(F.sum("n").alias("n")).collect()  # a row per list
        sizes = {r["list"]: r["n"] for r in stats}

        def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Each query's lists with its distance to the centroid; the nearest ones that hold enough come first."""
            counts = np.array([sizes.get(c, 0) for c in range(len(centres))])
            for b in batches:
                q = unit(matrix(b["v"], dim))
                d = distances(q, centres)
                order = d.argsort(1, kind="stable")
                before = np.take_along_axis(np.broadcast_to(counts, d.shape), order, 1).cumsum(1) - counts[order]
                at = np.repeat(np.arange(len(b)), len(centres))
                some = counts[order.ravel()] > 0
                yield pd.DataFrame({"id": b["id"].to_numpy()[at][some], "v": [q[i] for i in at[some]], "list": order.ravel()[some].astype(np.int32), "d": d.ravel()[(at * d.shape[1] + order.ravel())][some], "first": (before.ravel() < k_all)[some]})

        kind = f"id {self.id_type}, v array<double>, list int, d double, first boolean"
        lists = kept(asked.mapInPandas(spread, kind), "query-lists")
        seen = kept(self._met(lists.where("first").select("id", "v", "list", "d", F.lit(4.0).alias("bound")), k_all, groups), "first-hits")
        bounds = seen.where("near IS NOT NULL").groupBy("id").agg(F.count("*").alias("n"), F.max("distance").alias("far")).select("id", F.when(F.col("n") >= k_all, F.col("far")).otherwise(4.0).alias("bound"))
        rest = lists.where("NOT first").join(bounds, "id").select("id", "v", "list", "d", "bound")
        every = seen.unionByName(self._met(rest, k_all, groups))
        hits = every.where(F.col("near").isNotNull() & (~F.lit(others) | (F.col("id") != F.col("near"))))
        place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "near"))
        best = hits.withColumn("place", place).where(F.col("place") <= k).select(F.col("id").alias("query"), "place", F.col("near").alias("id"), "similarity")
        total = self.blocks.count()
        met = every.groupBy("id").agg(F.sum("met").alias("met")).select(F.col("id").alias("query"), F.lit(total).alias("blocks"), "met")
        return best, met

    def _met(self, asked: DataFrame, k: int, groups: int) -> DataFrame:
        """(id, near, similarity, distance, met): the best ``k`` of each block that ``asked`` (id, v, list, d, bound) must
        meet, and a row without ``near`` that counts the block."""
        dim, id_type = self.dim, self.id_type
        near_enough = (F.col("d") - F.col("high") <= F.col("bound") + MARGIN) & (F.col("low") - F.col("d") <= F.col("bound") + MARGIN)
        edges = self.blocks.select("list", "block", "low", "high")
        wanted = asked.join(edges, "list").where(near_enough).select("list", "block", "id", "v")
        dealt = wanted.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(groups)))
        packs = dealt.groupBy("list", "block", "part").agg(F.collect_list(F.struct("id", "v")).alias("asked"))  # about QUERIES at most
        pairs = packs.join(self.blocks.select("list", "block", "ids", "vectors"), ["list", "block"]).select("asked", "ids", "vectors")

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for asked, ids, vectors in zip(b["asked"], b["ids"], b["vectors"], strict=True):
                    names = np.asarray(ids)
                    x = np.asarray(vectors, np.float64).reshape(len(names), dim)
                    q = np.stack([np.asarray(a["v"], np.float64) for a in asked])
                    similarity = np.round(q @ x.T, PLACES)
                    out: dict[str, list] = {"id": [], "near": [], "similarity": [], "distance": [], "met": []}
                    order = np.argsort(names, kind="stable")
                    for a, s in zip(asked, similarity, strict=True):
                        best = order[np.argsort(-s[order], kind="stable")[:k]]
                        out["id"] += [a["id"]] * (len(best) + 1)
                        out["near"] += [*names[best].tolist(), None]
                        out["similarity"] += [*s[best].tolist(), None]
                        out["distance"] += [*np.sqrt(np.maximum(0, 2 - 2 * s[best] + ROUNDED)).tolist(), None]
                        out["met"] += [0] * len(best) + [1]
                    yield pd.DataFrame({"id": out["id"], "near": pd.array(out["near"], "Int64") if id_type in ("bigint", "int") else out["near"], "similarity": out["similarity"], "distance": out["distance"], "met": out["met"]})

        made = pairs.mapInPandas(compare, f"id {id_type}, near {id_type}, similarity double, distance double, met long")
        hit = made.where("near IS NOT NULL")
        place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "near"))
        return hit.withColumn("__p", place).where(F.col("__p") <= k).drop("__p").unionByName(made.where("near IS NULL"))


def build_index(vectors: DataFrame, lists: int = 32, sample: int = SAMPLE) -> VectorIndex:
    """An index of ``vectors`` (id, embedding): all of the greatest dimension and of finite components; others aren't in it.

    Centroids come from at most ``sample`` vectors, those of the least hashes of their ids. Equal ids are entries of
    their own.
    """
    dim = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    fit = whole_vectors(vectors, dim)
    some = fit.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas() if dim else pd.DataFrame({"v": []})
    centres = fit_centroids(unit(matrix(some["v"], dim)), lists) if dim else np.zeros((0, 0))
    id_type = vectors.schema["id"].dataType.simpleString()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = unit(matrix(b["v"], dim))
            d = distances(x, centres)
            near = d.argmin(1)
            yield pd.DataFrame({"id": b["id"], "v": list(x), "list": near.astype(np.int32), "d": d[np.arange(len(x)), near]})

    kind = f"id {id_type}, v array<double>, list int, d double"
    placed = kept(fit.mapInPandas(assign, kind) if len(centres) else fit.limit(0).select("id", "v", F.lit(0).alias("list"), F.lit(0.0).alias("d")), "placed")
    # sorted by list and distance over all partitions; a block is a run in one of them
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = placed.repartitionByRange(parts, "list", "d", "id").withColumn("part", F.spark_partition_id())
    row = F.row_number().over(Window.partitionBy("part", "list").orderBy("d", "id")) - 1
    runs = ranged.withColumn("run", F.floor(row / BLOCK))
    block = F.struct("d", "id", "v")
    grouped = runs.groupBy("list", "part", "run").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"), F.array_sort(F.collect_list(block)).alias("rows"))  # at most BLOCK
    made = grouped.select(
        "list", F.concat_ws(":", "part", "run").alias("block"), "n", "low", "high", F.transform("rows", lambda r: r["id"]).alias("ids"), F.flatten(F.transform("rows", lambda r: r["v"])).alias("vectors"),
    )
    return VectorIndex(kept(made, "blocks"), centres, dim, id_type)
