"""Shards along a Hilbert curve, with DataFrame functions only.

Every metadata dimension is quantised to equally full bins. A cell's place on the Hilbert curve orders the
rows; the order is cut into runs of nearly equal bytes, so that a shard covers a compact part of every
dimension and its min-max statistics prune on each of them. Rows are ordered by a range partitioning whose
ties are broken by content and id, so a cell that holds a third of all rows is spread over many tasks.
Equal texts are one group: they take the least of their places on the curve, so that they stand together,
and a cut moves to the end of a group as long as that keeps the bytes near equal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import shared_dir


def hilbert_places(dims: int, bits: int) -> list[int]:
    """The place on the curve of each cell; a cell's number has the coordinates' bits one after another."""
    out = []
    for cell in range(1 << dims * bits):
        x = [cell >> bits * (dims - 1 - d) & (1 << bits) - 1 for d in range(dims)]
        high = 1 << bits - 1
        q = high
        while q > 1:  # undo the rotations, from the largest cube to the smallest
            p = q - 1
            for d in range(dims):
                if x[d] & q:
                    x[0] ^= p
                else:
                    t = (x[0] ^ x[d]) & p
                    x[0] ^= t
                    x[d] ^= t
            q >>= 1
        for d in range(1, dims):  # Gray code
            x[d] ^= x[d - 1]
        t, q = 0, high
        while q > 1:
            if x[-1] & q:
                t ^= q - 1
            q >>= 1
        x = [v ^ t for v in x]
        place = 0
        for b in range(bits - 1, -1, -1):
            for d in range(dims):
                place = place << 1 | x[d] >> b & 1
        out.append(place)
    return out


def number_cuts(slim: DataFrame, names: list[str], bins: int) -> dict[str, list]:
    """The greatest value up to each bin but the last, per column of numbers."""
    cuts = slim.agg(*(F.percentile_approx(n, [i / bins for i in range(1, bins)], 1000).alias(n) for n in names)).first() if names else {}
    return {n: cuts[n] or [] for n in names}


def string_cuts(slim: DataFrame, names: list[str], bins: int, partitions: int) -> dict[str, list]:
    """The same for strings, compared whole: each distinct value is counted once, and counts are summed in order of
    the values; None for a bin without any value up to it."""
    if not names:
        return {}
    each = slim.select(F.explode(F.array(*(F.struct(F.lit(n).alias("dim"), F.col(n).alias("value")) for n in names))).alias("x")).select("x.*").where("value IS NOT NULL")
    counted = each.groupBy("dim", "value").agg(F.count("*").alias("n"))
    ranged = counted.repartitionByRange(partitions, "dim", "value").withColumn("part", F.spark_partition_id()).checkpoint()
    sums = ranged.groupBy("dim", "part").agg(F.sum("n").alias("n"))  # a row per partition, and one more per dimension
    before = F.coalesce(F.sum("n").over(Window.partitionBy("dim").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("dim", "part", before.alias("before"), F.sum("n").over(Window.partitionBy("dim")).alias("all"))
    running = F.sum("n").over(Window.partitionBy("dim", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("running", running).join(F.broadcast(sums), ["dim", "part"])
    bin_of = F.expr(f"least({bins - 1}, (2 * (before + running) - n) * {bins} div (2 * all))")
    found = placed.groupBy("dim", bin_of.alias("bin")).agg(F.max("value").alias("cut")).where(F.col("bin") < bins - 1).collect()  # at most ``bins`` a dimension
    return {n: [max((r["cut"] for r in found if r["dim"] == n and r["bin"] <= b), default=None) for b in range(bins - 1)] for n in names}


def hilbert_shards(documents: DataFrame, shards: int = 8, dimensions: tuple[str, ...] = ("source", "lang", "size"), bits: int = 4, key: str = "doc_id", text: str = "text", partitions: int | None = None, slack: float = 0.01) -> DataFrame:
    """One row per row of ``documents``: key, size, text_crc32, law, shard, slot, grown_shard, curve.

    ``size`` is the text's UTF-8 bytes (null: none) plus 1; the dimension of that name means it, whatever columns
    there are. The law is ``bytes``: a shard's bytes differ from an equal part by less than the largest row or
    ``slack`` of that part, whichever is more; groups of equal texts of up to as many bytes stay in one shard,
    larger ones are cut. Slots count from 0 in curve order; ``grown_shard`` is null, as cuts move when shards are
    added. Null metadata comes first on a dimension; null and empty texts are equal; rows that are the same take
    neighbouring places; very long texts count by their bytes alone; with an empty table there are no rows;
    other columns are ignored.
    """
    spark = documents.sparkSession
    shared_dir(spark)
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text), F.lit(""))
    size = (F.octet_length(body) + 1).cast("long")
    kinds = {f"__d{i}": "size" if d == "size" else "text" if isinstance(documents.schema[d].dataType, T.StringType) else "number" for i, d in enumerate(dimensions)}
    values = {n: size if kinds[n] == "size" else F.col(d) if kinds[n] == "text" else F.col(d).cast("double") for n, d in zip(kinds, dimensions, strict=True)}
    slim = documents.select(F.col(key).alias("key"), size.alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.xxhash64(body).alias("same"), *(c.alias(n) for n, c in values.items()))
    bins = 1 << bits
    cuts = number_cuts(slim, [n for n in kinds if kinds[n] != "text"], bins) | string_cuts(slim, [n for n in kinds if kinds[n] == "text"], bins, n_parts)
    above = lambda n, v: F.coalesce(F.col(n) > v, F.lit(False)) if v is not None else F.col(n).isNotNull()
    bin_of = [reduce(lambda a, b: a + b, [above(n, v).cast("int") for v in cuts[n]], F.lit(0)) for n in kinds]
    cell = reduce(lambda a, b: a * bins + b, bin_of)
    places = F.expr(f"array({', '.join(map(str, hilbert_places(len(kinds), bits)))})")
    placed = slim.select("key", "size", "text_crc32", "same", F.element_at(places, (cell + 1).cast("int")).alias("curve"))
    largest = placed.agg(F.max("size").alias("row"), F.sum("size").alias("all")).first()
    whole = max(largest["row"] or 0, int(slack * (largest["all"] or 0) / shards))

    # groups of equal texts, sorted by their own table of those that occur twice, which is smaller than the rows
    group = ["same", "text_crc32", "size"]
    groups = placed.groupBy(*group).agg(F.min("curve").alias("group_curve"), F.sum("size").alias("group_bytes"), F.count("*").alias("c")).where("c > 1").drop("c")
    placed = placed.join(groups, group, "left").select("key", *group, F.coalesce("group_curve", "curve").alias("curve"), F.coalesce("group_bytes", "size").alias("group_bytes"))

    # reliable checkpoint: a partition's number and rows stay the same for all that follows
    order = ["curve", *group, "key"]
    ranged = placed.repartitionByRange(n_parts, *order).withColumn("part", F.spark_partition_id()).checkpoint()
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition, not per document
    all_rows = Window.partitionBy()
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(all_rows).alias("bytes_all"))
    within = Window.partitionBy("part").orderBy(*order)
    running = ranged.join(F.broadcast(offsets), "part").select(
        *order, "group_bytes", "bytes_all",
        (F.col("bytes_before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("first_byte"),
        (F.col("rows_before") + F.row_number().over(within) - 1).alias("place"),
    ).checkpoint()
    # where a group that may stay whole begins; groups lie together, but may lie in two partitions
    small = (F.col("group_bytes") > F.col("size")) & (F.col("group_bytes") <= whole)
    begins = running.where(small).groupBy("curve", *group).agg(F.min("first_byte").alias("group_byte"))
    middle = F.coalesce(2 * F.col("group_byte") + F.col("group_bytes"), 2 * F.col("first_byte") + F.col("size"))
    known = running.join(begins, ["curve", *group], "left").withColumn("middle", middle)
    cut = known.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"middle * {shards} div (2 * bytes_all)")).cast("int")).checkpoint()
    firsts = cut.groupBy("shard").agg(F.min("place").alias("first_place"))
    out = cut.join(F.broadcast(firsts), "shard")
    return out.select(F.col("key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first_place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("curve").cast("int").alias("curve"))
