"""Places and neighbours of rows in groups of any size: sorted by range, so that no group is a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import kept


def placed(rows: DataFrame, by: list[str], order: list[str], look: list[str]) -> DataFrame:
    """``rows`` with ``place``, from 0 in the order within each group of ``by``, and ``before`` and ``after``: the columns
    ``look`` of the neighbours in the group, null at its ends.

    Rows are dealt out by ranges of (``by``, ``order``); partitions tell each other their first and last rows and how
    many of the last group they have, which is a row for each of them. ``order`` decides ties whole.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(rows.repartitionByRange(parts, *by, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    group, seen = F.struct(*by), F.struct(*look)
    keys = [*by, *order]
    within, in_group = Window.partitionBy("__part").orderBy(*keys), Window.partitionBy("__part", *by).orderBy(*order)
    here = ranged.withColumns({"__n": F.row_number().over(within) - 1, "__k": F.row_number().over(in_group) - 1, "__b": F.lag(seen).over(in_group), "__a": F.lead(seen).over(in_group)})

    edge = F.struct(F.struct(*(F.col(c).alias(c) for c in by)).alias("g"), F.struct(*look).alias("r"))
    counts = ranged.groupBy("__part", *by).agg(F.count("*").alias("c"))
    last_count = counts.groupBy("__part").agg(F.max_by("c", group).alias("c_last"), F.sum("c").alias("c_all"), F.count("*").alias("groups"))
    ends = ranged.groupBy("__part").agg(F.min_by(edge, F.struct(*keys)).alias("first"), F.max_by(edge, F.struct(*keys)).alias("last")).join(last_count, "__part")
    along = Window.orderBy("__part")  # one row per partition
    ends = ends.withColumns({"p": F.lag("last").over(along), "f": F.lead("first").over(along)})
    joined = F.col("p.g").eqNullSafe(F.col("first.g")) & F.col("p").isNotNull()
    ends = ends.withColumns({"from_before": F.when(joined, F.col("p.r")), "goes_on": F.when(F.col("f").isNotNull() & F.col("f.g").eqNullSafe(F.col("last.g")), F.col("f.r")), "joined": joined})
    # rows of the first group that lie in earlier partitions: summed up since the group began
    ends = ends.withColumn("__start", F.when(~F.col("joined") | (F.col("groups") > 1), F.col("__part")))
    ends = ends.withColumn("__since", F.last("__start", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    run = Window.partitionBy("__since").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.coalesce(F.sum("c_all").over(run), F.lit(0))  # whole partitions between the beginning and this one
    begun = ends.select(F.col("__part").alias("b_part"), F.col("c_last").alias("b_count"))
    told = ends.withColumn("passed", passed).join(begun, F.col("__since") == F.col("b_part"), "left")
    told = told.select("__part", "from_before", "goes_on", F.when(F.col("joined"), F.col("b_count") + F.col("passed")).otherwise(0).alias("earlier"))

    out = here.join(F.broadcast(told), "__part")  # a row per partition
    first_group = F.col("__n") == F.col("__k")

    def name(c: str) -> Column:
        return F.col(f"`{c}`")

    return out.select(
        *(name(c) for c in rows.columns), (F.col("__k") + F.when(first_group, F.col("earlier")).otherwise(0)).cast("long").alias("place"),
        F.coalesce("__b", F.when(first_group & (F.col("__k") == 0), F.col("from_before"))).alias("before"),
        F.coalesce("__a", F.when(F.lead("__n").over(Window.partitionBy("__part").orderBy("__n")).isNull(), F.col("goes_on"))).alias("after"),
    )


def runs(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``rows`` with ``place`` and ``seen``: the how many-th it is of rows of its group with the same ``value`` one after
    another.

    A run is the places from where the value changes up to the next change; rows meet their run by their place, so a
    run of any length is many tasks. Null equals null.
    """
    told = kept(placed(rows, by, order, [value]), "placed")
    first = F.col("before").isNull() & (F.col("place") == 0)
    begins = told.where(first | ~F.col(f"before.{value}").eqNullSafe(F.col(value))).select(*by, F.col("place").alias("start"))
    counts = told.groupBy(*by).agg(F.count("*").alias("__all"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    ends = placed(begins, by, ["start"], ["start"]).drop("place", "before")
    ends = ends.alias("l").join(counts.alias("r"), same).select(*(F.col(f"l.{c}").alias(c) for c in by), "start", F.coalesce("after.start", "__all").alias("end"))
    each = ends.select(*by, "start", F.explode(F.sequence("start", F.col("end") - 1)).alias("place"))
    met = told.drop("before", "after").alias("l").join(each.alias("r"), [*same, F.col("l.place") == F.col("r.place")])
    return met.select("l.*", (F.col("l.place") - F.col("r.start") + 1).alias("seen"))
