"""A Merkle manifest of a table: a digest per row, a tree per group of rows, and a tree over the groups.

Trees are built by levels, each a DataFrame: nodes have an index in their tree (``row_number``, counted over range
partitions so that no group is a single task), ``fanout`` neighbours by index become one parent. Proofs go the
other way: from the top down each level is joined to the one above and appends what the parent knows, so that rows
meet their siblings of all levels in one last join. Only digests and indices travel; texts stay in the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import parts_of, written

#: A node that is alone in its tree is the tree's top.
ALONE = "idx = 0 AND last"


def field_text(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def hashed(*texts: Column) -> Column:
    """Lowercase hex SHA-256 of the texts one after another."""
    return F.sha2(F.concat(*texts), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (``grp``, never null, and others) with tree, idx and last.

    ``tree`` is the place of a group's first row among all rows, ``idx`` a row's place in its group, ``last`` whether
    it is the group's last one. Rows are sorted by range, so a group may lie in any number of partitions; what
    partitions tell each other is one row of numbers for each of them.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(parts, "grp", *order).withColumn("part", F.spark_partition_id()), "ranged")
    each = ranged.groupBy("part", "grp").agg(F.count("*").alias("n"))
    sums = each.groupBy("part").agg(F.sum("n").alias("n"), F.min("grp").alias("low"), F.max("grp").alias("high"), F.max_by("n", "grp").alias("n_high"))
    by_part = Window.orderBy("part")  # one row per partition, not per document
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    goes_on = F.coalesce(F.lag("high").over(by_part) == F.col("low"), F.lit(False))
    sums = sums.withColumns({"offset": F.coalesce(F.sum("n").over(before), F.lit(0)), "goes_on": goes_on, "more": F.coalesce(F.lead("low").over(by_part) == F.col("high"), F.lit(False))})
    sums = sums.withColumn("begun", F.when((F.col("low") != F.col("high")) | ~F.col("goes_on"), F.col("offset") + F.col("n") - F.col("n_high")))
    carried = F.last("begun", ignorenulls=True).over(before)
    starts = sums.select("part", "offset", "more", F.when(F.col("goes_on"), carried).otherwise(F.col("offset")).alias("start"))
    within, in_group = Window.partitionBy("part").orderBy("grp", *order), Window.partitionBy("part", "grp").orderBy(*order)
    placed = ranged.withColumns({"row": F.row_number().over(within) - 1, "k": F.row_number().over(in_group) - 1, "next": F.lead("grp").over(within)}).join(F.broadcast(starts), "part")
    first = F.col("row") == F.col("k")  # the group with which the partition begins
    return placed.select(
        *rows.columns,
        F.when(first, F.col("start")).otherwise(F.col("offset") + F.col("row") - F.col("k")).cast("long").alias("tree"),
        F.when(first, F.col("offset") + F.col("row") - F.col("start")).otherwise(F.col("k")).cast("long").alias("idx"),
        F.when(F.col("next").isNull(), ~F.col("more")).otherwise(F.col("next") != F.col("grp")).alias("last"),
    )


def levels(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """The levels above ``nodes`` (tree, idx, digest, last): tables (tree, idx, kids, digest, last), lowest first."""
    out: list[DataFrame] = []
    at = nodes.where(f"NOT ({ALONE})")
    while not at.isEmpty():
        kids = F.transform(F.sort_array(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"])
        grouped = at.groupBy("tree", F.expr(f"idx div {fanout}").alias("up")).agg(kids.alias("kids"), F.max("last").alias("last"))
        out.append(written(grouped.select("tree", F.col("up").alias("idx"), "kids", F.sha2(F.array_join("kids", ""), 256).alias("digest"), "last"), "level"))
        at = out[-1].where(f"NOT ({ALONE})")
    return out


def tops(nodes: DataFrame, above: list[DataFrame]) -> DataFrame:
    """(tree, digest): the top of each tree."""
    out = nodes.where(ALONE).select("tree", "digest")
    for level in above:
        out = out.unionByName(level.where(ALONE).select("tree", "digest"))
    return out


def with_steps(nodes: DataFrame, above: list[DataFrame], heads: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` with the columns of ``heads`` (tree, steps, top): what stands beside each on its way to the top.

    A step is the place among its siblings and the digests of all of them; the steps of a tree's top come from ``heads``.
    """
    alone = nodes.where(ALONE).join(heads, "tree")
    if not above:
        return alone
    up = with_steps(above[0], above[1:], heads, fanout).select("tree", F.col("idx").alias("up"), "kids", "steps", "top")
    if "kids" in nodes.columns:
        up = up.withColumnRenamed("kids", "up_kids")
    step = F.struct((F.col("idx") % fanout).cast("int").alias("place"), F.col("up_kids" if "up_kids" in up.columns else "kids").alias("kids"))
    met = nodes.where(f"NOT ({ALONE})").withColumn("up", F.expr(f"idx div {fanout}")).join(up, ["tree", "up"])
    met = met.withColumn("steps", F.concat(F.array(step), F.col("steps")))
    return alone.unionByName(met.select(alone.columns))


def manifest(documents: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", group: str = "lang", fanout: int = 8, changed: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``documents``: key, leaf, subroot, root, steps, and changed_leaf.

    ``leaf`` is the digest of ``fields`` in their order, each ``-`` if null, else its UTF-8 byte count, ``:`` and
    itself. Leaves of one ``group`` value (null is one, and comes first) are in the order of ``key`` (null first; rows
    with one key by their leaves); runs of ``fanout`` become their parent until one node, the subroot, remains. Subroots
    in the bytewise order of ``group`` have the same kind of tree, whose top is ``root``. ``steps`` is the proof, see
    ``folded`` and ``proof_digest``. ``changed_leaf`` is the leaf as it would be with the columns in ``changed``.

    Equal rows are leaves of their own; empty texts count 0 bytes and differ from null ones; texts are hashed whole; an
    empty table has no rows; other columns are ignored.
    """
    documents = documents.coalesce(parts_of(documents))
    other = changed or {}
    leaf = hashed(*(field_text(F.col(f"`{c}`")) for c in fields))
    again = hashed(*(field_text(other.get(c, F.col(f"`{c}`"))) for c in fields)) if other else leaf
    grp = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group}`").cast("string")), F.lit(""))
    leaves = written(documents.select(grp.alias("grp"), F.col(f"`{key}`").alias("key"), leaf.alias("digest"), again.alias("again")), "leaves")
    nodes = written(numbered(leaves, ["key", "digest"]).select("tree", "idx", "last", "digest", "key", "again"), "nodes")
    trees = levels(nodes, fanout)
    # group trees in the order of their first leaves, which is that of the groups
    roots = written(numbered(tops(nodes, trees).select(F.lit("").alias("grp"), F.col("tree").alias("of"), "digest"), ["of"]).select("tree", "idx", "last", "digest", "of"), "subroots")
    tree = levels(roots, fanout)
    root = tops(roots, tree).first()
    no_steps = "CAST(array() AS array<struct<place: int, kids: array<string>>>)"
    head = roots.sparkSession.range(1).select(F.col("id").alias("tree"), F.expr(no_steps).alias("steps"), F.lit(root["digest"] if root else None).cast("string").alias("top"))
    heads = with_steps(roots, tree, head, fanout).select(F.col("of").alias("tree"), "steps", F.col("digest").alias("top"))
    out = with_steps(nodes, trees, heads, fanout)
    return out.select(F.col("key").alias(key), F.col("digest").alias("leaf"), F.col("top").alias("subroot"), F.lit(root["digest"] if root else None).cast("string").alias("root"), "steps", F.col("again").alias("changed_leaf"))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf and the siblings in its proof."""

    def up(digest: Column, step: Column) -> Column:
        return F.sha2(F.array_join(F.transform(step["kids"], lambda x, i: F.when(i == step["place"], digest).otherwise(x)), ""), 256)

    return F.aggregate(steps, leaf, up)


def proof_digest(steps: Column) -> Column:
    """The digest of all siblings, from the leaf's to the root's children, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(steps, lambda s: F.filter(s["kids"], lambda x, i: i != s["place"]))), ""), 256)
