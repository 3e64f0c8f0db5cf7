"""Near-duplicates by bottom-k sketches of one hash function.

A document's set is its distinct 5-word shingles, each a 64-bit hash; its sketch is the set's k smallest.
Documents with equal sets form a class, which takes part once. Inverted lists of retained values generate
overlaps. The k smallest values of two sketches together are the sketch of the union, and the share of them that
lies in both estimates the similarity; a pair whose estimate is more than ``MARGIN`` below what is asked is
dropped. So it is enough to list each sketch under its rarest values, all but that share of them; passages that
many documents share then hardly generate anything. Lists with the same leading member are one group, inside which
the estimate filters pairs; the exact Jaccard of the full sets verifies. Pairs that are linked already by others
needn't be verified, as only components are wanted.

Large groups are compared in blocks: first each block with itself and with the first. Once components are known,
rows outside a group's main component still have to meet the others. Where they are many, the group is cut again, by
the rarest values of the whole sets, so that a passage which many texts share brings together only those that
hardly have anything else; these are compared block by block. No task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import checked_broadcast, columns_of, lowered, parts_of, pieces, text_batches, written
from .words import WORD, forgetting, hashes_of, shingles

#: Rows, and bytes of sets, in a block of a group.
BLOCK_ROWS, BLOCK_BYTES = 512, 16 << 20

#: How far an estimate from the union's sketch may be below the similarity asked for, in percent: at 75 % and 64 values it
#: is 7 standard deviations, a chance of about 2e-6.
MARGIN = 25

#: Blocks of outer rows that meet all others directly, as that is linear; groups with more are cut again.
FEW = 2

#: Candidates up to this many, of 8 bytes each, are sent to the scan; beyond it they meet the texts in a join.
SENT_IDS = 1_000_000

#: Values of large groups, the most frequent ones, that are sent to the rows; the others meet their rows in a join.
SENT_VALUES = 131_072


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    return shingles(hashes_of(WORD.findall(lowered(text))), n) if text else np.zeros(0, np.uint64)


def sketches(documents: DataFrame, key: str, text: str, n: int, k: int | None) -> DataFrame:
    """(key, size, set_id, sketch): set_id is a 128-bit hash of the whole set, null for an empty one."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 512):
            sets = [shingle_set(x, n) for x in columns_of(batch, "text")[0]]
            ids = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(s[:k]) for s in sets])]).astype(np.int32)
            low = np.concatenate([s[:k] for s in sets]) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(low.view(np.int64)))], ["key", "size", "set_id", "sketch"])

    slim = documents.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return slim.mapInArrow(forgetting(run), "key long, size long, set_id binary, sketch array<long>")


def estimate(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """The share of the union's k smallest values that lie in both, in percent, from two sketches of k."""
    both = np.sort(np.concatenate([a, b]))
    again = both[1:] == both[:-1]
    place = np.cumsum(~again) + 1  # of the second on, among the union's values
    in_sketch = place <= k
    return 100 * int((again & in_sketch).sum()) / min(k, int(place[-1]))


def verified(sets: list[np.ndarray], label: list[int], left: np.ndarray, k: int | None, percent: int) -> list[tuple[int, int]]:
    """Links among ``sets`` that join their components, each checked on the full sets.

    ``label`` has what is linked already; ``left`` marks rows that pairs must have at least one of, if any.
    A pair without a link here is linked by others or isn't similar.
    """
    n = len(sets)
    parent = list(range(n))
    known: dict[int, int] = {}
    for i, c in enumerate(label):
        parent[i] = known.setdefault(c, i)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    sizes = np.array([len(s) for s in sets], np.int64)
    sketched, k = k is not None, k or int(sizes.max())
    share = percent - MARGIN if sketched else percent
    low = [s[:k] for s in sets]
    values, at = np.unique(np.concatenate(low), return_inverse=True)
    rows = np.repeat(np.arange(n), [len(x) for x in low])
    often = np.bincount(at, minlength=len(values))
    use = often[at] > 1
    columns, at = np.unique(at[use], return_inverse=True)
    rows = rows[use]
    order = np.argsort(at, kind="stable")
    at, rows = at[order], rows[order]
    shared = np.zeros((n, n), np.float32)
    for first in range(0, len(columns), 4096):
        part = slice(*np.searchsorted(at, [first, first + 4096]))
        m = np.zeros((n, min(4096, len(columns) - first)), np.float32)
        m[rows[part], at[part] - first] = 1
        shared += m @ m.T
    small, large = np.minimum(sizes[:, None], sizes[None]), np.maximum(sizes[:, None], sizes[None])
    # what lies in both of the union's sketch lies in both sketches, and the union's is no smaller than either
    keep = (100 * shared >= share * np.minimum(small, k)) & (100 * small >= percent * large)
    keep &= left[:, None] | left[None]
    i, j = np.nonzero(np.triu(keep, 1))
    order = np.argsort(-shared[i, j] / np.minimum(small[i, j], k), kind="stable")
    out = []
    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        x, y = root(a), root(b)
        if x == y or sketched and estimate(low[a], low[b], k) < share:
            continue
        s, t = (sets[a], sets[b]) if sizes[a] <= sizes[b] else (sets[b], sets[a])
        found = np.searchsorted(t, s)
        found[found == len(t)] = 0
        both = int((t[found] == s).sum())
        if 100 * both >= percent * (len(s) + len(t) - both):
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def links_of(tasks: DataFrame, k: int | None, percent: int) -> DataFrame:
    """(a, b): verified links of rows (g, i, j, key, label, outer, set) that share (g, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in pieces(batches, 256):
                yield from zip(*columns_of(batch, "g", "i", "j", "key", "label", "outer", "set"), strict=True)

        a, b = [], []
        for _, group in groupby(rows(), key=lambda r: r[:3]):
            mine = list(group)
            if len(mine) > 1:
                sets = [np.frombuffer(r[6], np.uint64) for r in mine]
                for x, y in verified(sets, [r[4] for r in mine], np.array([r[5] for r in mine]), k, percent):
                    a.append(mine[x][3])
                    b.append(mine[y][3])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    n = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tasks.repartition(n, "g", "i", "j").sortWithinPartitions("g", "i", "j", "key").mapInArrow(run, "a long, b long")


def listed_groups(rows: DataFrame, needed: Column, parts: int | None = None, often: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """(g, key): smaller groups of rows (g, key, n, values) that may hold similar pairs.

    Rows of one group that are similar share ``needed`` of their n values at least, so they share one of the
    n - ``needed`` + 1 that are the rarest in the group. Rows are listed under these, and lists with the same
    leading member are one group. ``often`` (g, v, df) is counted from the rows unless it is given; ``more`` (g, key, v)
    are places that are known already.
    """
    values = rows.select("g", "key", "n", F.explode("values").alias("v"))
    if often is None:
        often = values.groupBy("g", "v").agg(F.count("*").alias("df")).where("df > 1")
    # each row meets one at most; merged whatever the size, as neither side has a bound
    listed = values.join(often.hint("merge"), ["g", "v"]).groupBy("g", "key", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("s"))  # at most n each
    # values that no other has are the rarest; they take the first places and list nobody
    places = F.size("s") - needed + 1
    entries = listed.where(places > 0).select("g", "key", F.explode(F.slice("s", F.lit(1), places)).alias("x")).select("g", "key", F.col("x.v").alias("v"))
    entries = written(entries.unionByName(more) if more is not None else entries, "entries", parts)
    leaders = entries.groupBy("g", "v").agg(F.min(F.struct(F.xxhash64("key").alias("h"), F.col("key").alias("k"))).alias("m"), F.count("*").alias("c")).where("c > 1").select("g", "v", F.xxhash64("g", "m.k").alias("leader"))
    return entries.join(leaders.hint("merge"), ["g", "v"]).select(F.col("leader").alias("g"), "key").distinct()


def candidates(sketched: DataFrame, k: int | None, percent: int, parts: int | None = None) -> DataFrame:
    """(g, key): groups of classes that may hold similar pairs, from inverted lists of retained values."""
    n = F.size("sketch")
    share = percent - MARGIN if k else percent  # whole sets share as many values as asked
    return listed_groups(sketched.select(F.lit(0).cast("long").alias("g"), "key", n.alias("n"), F.col("sketch").alias("values")), F.ceil(F.col("n") * share / 100).cast("int"), parts)


def most_frequent(often: DataFrame, most: int) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], int]:
    """At most ``most`` of the values (g, v, df), as g: (values in order, df of each), and a df that these have at least and
    no other has."""
    top = often.select("g", "v", "df").orderBy(F.desc("df")).limit(most + 1).toArrow()
    g, v, df = (top[c].to_numpy() for c in ("g", "v", "df"))
    least = int(df.min()) + 1 if len(df) > most else 2
    order = np.lexsort((v, g))
    order = order[df[order] >= least]
    g, v, df = g[order], v[order], df[order]
    ids, at = np.unique(g, return_index=True)
    ends = np.append(at[1:], len(g))
    return {int(i): (v[a:b], df[a:b]) for i, a, b in zip(ids, at, ends, strict=False)}, least  # without ids there is an end


def split_places(made: np.ndarray, values: np.ndarray, df: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of a whole set: those not among the frequent ``values``, the frequent ones that get a place if all of these have
    one, and how many of the others must be shared by a row without such a place."""
    at = np.searchsorted(values, made)
    common = at < len(values)
    common[common] = values[at[common]] == made[common]
    rest, often = made[~common], made[common]
    places = len(made) * (100 - percent) // 100 + 1
    return rest, often[np.lexsort((often, df[at[common]]))][: max(0, places - len(rest))], len(rest) + 1 - places


def narrowed(many: DataFrame, sets: DataFrame, percent: int, parts: int | None = None) -> DataFrame:
    """(g, key): rows (g, key, outer) of large groups in the groups that the rarest values of their whole sets make.

    A template that many rows have is among the rarest values only of rows that have little else. Its values, the most
    frequent ones, are sent to the rows, which then know the places of these by themselves; only the others meet their
    counts in a join. Groups without an outer row are left out.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            made = [np.frombuffer(x, np.int64) for x in columns_of(batch, "set")[0]]
            g, v = np.repeat(batch.column(0).to_numpy(), [len(x) for x in made]), np.concatenate(made)
            order = np.lexsort((v, g))
            g, v = g[order], v[order]
            at = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g[at], v[at], np.diff(np.append(at, len(g))))], ["g", "v", "c"])

    paired = many.select("g", "key").join(sets, "key").select("g", "key", "set")
    often = paired.mapInArrow(counted, "g long, v long, c long").groupBy("g", "v").agg(F.sum("c").alias("df"))
    often = written(often.where("df > 1"), "often", parts)
    top, least = most_frequent(often, SENT_VALUES)
    told = checked_broadcast(top, 16 * SENT_VALUES, many.sparkSession, "frequent values")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in pieces(batches, 256):
            made = [split_places(np.frombuffer(x, np.int64), *told.value.get(g, none), percent) for g, x in zip(*columns_of(batch, "g", "set"), strict=True)]
            rest, placed, needed = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(needed, pa.int32()), *(pa.array(x, pa.list_(pa.int64())) for x in (rest, placed))], ["g", "key", "n", "values", "placed"])

    rows = written(paired.mapInArrow(split, "g long, key long, n int, values array<long>, placed array<long>"), "rest", parts)
    placed = rows.select("g", "key", F.explode("placed").alias("v"))
    groups = written(listed_groups(rows, F.col("n"), parts, often.where(F.col("df") < least), placed), "narrowed", parts)
    outer = groups.join(many.where("outer").select("key").distinct(), "key").select("g").distinct()
    return groups.join(outer, "g", "left_semi")


def sent(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` with or without those of ``ids``, which are sent to them up to ``SENT_IDS``."""
    return rows.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, key, how)


def full_sets(documents: DataFrame, wanted: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, set, bytes) of the documents whose keys are ``wanted``."""
    slim = documents.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    slim = sent(slim, wanted, "key", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            made = [shingle_set(x, n).tobytes() for x in columns_of(batch, "text")[0]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), pa.array([len(x) for x in made], pa.int64())], ["key", "set", "bytes"])

    return slim.mapInArrow(forgetting(run), "key long, set binary, bytes long").where("bytes > 0").dropDuplicates(["key"])


def similar_links(documents: DataFrame, sketched: DataFrame, key: str, text: str, n: int, k: int | None, percent: int, parts: int | None = None) -> DataFrame:
    """(node, component) of the classes that are linked with another."""
    groups = written(candidates(sketched, k, percent, parts), "groups", parts)
    sets = written(full_sets(documents, groups.select("key").distinct(), key, text, n), "sets", parts)
    sized = groups.join(sets.select("key", "bytes"), "key")
    sizes = sized.groupBy("g").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")).where("rows > 1")
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    placed = groups.join(sizes.select("g", blocks.alias("nb")), "g").withColumn("block", F.pmod(F.xxhash64("key"), F.col("nb")).cast("int"))
    placed = written(placed, "placed", parts)
    # each block with itself; the first also with every other
    first = F.when(F.col("block") == 0, F.array_union(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))), F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(F.lit(0).alias("i"), j.alias("j"))))).otherwise(F.array(F.struct(F.col("block").alias("i"), F.col("block").alias("j")), F.struct(F.lit(0).alias("i"), F.col("block").alias("j"))))
    tasks = placed.select("g", "key", F.explode(first).alias("t")).select("g", "t.i", "t.j", "key", F.col("key").alias("label"), F.lit(True).alias("outer"))
    links = written(links_of(tasks.join(sets.drop("bytes"), "key"), k, percent), "links", parts)
    found = components(links, parts=parts or 1 << 30)
    many = placed.where("nb > 2").select("g", "key")
    if many.isEmpty():
        return found
    found = written(found, "found", parts)
    label = found.withColumnRenamed("node", "key").withColumnRenamed("component", "label")
    outside = written(with_outer(many, label).join(sets.select("key", "bytes"), "key"), "outside", parts)
    counts = block_counts(outside)
    several = outside.join(counts.where(F.col("no") > FEW).select("g"), "g", "left_semi")
    small = outside.join(counts.where(F.col("no") <= FEW).select("g"), "g", "left_semi")
    if not several.isEmpty():
        small = small.unionByName(with_outer(narrowed(several, sets, percent, parts), label).join(sets.select("key", "bytes"), "key"))
    small = written(small, "again", parts)
    counts = block_counts(small)
    labelled = small.drop("bytes").join(counts, "g").withColumns({"block": F.pmod(F.xxhash64("key"), F.col("nb")).cast("int"), "own": F.pmod(F.xxhash64("key"), F.col("no")).cast("int")})
    # outer block i meets every outer block and every block of the main component
    with_own = F.transform(F.sequence(F.lit(0), F.col("no") - 1), lambda i: F.struct(F.least(i, F.col("own")).alias("i"), F.greatest(i, F.col("own")).alias("j")))
    with_main = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(F.col("own").alias("i"), (-1 - j).alias("j")))
    as_main = F.transform(F.sequence(F.lit(0), F.col("no") - 1), lambda i: F.struct(i.alias("i"), (-1 - F.col("block")).alias("j")))
    again = labelled.select("g", "key", "label", "outer", F.explode(F.when(F.col("outer"), F.concat(with_own, with_main)).otherwise(as_main)).alias("t")).select("g", "t.i", "t.j", "key", "label", "outer")
    more = links_of(again.join(sets.drop("bytes"), "key"), k, percent)
    stars = found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(more.unionByName(stars), parts=parts or 1 << 30)


def block_counts(rows: DataFrame) -> DataFrame:
    """(g, nb, no): how many blocks a group (g, outer, bytes) has, and its outer rows; only groups that have some."""
    outer_bytes = F.sum(F.when(F.col("outer"), F.col("bytes")))
    nb = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")
    no = F.greatest(F.ceil(F.count_if("outer") / BLOCK_ROWS), F.ceil(outer_bytes / BLOCK_BYTES)).cast("int")
    return rows.groupBy("g").agg(nb.alias("nb"), no.alias("no")).where("no > 0")


def with_outer(groups: DataFrame, label: DataFrame) -> DataFrame:
    """(g, key, label, outer): the component that each row is known to be in, and whether it isn't the group's most frequent one."""
    labelled = groups.join(label, "key", "left").withColumn("label", F.coalesce("label", "key"))
    main = labelled.groupBy("g", "label").agg(F.count("*").alias("c")).groupBy("g").agg(F.max(F.struct("c", "label")).alias("m")).select("g", F.col("m.label").alias("main"))
    return labelled.join(main, "g").select("g", "key", "label", (F.col("label") != F.col("main")).alias("outer"))


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75, k: int | None = 64) -> DataFrame:
    """One row per row of ``documents``: key, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= ``percent`` * union of their shingle sets. Null, empty and
    blank texts have no set, are linked with nothing and kept. A text of fewer words than ``n`` has one
    shingle, all its words. Rows with the same key are one document and have equal results as long as their
    texts are equal; rows without a key, whatever their text, are linked with nothing and have a null component. Equal
    rows, extra columns and an empty table need no care. Keys are integers.

    Of two sets as similar as asked the estimate from the union's sketch falls short by more than ``MARGIN`` with a
    chance of about 2e-6 at the threshold itself, far less above it, and never where both have at most ``k`` shingles.
    With ``k`` None whole sets are listed and no link is lost, at the price of larger lists. Texts of any length
    are used whole.
    """
    documents = text_batches(documents)
    parts = parts_of(documents)
    sketched = written(sketches(documents, key, text, n, k), "sketches")
    classes = written(sketched.where("set_id IS NOT NULL AND key IS NOT NULL").groupBy("set_id").agg(F.min("key").alias("class")), "classes", parts)
    members = sketched.select("key", "size", "set_id").join(classes, "set_id", "left")
    of_class = classes.select(F.col("class").alias("key"))
    found = similar_links(documents, sketched.join(of_class, "key", "left_semi").dropDuplicates(["key"]), key, text, n, k, percent, parts)
    labelled = members.join(found.select(F.col("node").alias("class"), "component"), "class", "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component", "class", "key")).alias("component_id")
    out = labelled.select("key", F.col("size").alias("n_shingles"), component)
    return out.select(F.col("key").alias(key), "n_shingles", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept")).coalesce(parts)
