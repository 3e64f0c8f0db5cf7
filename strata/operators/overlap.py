"""The texts that share most words with another: an exact top-k join over postings, rare words first.

A text's words are taken from rare to frequent. Two texts meet at the rarest word they share, and only there, and
their whole sets of words give the count at once. As soon as k + 1 texts are known that share s words or more, a
better one must share one of all but the s - 1 most frequent words, so those are never joined.

Where the words that must be joined are so frequent that a text would meet more others than counting all of them
costs, it is counted: blocks of texts meet blocks of texts, and an array has a number of shared words for each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from .lineage import kept

#: Words of a text that are joined before its bound is taken anew.
ROUNDS = (4, 16)

#: Texts that one may meet in a join for each block that counting it would take.
MEET = 64

#: Rows, and words, in a block of texts; rows, and bytes of words, in a block of those that ask.
BLOCK_ROWS, BLOCK_WORDS, ASK_ROWS, ASK_BYTES = 1 << 15, 1 << 19, 1 << 14, 8 << 20


def first_rows(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key; tasks drop the others before they are dealt out."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def text_classes(listed: DataFrame, n: int) -> DataFrame:
    """(grp, t, ids, have): equal texts of a group once, with their first ``n`` ids and distinct words; wordless ones go."""
    each = first_rows(listed.where("grp IS NOT NULL AND t IS NOT NULL").select("grp", "t", "id"), ["grp", "t"], ["id"], n)
    made = each.groupBy("grp", "t").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return made.withColumn("have", F.array_distinct(text.tokenize_words(F.col("t")))).where(F.size("have") > 0)


def best_counts(asked: pa.Table, listed: pa.Table, most: int) -> pa.Table:
    """(grp, key, s, ids): for each of ``asked`` (grp, key) the ``most`` rows of ``listed`` (words, ids) that share most
    words with it, at least one; ties by the first id. ``s`` is the negative number of shared words."""
    listed = listed.take(pc.sort_indices(listed["first"]))
    have, want = (pc.split_pattern(t[c].combine_chunks(), " ") for t, c in ((listed, "words"), (asked, "key")))
    coded = have.flatten().dictionary_encode()
    code, sizes = coded.indices.to_numpy(), pc.list_value_length(have).to_numpy()
    order = np.argsort(code, kind="stable")
    often = np.bincount(code, minlength=len(coded.dictionary))
    postings = np.split(np.repeat(np.arange(len(have)), sizes)[order], np.cumsum(often)[:-1])
    kind = np.min_scalar_type(int(sizes.max()))
    # a frequent word is a number for each text; the words of a block bound how many are
    dense = {}
    for c in np.flatnonzero(often * 64 > len(have)).tolist():
        dense[c] = np.zeros(len(have), kind)
        dense[c][postings[c]] = 1
    found = pc.fill_null(pc.index_in(want.flatten(), value_set=coded.dictionary), -1).to_numpy()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(want).to_numpy())]).tolist()
    shared, at, rows, counts = np.zeros(len(have), kind), [], [], []
    for i in range(len(want)):
        shared[:] = 0
        for c in found[ends[i] : ends[i + 1]].tolist():
            if c in dense:
                shared += dense[c]
            elif c >= 0:
                shared[postings[c]] += 1
        low, high = 1, int(shared.max())  # the greatest number that enough texts share
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if np.count_nonzero(shared >= mid) >= most else (low, mid - 1)
        hits = np.flatnonzero(shared >= low)
        n = shared[hits]
        more = hits[n > low]
        best = np.concatenate([more, hits[n == low][: max(0, most - len(more))]])
        at.append(np.full(len(best), i))
        rows.append(best)
        counts.append(shared[best])
    at, rows, counts = (np.concatenate(x) for x in (at, rows, counts))
    key = asked.take(pa.array(at))
    return pa.table({"grp": key["grp"], "key": key["key"], "s": pa.array(-counts.astype(np.int32)), "ids": listed["ids"].take(pa.array(rows))})


def counted(heavy: DataFrame, titles: DataFrame, most: int) -> DataFrame:
    """(grp, key, s, ids): the best ``most`` of each block of ``titles`` for each of ``heavy`` (grp, key, nb); a task
    holds a block of both."""
    parts = F.greatest(F.ceil(F.count("*") / ASK_ROWS), F.ceil(F.sum(F.length("key")) / ASK_BYTES)).cast("int")
    cut = heavy.groupBy("grp").agg(parts.alias("na"), F.first("nb").alias("nb"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = heavy.join(cut.select("grp", "na"), "grp").select("grp", F.pmod(F.xxhash64("key"), F.col("na")).cast("int").alias("i"), numbers("nb").alias("j"), "key")
    listed = titles.join(cut, "grp").select("grp", numbers("na").alias("i"), F.pmod(F.xxhash64("t"), F.col("nb")).cast("int").alias("j"), F.col("ids")[0].alias("first"), F.array_join("have", " ").alias("words"), "ids")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            return best_counts(left, right, most)
        return pa.table({"grp": pa.array([], pa.string()), "key": pa.array([], pa.string()), "s": pa.array([], pa.int32()), "ids": pa.array([], pa.list_(pa.string()))})

    n, cell = int(heavy.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["grp", "i", "j"]
    left, right = (x.repartition(n, *cell).groupBy(*cell) for x in (asked, listed))
    return left.cogroup(right).applyInArrow(run, "grp string, key string, s int, ids array<string>")


def top_overlaps(asking: DataFrame, listed: DataFrame, k: int, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """(id, place, near, shared): for each of ``asking`` (id, grp, t, own) the ``k`` rows of ``listed`` (id, grp, t) in
    its group, but the one with the id ``own``, whose texts share most distinct words with it, at least one; ties
    by id. Exact. Rows without a group, text or words have none.

    Equal texts are searched once on both sides. In joins no two texts meet that share no word, and each pair meets
    once; those that would meet more than ``MEET`` others a block are counted against their group's blocks.
    """
    titles = kept(text_classes(listed, k + 1), "overlap-texts")
    posted = titles.select("grp", F.explode("have").alias("word"), "ids", "have")
    counts = posted.groupBy("grp", "word").agg(F.count("*").alias("n"))
    asked = asking.where("grp IS NOT NULL AND t IS NOT NULL").withColumn("key", F.array_join(F.array_sort(F.array_distinct(text.tokenize_words(F.col("t")))), " "))
    mine = kept(asked.select("id", "grp", "key", "own"), "overlap-asked")
    words = mine.select("grp", "key").distinct().select("grp", "key", F.explode(F.split("key", " ")).alias("word")).join(counts, ["grp", "word"])
    ranked = words.groupBy("grp", "key").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("w")).select("grp", "key", F.col("w.word").alias("words"), F.col("w.n").alias("often"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(F.size("have")) / BLOCK_WORDS)).cast("int")
    sizes = titles.groupBy("grp").agg(blocks.alias("nb"), F.max(F.size("have")).alias("longest"))
    state = kept(ranked.join(sizes, "grp").withColumns({"upto": F.lit(0), "counted": F.lit(False)}), "overlap-words")

    best: DataFrame | None = None
    for target in (*rounds, None):
        bound = F.size("words")
        if best is not None:
            known = best.groupBy("grp", "key").agg(F.count("*").alias("n"), F.max("s").alias("worst"))
            state = state.join(known, ["grp", "key"], "left")
            bound = F.when(F.col("n") > k, F.size("words") + F.col("worst") + 1).otherwise(bound)
        to = F.greatest("upto", F.least(bound, F.lit(target)) if target else bound)
        # however many words others share, those beyond the longest text's must be joined
        must = F.greatest(to, F.least(bound, F.size("words") - F.col("longest") + 1))
        meets = F.aggregate(F.slice("often", F.col("upto") + 1, must - F.col("upto")), F.lit(0).cast("long"), lambda x, n: x + n)
        state = state.withColumn("counted", F.col("counted") | (meets > MEET * F.col("nb")))
        state = state.withColumn("to", F.when(F.col("counted"), F.col("upto")).otherwise(to)).select("grp", "key", "words", "often", "nb", "longest", "upto", "to", "counted")
        each = state.where("to > upto").select("grp", "key", "words", F.explode(F.expr("slice(words, upto + 1, to - upto)")).alias("word"))
        met = each.join(posted, ["grp", "word"]).withColumn("both", F.array_intersect("words", "have")).where(F.get("both", F.lit(0)) == F.col("word"))
        found = met.select("grp", "key", (-F.size("both")).alias("s"), "ids")
        best = kept(first_rows(found if best is None else best.unionByName(found), ["grp", "key"], ["s", F.col("ids")[0]], k + 1), "overlap-best")
        state = state.drop("upto").withColumnRenamed("to", "upto")

    heavy = kept(state.where("counted").select("grp", "key", "nb"), "overlap-counted")
    if not heavy.isEmpty():
        found = first_rows(counted(heavy, titles, k + 1), ["grp", "key"], ["s", F.col("ids")[0]], k + 1)
        best = kept(best.join(heavy.select("grp", "key"), ["grp", "key"], "left_anti").unionByName(found), "overlap-best")

    near = mine.select("id", "grp", "key", "own").join(best, ["grp", "key"]).select("id", "own", "s", F.explode("ids").alias("near")).where("own IS NULL OR near <> own")
    place = F.row_number().over(Window.partitionBy("id").orderBy("s", "near"))  # at most (k + 1)^2 rows of an id
    return near.select("id", place.alias("place"), "near", (-F.col("s")).alias("shared")).where(F.col("place") <= k)
