"""Lexical, vector and hybrid search; every ranking ends with the id, so ties are decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring, text
from .lineage import kept


def like_any(df: DataFrame, query: str) -> DataFrame:
    """Rows whose title, summary or content match ``%query%`` without regard to case; % and _ stay wildcards."""
    p = f"%{query}%"
    return df.where(F.col("title").ilike(p) | F.col("summary").ilike(p) | F.col("content").ilike(p))


def contains_ci(df: DataFrame, query: str) -> DataFrame:
    """The same without wildcards."""
    return df.where(F.contains(F.lower(F.concat_ws("\n", "title", "summary", "content")), F.lit(query.lower())))


def lexical_scores(df: DataFrame, query: str, now: int) -> DataFrame:
    """Hits with similarity, recency and score."""
    return scored(contains_ci(df, query), query, now)


def scored(rows: DataFrame, query: str, now: int) -> DataFrame:
    """Rows with similarity, recency and score, whether or not they contain the query."""
    age = F.lit(now) - F.col("lastAccessedAt")
    sim = scoring.lexical_similarity(F.col("title"), F.col("summary"), F.col("content"), query)
    return rows.select("*", sim.alias("similarity"), scoring.temporal_score(age).alias("recency"), scoring.hybrid_score(sim, F.col("importance"), age).alias("score"))


def best(rows: DataFrame, k: int, min_score: float) -> DataFrame:
    return rows.where(F.col("score") >= min_score).orderBy(F.desc("score"), "id").limit(k)


def search_main(rows: DataFrame, vectors: DataFrame | None, query: str, now: int, k: int, min_score: float = 0.0, vector: list[float] | None = None) -> DataFrame:
    """A search of stored rows: the newest 3 ``k`` that match ``%query%`` as stored; if they are fewer, also those of the
    newest rows whose restored contents contain the query; and the nearest 3 ``k`` vectors."""
    from ..functions import codec

    newest = [F.desc("lastAccessedAt"), F.asc("id")]
    most = 3 * k
    stored = like_any(rows, query).orderBy(*newest).limit(most).withColumn("order", F.lit(0))
    recent = rows.orderBy(*newest).limit(min(1500, max(250, 40 * k)))
    filled = codec.analysed(recent).withColumn("content", F.col("restored")).select(rows.columns)
    more = contains_ci(filled, query).join(stored.select("id"), "id", "left_anti").select(rows.columns).withColumn("order", F.lit(1))
    opened = codec.analysed(stored).withColumn("content", F.col("restored")).select(*rows.columns, "order")
    lexical = scored(opened.unionByName(more).orderBy("order", *newest).limit(most).drop("order"), query, now)
    if vectors is None or vector is None:
        return best(lexical, k, min_score)
    age = F.lit(now) - F.col("lastAccessedAt")
    hits = nearest_vectors(vectors, vector, most)
    near = codec.analysed(hits.join(rows, "id")).withColumn("content", F.col("restored")).select(*rows.columns, "similarity")
    near = near.select(*rows.columns, "similarity", scoring.temporal_score(age).alias("recency"), scoring.hybrid_score(F.col("similarity"), F.col("importance"), age).alias("score"))
    both = lexical.unionByName(near)
    first = F.struct(*(c for c in rows.columns if c != "id"))
    return best(both.groupBy("id").agg(F.first(first).alias("r"), F.max("similarity").alias("similarity"), F.first("recency").alias("recency"), F.max("score").alias("score")).select("id", "r.*", "similarity", "recency", "score"), k, min_score)


def nearest_vectors(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, similarity) of the ``k`` vectors of greatest cosine."""
    q = F.array(*map(F.lit, query))
    return vectors.select("id", scoring.cosine(F.col("embedding"), q).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)


def hybrid_search(memories: DataFrame, vectors: DataFrame, query: str, vector: list[float], now: int, k: int = 10, min_score: float = 0.0, caps: bool = True) -> DataFrame:
    """Lexical and vector candidates joined by id; similarity and score are the greater of both.

    With ``caps`` the lexical side keeps its newest 3k and the vector side its nearest 3k, as the parameters
    of a top-k search; without, every hit competes.
    """
    age = F.lit(now) - F.col("lastAccessedAt")
    lex = lexical_scores(memories, query, now)
    if caps:
        lex = lex.orderBy(F.desc("lastAccessedAt"), "id").limit(3 * k)
    hits = nearest_vectors(vectors, vector, 3 * k)
    vec = hits.join(memories, "id").select("id", "title", "importance", "lastAccessedAt", "similarity", scoring.hybrid_score(F.col("similarity"), F.col("importance"), age).alias("score"))
    a = lex.select("id", F.struct("title", "similarity", "score", "recency").alias("l"))
    b = vec.select("id", F.struct("title", "similarity", "score", scoring.temporal_score(age).alias("recency")).alias("v"))
    both = a.join(b, "id", "full_outer").select("id", F.coalesce("l.title", "v.title").alias("title"), *(F.greatest(F.coalesce(f"l.{c}", F.lit(0.0)), F.coalesce(f"v.{c}", F.lit(0.0))).alias(c) for c in ("similarity", "score")), F.coalesce("l.recency", "v.recency").alias("recency"))
    return both.where(F.col("score") >= min_score).orderBy(F.desc("score"), "id").limit(k)


def dedupe_best(df: DataFrame, key: str = "id", score: str = "score") -> DataFrame:
    """The best row of each id."""
    w = Window.partitionBy(key).orderBy(F.desc(score), *[c for c in ("createdAt",) if c in df.columns])
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def token_search(memories: DataFrame, query: str, now: int, k: int = 10, project: str | None = None, preferred: tuple[str, ...] = (), archived: DataFrame | None = None) -> DataFrame:
    """The best ``k`` rows by the weighted memory score: those whose title, summary or tags share a word with the query;
    if none does, all of the project. Rows among ``archived`` (id) don't count. Blank queries find nothing."""
    import re

    words = [w for w in re.split(r"[^a-z0-9_]+", query.lower()) if len(w) > 1]
    pool = memories.where(F.col("projectId") == project) if project else memories
    pool = pool.where(F.lit(bool(query.strip())))
    if words:
        have = text.tokenize_words(F.concat_ws("\n", "title", "summary", F.array_join("tags", " ")))
        pool = pool.withColumn("__hit", F.arrays_overlap(have, F.array(*map(F.lit, words))))
        some = pool.agg(F.coalesce(F.max("__hit"), F.lit(False)).alias("__some"))  # one row
        pool = pool.crossJoin(F.broadcast(some)).where("__hit OR NOT __some").drop("__hit", "__some")
    if archived is not None:
        pool = pool.join(archived.select("id"), "id", "left_anti")
    return best_by_words(pool, query, now, k, project, preferred)


def best_by_words(pool: DataFrame, query: str, now: int, k: int, project: str | None, preferred: tuple[str, ...]) -> DataFrame:
    """The best ``k`` rows by the weighted memory score."""
    lex = scoring.token_similarity(F.col("title"), F.col("summary"), F.col("content"), query)
    tags = F.size(F.array_intersect("tags", F.array(*map(F.lit, preferred)).cast("array<string>"))) if preferred else F.lit(0)
    same = F.lit(project is not None)
    score = scoring.memory_score(F.col("importance"), F.col("confidence"), F.lit(now) - F.col("lastAccessedAt"), lex, same, tags)
    return pool.select("id", "kind", "title", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def touched(memories: DataFrame, found: DataFrame, now: int) -> DataFrame:
    """``memories`` after those found were read."""
    hit = found.select("id", F.lit(True).alias("__hit"))
    return memories.join(hit, "id", "left").withColumn("lastAccessedAt", F.when(F.col("__hit"), F.lit(now)).otherwise(F.col("lastAccessedAt"))).drop("__hit")


def store_stats(memories: DataFrame, archived: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """A row per kind, also of those without rows: total, active and archived rows."""
    gone = archived.select("id").distinct().withColumn("__gone", F.lit(True))
    counted = memories.join(gone, "id", "left").groupBy("kind").agg(F.count("*").alias("total"), F.count_if(F.col("__gone").isNull()).alias("active"), F.count_if(F.col("__gone")).alias("archived"))
    every = memories.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    return F.broadcast(every).join(counted, "kind", "left").fillna(0, ["total", "active", "archived"])


def rerank(memories: DataFrame, query: str, now: int, k: int, diversify: bool = False) -> DataFrame:
    """Rows by signal; diversified, the kinds take turns in the order of their best rows."""
    affinity = scoring.lexical_affinity(F.col("title"), F.col("summary"), F.col("content"), query)
    ranked = memories.select("id", "kind", "importance", "confidence", "lastAccessedAt", scoring.rerank_signal(F.col("importance"), F.col("confidence"), F.lit(now) - F.col("lastAccessedAt"), affinity).alias("signal"))
    order = [F.desc(F.round("signal", 9)), F.desc("importance"), F.desc("confidence"), F.desc("lastAccessedAt"), F.asc("id")]
    if not diversify:
        return ranked.orderBy(*order).limit(k)
    ranked = ranked.withColumn("turn", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).where(F.col("turn") <= k)
    first = ranked.where("turn = 1").select(F.col("kind"), F.row_number().over(Window.orderBy(*order)).alias("kindRank"))  # a row per kind
    return ranked.join(F.broadcast(first), "kind").orderBy("turn", "kindRank").limit(k)


def fuzzy_classes(df: DataFrame, threshold: float = 0.72) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs): the class of each row that has words, and (a, b, jaccard) of similar classes, a < b.

    Rows of one project and kind whose titles and summaries have equal shingles are one class, named by its least
    id. Prefix filtering: sets of similarity t share one of their (1 - t) * n + 1 rarest shingles, so only classes
    that do, and whose sizes, places in the order and marks allow it, are joined; the whole sets verify. Numbers stand
    for classes and shingles until then; equal ones of different shingles only bring pairs that the sets refuse.
    """
    keys = ["projectId", "kind"]
    sets = df.dropna(subset=keys).select("id", *keys, text.shingle(F.concat_ws(" ", "title", "summary")).alias("s")).where(F.size("s") > 0)
    sets = kept(sets.withColumn("h", F.sha1(F.concat_ws("\x01", F.array_sort("s")))), "shingles")  # used several times
    first = sets.groupBy(*keys, "h").agg(F.min("id").alias("class"))
    classes = sets.select("id", *keys, "h").join(first, [*keys, "h"]).select("id", "class")
    one = sets.join(first.select(F.col("class").alias("id")), "id", "left_semi").select("id", *keys, "s", F.size("s").alias("n"), F.transform("s", lambda x: F.xxhash64(*keys, x)).alias("x"))
    one = kept(one.select("id", *keys, "s", "n", "x", *marks(F.col("x"))).withColumn("no", F.monotonically_increasing_id()), "shingle-classes")
    each = one.select("no", F.explode("x").alias("x"))
    often = each.groupBy("x").agg(F.count("*").alias("c")).where("c > 1")
    listed = each.join(often, "x").groupBy("no").agg(F.sort_array(F.collect_list(F.struct("c", "x"))).alias("o"))  # at most one per word
    listed = listed.join(one.select("no", "n", "low", "high"), "no")
    # shingles that no other class has are the rarest; they take the first places and list nobody
    alone = F.col("n") - F.size("o")
    places = (F.size("o") - F.ceil(F.col("n") * threshold) + 1).cast("int")
    listed = listed.where(places > 0).select("no", "n", "low", "high", alone.alias("alone"), F.posexplode(F.slice("o", F.lit(1), places)).alias("p", "o")).select("no", "n", "low", "high", (F.col("n") - F.col("alone") - F.col("p")).alias("rest"), F.col("o.x").alias("x"))
    left, right = (listed.select("x", *(F.col(c).alias(c + side) for c in ("no", "n", "low", "high", "rest"))) for side in "ab")
    total = F.col("na") + F.col("nb")
    sized = (F.col("noa") < F.col("nob")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold)
    # a pair's first common shingle and what follows it are all that both may share
    placed = F.least("resta", "restb") >= total * (threshold / (1 + threshold)) - 1e-6
    apart = F.bit_count(F.col("lowa").bitwiseXOR(F.col("lowb"))) + F.bit_count(F.col("higha").bitwiseXOR(F.col("highb")))
    marked = apart <= total * ((1 - threshold) / (1 + threshold)) + 1e-6
    pairs = left.join(right, "x").where(sized & placed & marked).select("noa", "nob").distinct()
    of = lambda side: one.select(*(F.col(c).alias(c + side) for c in ("no", "id", "s", "n", *keys)))
    both = pairs.join(of("a"), "noa").join(of("b"), "nob").where(" AND ".join(f"{c}a = {c}b" for c in keys)).withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    found = both.select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b"), (F.col("shared") / (total - F.col("shared"))).alias("jaccard"))
    return classes, found.where(F.col("jaccard") >= threshold)


def marks(x: Column) -> list[Column]:
    """(low, high): 128 bits, each flipped by every number of ``x`` that falls on it. Two sets differ in as many numbers as
    bits, at least."""

    def of(word: int) -> Column:
        mine = F.filter(x, lambda h: h.bitwiseAND(F.lit(64)) == 64 * word)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda m, h: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))))

    return [of(0).alias("low"), of(1).alias("high")]
