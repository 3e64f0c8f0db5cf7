"""Queries over memories: scans, filters, retrieval, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, scoring, text
from ..operators import compaction, retrieval
from ..sources import tables as T
from .registry import MEM, NOW, query

Q = "the"
VEC = 1  # the query vector is this embedding


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "embeddings").select(F.concat(F.lit("doc_"), F.col("vec_id").cast("string")).alias("id"), "embedding")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """One stored vector, which a caller would have embedded."""
    return [float(x) for x in T.read(spark, sf_dir, "embeddings").where(F.col("vec_id") == VEC).select("embedding").first()[0]]


COS = f"list_dot_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(q, q)))"
QV = f"qv AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = {VEC})"
LEX = f"""lex AS (SELECT *, CASE WHEN contains(lower(title), '{Q}') OR contains(lower(summary), '{Q}') THEN 0.82::DOUBLE WHEN contains(lower(content), '{Q}') THEN 0.72::DOUBLE ELSE 0.6::DOUBLE END AS similarity,
  exp(-1e-8::DOUBLE * greatest(0, {NOW} - lastAccessedAt)) AS recency FROM mem WHERE contains(lower(title || chr(10) || summary || chr(10) || content), '{Q}')),
lexs AS (SELECT *, 0.5::DOUBLE * similarity + 0.3::DOUBLE * importance + 0.2::DOUBLE * recency AS score FROM lex)"""
HYBRID = f"""WITH {MEM}, {LEX}, {QV}, l AS (SELECT * FROM lexs ORDER BY lastAccessedAt DESC, id LIMIT 30),
vs AS (SELECT 'doc_' || vec_id AS id, {COS} AS similarity FROM embeddings, qv), vt AS (SELECT * FROM vs ORDER BY similarity DESC, id LIMIT 30),
v AS (SELECT m.id, m.title, vt.similarity, exp(-1e-8::DOUBLE * greatest(0, {NOW} - lastAccessedAt)) AS recency, 0.5::DOUBLE * vt.similarity + 0.3::DOUBLE * importance + 0.2::DOUBLE * exp(-1e-8::DOUBLE * greatest(0, {NOW} - lastAccessedAt)) AS score FROM vt JOIN mem m USING (id))
SELECT coalesce(l.id, v.id) AS id, coalesce(l.title, v.title) AS title, round(greatest(coalesce(l.similarity, 0), coalesce(v.similarity, 0)), 6) AS similarity,
  round(greatest(coalesce(l.score, 0), coalesce(v.score, 0)), 6) AS score, round(coalesce(l.recency, v.recency), 6) AS recency FROM l FULL JOIN v ON l.id = v.id ORDER BY greatest(coalesce(l.score, 0), coalesce(v.score, 0)) DESC, id LIMIT 10"""


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at six places, on both sides of a comparison."""
    return df.select([F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(HYBRID)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return rounded(retrieval.hybrid_search(T.memories(spark, d), vectors(spark, d), Q, query_vector(spark, d), NOW))


@query(f"WITH {MEM} SELECT projectId, count(*) AS n, sum(length(content)) AS chars, max(lastAccessedAt) AS newest FROM mem GROUP BY projectId")
def scan_memories(spark, d):
    return T.memories(spark, d).groupBy("projectId").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"), F.max("lastAccessedAt").alias("newest"))


@query(f"WITH {MEM} SELECT id, title, lastAccessedAt FROM mem WHERE projectId = 'src3' AND (title ILIKE '%th%' OR summary ILIKE '%th%' OR content ILIKE '%th%') ORDER BY lastAccessedAt DESC, id LIMIT 20")
def scan_branch_scope(spark, d):
    rows = retrieval.like_any(T.memories(spark, d).where("projectId = 'src3'"), "th")
    return rows.select("id", "title", "lastAccessedAt").orderBy(F.desc("lastAccessedAt"), "id").limit(20)


@query(f"WITH {MEM} SELECT id, projectId, kind, sourceType, title, importance, confidence FROM mem WHERE id = 'doc_42'")
def get_by_id(spark, d):
    return T.memories(spark, d).where("id = 'doc_42'").select("id", "projectId", "kind", "sourceType", "title", "importance", "confidence")


@query(f"WITH {MEM} SELECT id, kind FROM mem WHERE id IN (SELECT 'doc_' || o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def lookup_in_list(spark, d):
    ids = T.read(spark, d, "orders").where("o_orderstatus = 'O'").select(F.concat(F.lit("doc_"), F.col("o_orderkey").cast("string")).alias("id"))
    return T.memories(spark, d).join(ids, "id", "left_semi").select("id", "kind")


@query(f"WITH {MEM} SELECT id FROM mem WHERE title ILIKE '%on_the%' OR summary ILIKE '%on_the%' OR content ILIKE '%on_the%'")
def like_any(spark, d):
    return retrieval.like_any(T.memories(spark, d), "on_the").select("id")


@query(f"WITH {MEM} SELECT id FROM mem WHERE contains(lower(title || chr(10) || summary || chr(10) || content), 'and the')")
def contains_ci(spark, d):
    return retrieval.contains_ci(T.memories(spark, d), "AND the").select("id")


@query(f"WITH {MEM}, {LEX} SELECT id, similarity, round(recency, 6) AS recency, round(score, 6) AS score FROM lexs WHERE score >= 0.55")
def score_from_lexical(spark, d):
    return rounded(retrieval.lexical_scores(T.memories(spark, d), Q, NOW).where("score >= 0.55").select("id", "similarity", "recency", "score"))


@query(f"WITH {QV} SELECT vec_id, round({COS}, 6) AS similarity FROM embeddings, qv ORDER BY {COS} DESC, 'doc_' || vec_id LIMIT 30")
def vector_scan(spark, d):
    hits = retrieval.nearest_vectors(vectors(spark, d), query_vector(spark, d), 30)
    return rounded(hits.select(F.substring("id", 5, 20).cast("long").alias("vec_id"), "similarity"))


@query(f"WITH {MEM}, e AS (SELECT 'doc_' || vec_id AS id, label FROM embeddings) SELECT id, kind, label FROM mem JOIN e USING (id)")
def vector_hit_lookup(spark, d):
    v = T.read(spark, d, "embeddings").select(F.concat(F.lit("doc_"), F.col("vec_id").cast("string")).alias("id"), "label")
    return v.join(T.memories(spark, d), "id").select("id", "kind", "label")


@query()
def compaction_opportunities(spark, d):
    return compaction.opportunities(T.memories(spark, d))[1]


@query()
def backfill_compaction(spark, d):
    return compaction.backfill(T.memories(spark, d))[0]


@query(f"WITH {MEM}, k AS (SELECT kind, count(*) AS total, count_if(NOT gone) AS active, count_if(gone) AS archived FROM (SELECT kind, CAST(substr(id, 5) AS BIGINT) % 7 = 0 AS gone FROM mem) GROUP BY kind) SELECT * FROM k UNION ALL SELECT 'none of this kind', 0, 0, 0")
def store_stats(spark, d):
    """Every seventh memory is archived; a kind without memories has its row."""
    m = T.memories(spark, d)
    return retrieval.store_stats(m, m.where("CAST(substring(id, 5) AS BIGINT) % 7 = 0").select("id"), (*T.KINDS, "none of this kind"))


def by_language(spark: SparkSession, d: str) -> DataFrame:
    """Memories with the language as their project and one kind, so that copies meet."""
    return T.memories(spark, d).withColumn("projectId", F.col("tags")[0]).withColumn("kind", F.lit("semantic"))


MEM2 = MEM.replace("mem AS (", "mem0 AS (", 1) + ", mem AS (SELECT * REPLACE (tags[1] AS projectId, 'semantic' AS kind) FROM mem0)"


@query(f"""WITH {MEM2}, k AS (SELECT *, lower(trim(title)) AS t FROM mem)
SELECT projectId, kind, t AS titleKey, count(*) AS n, arg_max(id, struct_pack(l := length(summary), o := -createdAt)) AS summaryOf, arg_max(id, struct_pack(l := length(content), o := -createdAt)) AS contentOf,
  max(importance) AS importance, max(confidence) AS confidence, max(lastAccessedAt) AS lastAccessedAt FROM k GROUP BY projectId, kind, t HAVING count(*) > 1""")
def consolidate_exact(spark, d):
    from ..operators.consolidation import consolidate_exact as run

    return run(by_language(spark, d)).where("n > 1").select("projectId", "kind", "titleKey", "n", "summaryOf", "contentOf", "importance", "confidence", "lastAccessedAt")


def sql_shingle(x: str) -> str:
    w = f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9_]+'), lambda t: length(t) > 1)"
    return f"list_distinct(list_concat({w}, list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])))"


@query(f"""WITH {MEM2}, s AS (SELECT id, projectId, kind, {sql_shingle("title || ' ' || summary")} AS s FROM mem), m AS (SELECT *, min(id) OVER (PARTITION BY projectId, kind, list_sort(s)) AS class FROM s WHERE len(s) > 0),
e AS (SELECT id, projectId, kind, len(s) AS n, unnest(s) AS x FROM m WHERE id = class),
p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.projectId = b.projectId AND a.kind = b.kind AND a.x = b.x AND a.id < b.id GROUP BY ALL)
SELECT a, b, round(c::DOUBLE / (na + nb - c), 6) AS jaccard FROM p WHERE c::DOUBLE / (na + nb - c) >= 0.72 UNION ALL SELECT class, id, 1.0::DOUBLE FROM m WHERE id <> class""")
def jaccard_fuzzy_join(spark, d):
    """Pairs of classes of equal shingles, and each further member with its class; copies aren't expanded into pairs."""
    classes, pairs = retrieval.fuzzy_classes(by_language(spark, d))
    members = classes.where("id <> class").select(F.col("class").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"))
    return rounded(pairs.unionByName(members))


@query()
def consolidate_fuzzy(spark, d):
    from ..operators.consolidation import consolidate_fuzzy as run

    return run(by_language(spark, d)).select("id", "projectId", "kind", "title", F.sha1("content").alias("content"), "tags", "importance", "confidence", "createdAt", "lastAccessedAt", "n")


@query(f"WITH {MEM} SELECT id, projectId, lastAccessedAt FROM mem ORDER BY lastAccessedAt DESC, id LIMIT 100")
def list_memories(spark, d):
    return T.memories(spark, d).select("id", "projectId", "lastAccessedAt").orderBy(F.desc("lastAccessedAt"), "id").limit(100)


@query(f"WITH {MEM}, p AS (SELECT projectId, count(*) AS totalRows, sum(length(content)) AS chars FROM mem GROUP BY 1) SELECT projectId, totalRows, chars, row_number() OVER (ORDER BY totalRows DESC, chars DESC, projectId) AS place FROM p")
def project_ranking(spark, d):
    from pyspark.sql.window import Window

    p = T.memories(spark, d).groupBy("projectId").agg(F.count("*").alias("totalRows"), F.sum(F.length("content")).alias("chars"))
    return p.withColumn("place", F.row_number().over(Window.orderBy(F.desc("totalRows"), F.desc("chars"), "projectId")).cast("long"))  # a row per project


AGE = f"greatest(0, {NOW} - lastAccessedAt) / 3600000.0::DOUBLE"
WORDS = "list_filter(regexp_split_to_array(lower(title || chr(10) || summary || chr(10) || content), '[^a-z0-9_]+'), lambda t: length(t) > 1)"


def sql_token_sim(q: str, words: list[str]) -> str:
    hits = " + ".join(f"CAST(list_contains({WORDS}, '{w}') AS INT)" for w in words)
    return f"least(1.0::DOUBLE, CASE WHEN contains(lower(title), '{q}') THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN contains(lower(summary), '{q}') THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN contains(lower(content), '{q}') THEN 0.2::DOUBLE ELSE 0 END + ({hits}) / {float(len(words))}::DOUBLE * 0.35::DOUBLE)"


INDEXED = "list_filter(regexp_split_to_array(lower(title || chr(10) || summary || chr(10) || tags[1] || ' ' || tags[2]), '[^a-z0-9_]+'), lambda t: length(t) > 1)"


@query(f"""WITH {MEM}, s AS (SELECT id, kind, title, round(0.38::DOUBLE * importance + 0.24::DOUBLE * confidence + 0.18::DOUBLE * exp(-0.06::DOUBLE * {AGE}) + 0.2::DOUBLE * {sql_token_sim('of the', ['of', 'the'])} + 0.06::DOUBLE
  + least(0.12::DOUBLE, 0.04::DOUBLE * len(list_intersect(tags, ['en']))), 6) AS score FROM mem WHERE projectId = 'src2' AND list_has_any({INDEXED}, ['of', 'the']) AND CAST(substr(id, 5) AS BIGINT) % 5 <> 0) SELECT * FROM s ORDER BY score DESC, id LIMIT 10""")
def memory_store_search(spark, d):
    """Every fifth memory is archived."""
    m = T.memories(spark, d)
    return retrieval.token_search(m, "of the", NOW, 10, "src2", ("en",), m.where("CAST(substring(id, 5) AS BIGINT) % 5 = 0"))


@query(f"""WITH {MEM}, s AS (SELECT id, round(0.38::DOUBLE * importance + 0.24::DOUBLE * confidence + 0.18::DOUBLE * exp(-0.06::DOUBLE * {AGE}) + 0.2::DOUBLE * {sql_token_sim('zzqx', ['zzqx'])}, 6) AS score FROM mem) SELECT * FROM s ORDER BY score DESC, id LIMIT 10""")
def memory_store_search_all(spark, d):
    """No row has the word, so all compete."""
    return retrieval.token_search(T.memories(spark, d), "zzqx", NOW, 10).select("id", "score")


SIGNAL = f"""0.42::DOUBLE * importance + 0.28::DOUBLE * confidence + 0.2::DOUBLE * exp(-0.07::DOUBLE * {AGE}) + 0.1::DOUBLE * least(1.0::DOUBLE, CASE WHEN contains(lower(title), 'the') THEN 0.6::DOUBLE ELSE 0 END
  + CASE WHEN contains(lower(summary), 'the') THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN contains(lower(content), 'the') THEN 0.1::DOUBLE ELSE 0 END)"""


@query(f"WITH {MEM}, s AS (SELECT id, kind, importance, confidence, lastAccessedAt, {SIGNAL} AS signal FROM mem) SELECT id, kind, round(signal, 6) AS signal FROM s ORDER BY round(signal, 9) DESC, importance DESC, confidence DESC, lastAccessedAt DESC, id LIMIT 25")
def rerank_by_signal(spark, d):
    return rounded(retrieval.rerank(T.memories(spark, d), "the", NOW, 25).select("id", "kind", "signal"))


@query(f"""WITH {MEM}, s AS (SELECT id, kind, importance, confidence, lastAccessedAt, {SIGNAL} AS signal FROM mem),
t AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round(signal, 9) DESC, importance DESC, confidence DESC, lastAccessedAt DESC, id) AS turn, row_number() OVER (ORDER BY round(signal, 9) DESC, importance DESC, confidence DESC, lastAccessedAt DESC, id) AS place FROM s),
f AS (SELECT kind, place AS first FROM t WHERE turn = 1) SELECT id, kind, turn FROM t JOIN f USING (kind) ORDER BY turn, first LIMIT 25""")
def round_robin_by_kind(spark, d):
    return retrieval.rerank(T.memories(spark, d), "the", NOW, 25, diversify=True).select("id", "kind", F.col("turn").cast("long").alias("turn"))


@query(f"WITH {MEM} SELECT sourceRef, arg_max(id, struct_pack(i := importance, c := -createdAt)) AS id, max(importance) AS importance FROM mem GROUP BY sourceRef")
def dedupe_by_id_max_score(spark, d):
    m = T.memories(spark, d).select("sourceRef", "id", "importance", "createdAt")
    return retrieval.dedupe_best(m, "sourceRef", "importance").select("sourceRef", "id", "importance")


@query(f"WITH {MEM} SELECT id, title FROM mem WHERE length(regexp_replace(summary, '[ \\t\\n\\r\\f\\x0B\\x{{00a0}}\\x{{feff}}]+', '', 'g')) > 0 AND projectId = 'src5' AND importance >= 0.5")
def filter_chain(spark, d):
    m = T.memories(spark, d)
    return m.where((F.length(text.trim(F.col("summary"))) > 0) & (F.col("projectId") == "src5") & (F.col("importance") >= 0.5)).select("id", "title")


@query(f"WITH {MEM} SELECT id, 'gx_mem_' || substr(sha1(projectId || '|' || id), 1, 24) AS nodeId, substr(sha256(content), 1, 24) AS checksum FROM mem")
def stable_ids(spark, d):
    return T.memories(spark, d).select("id", hashing.stable_id("gx_mem", F.col("projectId"), F.col("id")).alias("nodeId"), hashing.checksum(F.col("content")).alias("checksum"))


@query(f"""WITH {MEM}, v AS (SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS similarity
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT * FROM v""")
def cosine_similarity(spark, d):
    e = T.read(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(scoring.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query("""WITH r AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(v[16] / sqrt(list_dot_product(v, v)), 6) AS last FROM r""")
def resize_embedding(spark, d):
    e = T.read(spark, d, "embeddings").select("vec_id", scoring.resized(F.col("embedding"), 16).alias("v"))
    return e.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[15], 6).alias("last"))
