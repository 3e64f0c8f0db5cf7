"""Queries over kept structures: overlap postings, token and vector indexes, and what evolution does with them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import evolve, tokenindex, vectorindex
from ..operators.lineage import shared_folder
from ..sources import tables as T
from .core_queries import AGE, sql_token_sim
from .registry import MEM, NOW, query

WHITE = r"[ \t\n\r\f\x0B\x{00a0}\x{feff}]"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def words(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9_]+'), lambda x: length(x) > 1))"


def candidates(spark, d):
    """Each memory as a candidate of its own; the summary begins with the title."""
    m = T.memories(spark, d)
    whole = [F.coalesce(c, F.lit("")).alias(c) for c in ("title", "content")]
    summary = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))).alias("summary")
    return m.select(F.col("id").alias("key"), F.lit(0).alias("place"), "projectId", "kind", *whole, summary, "tags", "sourceRef", F.col("id").alias("own"))


EVOLVED = f"""WITH {MEM}, c AS (SELECT id, projectId, kind, tags, coalesce(title, '') AS title, coalesce(title, '') || ' ' || coalesce(summary, '') AS summary FROM mem),
qw AS (SELECT id, projectId, unnest({words("title || chr(10) || summary")}) AS word FROM c), tw AS (SELECT id, projectId, unnest({words("title")}) AS word FROM mem),
sh AS (SELECT qw.id, tw.id AS near, count(*) AS s FROM qw JOIN tw ON qw.projectId = tw.projectId AND qw.word = tw.word AND qw.id <> tw.id GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, near) AS p FROM sh QUALIFY p <= 5),
sn AS (SELECT rk.id, p, {trimmed("title || ' ' || summary")} AS t FROM rk JOIN mem ON mem.id = rk.near), st AS (SELECT id, p, CASE WHEN length(t) <= 180 THEN t ELSE regexp_replace(substr(t, 1, 179), '{WHITE}+$', '') || '…' END AS snippet FROM sn),
bd AS (SELECT *, {trimmed(f"{trimmed('title')} || chr(10) || {trimmed('summary')}")} AS body FROM c),
nv AS (SELECT bd.id, any_value(body) AS body, any_value(kind) AS kind, count(p) AS neighbors, 1 - count(*) FILTER (p <= 3 AND snippet <> '' AND contains(lower(body), lower(snippet))) / greatest(1, count(*) FILTER (p <= 3 AND snippet <> ''))::DOUBLE AS novelty FROM bd LEFT JOIN st USING (id) GROUP BY bd.id),
q AS (SELECT *, length(body) AS n, len(regexp_extract_all(body, '[.;:!?]')) AS m FROM nv),
v AS (SELECT *, least(1, n / 320.0::DOUBLE) * 0.7::DOUBLE + least(1, m / 5.0::DOUBLE) * 0.3::DOUBLE AS c1, least(1, n / 350.0::DOUBLE) * 0.65::DOUBLE + least(1, m / 6.0::DOUBLE) * 0.35::DOUBLE AS c2 FROM q),
w AS (SELECT *, novelty * 0.62::DOUBLE + c1 * 0.38::DOUBLE AS s1, novelty * 0.6::DOUBLE + c2 * 0.4::DOUBLE AS s2 FROM v),
r AS (SELECT *, CASE WHEN body = '' THEN 0 ELSE (s1 + s2) / 2 END AS score, CASE WHEN body = '' THEN 0 ELSE (c1 + c2) / 2 END AS clarity FROM w),
a AS (SELECT *, CASE WHEN score >= 0.8 THEN 'merge' WHEN score >= 0.6 THEN 'store' WHEN score >= 0.42 THEN 'compress' ELSE 'reject' END AS act, CASE WHEN body = '' THEN 'empty-candidate' WHEN score >= 0.42 THEN 'fallback-heuristic' WHEN s2 >= 0.35 THEN 'accepted-by-heuristic' ELSE 'low-signal' END AS why FROM r),
i AS (SELECT *, round(least(1, score + CASE kind WHEN 'code_entity' THEN 0.03 WHEN 'procedural' THEN 0.02 ELSE 0 END + CASE WHEN clarity >= 0.85 THEN 0.02 ELSE 0 END), 4) AS imp, round(clarity, 4) AS conf FROM a),
f AS (SELECT *, act <> 'reject' AND imp >= 0.82 AND conf >= 0.82 AS promoted, act <> 'reject' AND imp < 0.22 AND conf < 0.45 AS archived FROM i)"""


@query(f"""{EVOLVED} SELECT id AS key, act <> 'reject' AND NOT archived AS stored, CASE WHEN archived THEN 'archive' ELSE act END AS action, CASE WHEN archived THEN 'low-importance' ELSE why END AS reason, 1 AS proposed, CASE WHEN act <> 'reject' THEN 0 END AS selected,
  CASE WHEN act <> 'reject' THEN round(score, 6) END AS score, act = 'merge' AND neighbors > 0 AS merged, CASE WHEN act = 'reject' THEN 0 ELSE neighbors END AS neighbors, promoted, archived,
  'propose:writer-produced-1-candidate(s)|review:' || CASE WHEN act = 'reject' THEN why ELSE 'selected-candidate-0-action-' || act || CASE WHEN act = 'compress' THEN '|compress:compressor-agent-applied' ELSE '' END || '|consolidate:' || CASE WHEN act = 'merge' AND neighbors > 0 THEN 'merged-with-' || neighbors || '-neighbor(s)' WHEN act = 'compress' THEN 'compressed-candidate-content' ELSE 'no-consolidation-required' END
  || '|archivist:decay=1 promote=' || promoted || ' archive=' || archived || '|persist:' || CASE WHEN archived THEN 'candidate-not-stored-low-importance' ELSE 'upserted' END END AS stages FROM f""")
def evolve_with_progression(spark, d):
    """Every memory is a candidate, judged against all others of its project: a row for each."""
    made = evolve.evolve(candidates(spark, d), T.memories(spark, d), NOW).results
    told = F.array_join(F.transform("stages", lambda s: F.concat_ws(":", s["stage"], s["detail"])), "|")
    return made.select("key", "stored", "action", "reason", "proposed", "selected", F.round("score", 6).alias("score"), "merged", F.col("neighbors").cast("long").alias("neighbors"), "promoted", "archived", told.alias("stages"))


@query(f"""{EVOLVED}, k AS (SELECT count(*) AS evolved, count_if(promoted) AS promoted, sum(CASE WHEN promoted THEN greatest(imp, 0.9) ELSE imp END) AS importance FROM (SELECT DISTINCT ON (m.projectId, m.title, m.content) f.* FROM f JOIN mem m USING (id) WHERE act <> 'reject' AND NOT archived))
SELECT (SELECT count(*) FROM mem) + evolved AS memories, evolved, promoted, round(importance, 2) AS importance FROM k""")
def evolved_table(spark, d):
    """The memories after evolution: those that were there, and one for each distinct text that is stored."""
    made = evolve.evolve(candidates(spark, d), T.memories(spark, d), NOW).memories
    new = F.col("sourceType") == "system"
    fresh = F.col("createdAt") == NOW
    return made.agg(F.count("*").alias("memories"), F.count_if(new & fresh).alias("evolved"), F.count_if(new & fresh & F.array_contains("tags", "promoted")).alias("promoted"), F.round(F.sum(F.when(new & fresh, F.col("importance"))), 2).alias("importance"))


INDEXED = "list_filter(regexp_split_to_array(lower(concat_ws(chr(10), title, summary, array_to_string(tags, ' '))), '[^a-z0-9_]+'), lambda t: length(t) > 1)"

#: Queries of the token index: of two words, of a word that only changed rows have, of one that none has, blank.
ASKED = ("of the", "renamed", "zzqx", " ")


def asked_sql(n: int, q: str) -> str:
    ws = tokenindex.query_words(q)
    if not ws:
        return f"SELECT {n} AS asked, '' AS id, 0.0::DOUBLE AS score WHERE false"
    hit = f"list_has_any({INDEXED}, {ws!r})"
    return f"""(SELECT {n} AS asked, id, round(0.38::DOUBLE * importance + 0.24::DOUBLE * confidence + 0.18::DOUBLE * exp(-0.06::DOUBLE * {AGE}) + 0.2::DOUBLE * {sql_token_sim(q, ws)} + 0.06::DOUBLE, 6) AS score
  FROM now WHERE projectId = 'src2' AND NOT archived AND ({hit} OR NOT (SELECT bool_or({hit}) FROM now WHERE projectId = 'src2')) ORDER BY score DESC, id LIMIT 10)"""


@query(f"""WITH {MEM}, now AS (SELECT * REPLACE (CASE WHEN n % 3 = 0 THEN 'renamed ' || title ELSE title END AS title, CASE WHEN n % 3 = 0 THEN lang ELSE summary END AS summary), n % 5 = 0 AS archived FROM (SELECT mem.*, lang, doc_id AS n FROM mem JOIN documents ON id = 'doc_' || doc_id) WHERE n % 7 <> 0)
{" UNION ALL ".join(asked_sql(n, q) for n, q in enumerate(ASKED))}""")
def token_index_search(spark, d):
    """Searches an index that was built, then changed: every third memory has a new title and a summary of one word,
    every fifth is archived, every seventh removed."""
    m = T.memories(spark, d)
    n = F.substring("id", 5, 20).cast("long")
    index = tokenindex.TokenIndex(spark, f"{shared_folder(spark)}/strata-token-index-{uuid.uuid4().hex}", 32).build(m)
    delta = m.where(n % 3 == 0).withColumns({"title": F.concat(F.lit("renamed "), "title"), "summary": F.get("tags", F.lit(0))})
    index.upsert(delta, 1)
    index.remove(m.where(n % 7 == 0), 2)
    index.archive(m.where(n % 5 == 0), 3)
    gone = n % 7 == 0
    now = m.where(~gone & (n % 3 != 0)).unionByName(delta.where(~gone))
    found = [index.search(now, q, NOW, 10, "src2").select(F.lit(i).alias("asked"), "id", F.round("score", 6).alias("score")) for i, q in enumerate(ASKED)]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 9) AS similarity FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS place, id, round(similarity, 6) AS similarity FROM s QUALIFY place <= 10""")
def vector_index_search(spark, d):
    """The ten nearest others of every twentieth vector, by the index."""
    v = T.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    best, _ = vectorindex.build_index(v).nearest(v.where("id % 20 = 0"), 10)
    return best.select("query", F.col("place").cast("long").alias("place"), "id", F.round("similarity", 6).alias("similarity"))
