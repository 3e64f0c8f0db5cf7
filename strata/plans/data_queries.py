"""Queries of deltas, fingerprints, tags, tokens, policies and models that the other modules leave out."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import hashing, text, udfs
from ..operators import evolution, ingest, ngram, records, temporal
from ..operators.lineage import shared_folder
from ..sources import policy as rules
from ..sources import tables as T
from ..streaming import suggestions
from .core_queries import rounded
from .registry import MID_US, SNAP, query
from .store_queries import ACTION, CANDIDATE, candidates
from .temporal_queries import LATE_US, LINE, as_of, line, snapshots
from .text_queries import NGRAM


def events(spark, d):
    return T.read(spark, d, "events").select("*", F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("atMs"))


@query(f"""WITH {SNAP}, {LINE}, {as_of(MID_US, 's')}, {as_of(LATE_US, 't')}, a AS (SELECT * FROM s WHERE operation <> 'delete'), b AS (SELECT * FROM t WHERE operation <> 'delete'),
x AS (SELECT coalesce(a.logicalId, b.logicalId) AS logicalId, CASE WHEN a.logicalId IS NULL THEN 'added' WHEN b.logicalId IS NULL THEN 'removed' WHEN a.title IS DISTINCT FROM b.title OR a.summary IS DISTINCT FROM b.summary OR a.content IS DISTINCT FROM b.content
  OR a.sourceRef IS DISTINCT FROM b.sourceRef OR abs(a.importance - b.importance) > 1e-6 OR abs(a.confidence - b.confidence) > 1e-6 THEN 'modified' END AS change, coalesce(b.title, a.title) AS title, coalesce(b.branch, a.branch) AS branch, a.summary AS was, b.summary AS is_ FROM a FULL JOIN b ON a.logicalId = b.logicalId)
SELECT logicalId, change AS changeType, title, branch, was, is_ FROM x WHERE change IS NOT NULL ORDER BY list_position(['modified', 'added', 'removed'], change), logicalId LIMIT 200""")
def diff_order(spark, d):
    """The first two hundred changes between two times: modified ones first, then by id."""
    s, b = snapshots(spark, d), line(spark)
    _, items = temporal.diff_items(temporal.state_as_of(s, b, MID_US), temporal.state_as_of(s, b, LATE_US))
    return items.select("logicalId", "changeType", "title", "branch", F.col("before.summary").alias("was"), F.col("after.summary").alias("is_"))


@query("""WITH n AS (SELECT source AS projectId, 'src/' || doc_id AS sourceRef, sha1('ingest-v2|code|maxChunkChars:1400|' || text) AS contentHash, doc_id FROM documents)
SELECT projectId, sourceRef, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE contentHash END AS contentHash, CASE WHEN doc_id % 5 = 0 THEN 9 ELSE 1 END AS firstIngestedAt, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 9 END AS lastIngestedAt FROM n WHERE doc_id % 15 <> 0""")
def upsert_fingerprint(spark, d):
    """Of all sources all but each third are read again; each fifth wasn't stored before."""
    of = ingest.fingerprints(T.read(spark, d, "documents").select(F.col("source").alias("projectId"), F.lit("code").alias("sourceType"), F.concat(F.lit("src/"), F.col("doc_id").cast("string")).alias("sourceRef"), F.col("text").alias("source"), "doc_id"))
    when = [F.lit(1).cast("long").alias("firstIngestedAt"), F.lit(1).cast("long").alias("lastIngestedAt")]
    stored = of.where("doc_id % 5 <> 0").select("projectId", "sourceType", "sourceRef", F.lit("old").alias("contentHash"), "ingestVersion", *when)
    new = of.where("doc_id % 3 <> 0").select("projectId", "sourceType", "sourceRef", "contentHash", "ingestVersion")
    made = records.upsert_fingerprints(stored, new, 9)
    return made.select("projectId", "sourceRef", "contentHash", F.col("firstIngestedAt").cast("int").alias("firstIngestedAt"), F.col("lastIngestedAt").cast("int").alias("lastIngestedAt"))


# Lines as clients send them, some of which lack a type, have a step below 0, a span that ends before it begins, or an estimate that is no number.
LINES_SQL = """l AS (SELECT event_id, 's' || user_id AS sessionId, CASE WHEN user_id % 3 > 0 THEN 'p' || user_id % 5 END AS projectId, event_id % 50 - 2 AS step, CASE event_type WHEN 'view' THEN 'append' WHEN 'click' THEN 'replace' WHEN 'purchase' THEN 'snapshot' WHEN 'signup' THEN 'remove' ELSE 'other' END AS deltaType,
  props AS payload, CASE WHEN user_id % 4 = 0 THEN event_id % 7 END AS a, event_id % 11 AS b, user_id % 13 = 0 AS odd FROM events), ok AS (SELECT * FROM l WHERE deltaType <> 'other' AND step >= 0 AND (a IS NULL OR b >= a) AND NOT odd)"""


def delta_lines(spark, d):
    e, u, k = events(spark, d), F.col("user_id"), F.col("event_id")
    kinds = F.create_map(*[F.lit(x) for p in {"view": "append", "click": "replace", "purchase": "snapshot", "signup": "remove", "error": "other"}.items() for x in p])
    span = F.when(u % 4 == 0, F.struct((k % 7).alias("start"), (k % 11).alias("end")))
    row = F.struct(F.concat(F.lit("s"), u.cast("string")).alias("sessionId"), F.when(u % 3 > 0, F.concat(F.lit("p"), (u % 5).cast("string"))).alias("projectId"), (k % 50 - 2).alias("step"), kinds[F.col("event_type")].alias("deltaType"), F.col("props").alias("payload"), F.when(u % 13 == 0, "many").alias("tokenEstimate"), span.alias("replaceSpan"), F.col("atMs").alias("timestamp"))
    return e.select(F.to_json(row).alias("value"))


@query(f"WITH {LINES_SQL} SELECT sessionId, projectId, step, deltaType, payload, count(*) AS n FROM ok GROUP BY ALL")
def valid_deltas(spark, d):
    """The lines that are whole deltas."""
    found = suggestions.valid_deltas(delta_lines(spark, d))
    return found.groupBy("sessionId", "projectId", "step", "deltaType", "payload").agg(F.count("*").alias("n"))


@query(f"WITH {LINES_SQL} SELECT sessionId, projectId, step, count(*) AS n FROM ok WHERE projectId IS NULL OR projectId = 'p1' GROUP BY ALL")
def client_filter(spark, d):
    return suggestions.client_filter(suggestions.valid_deltas(delta_lines(spark, d)), "p1").groupBy("sessionId", "projectId", "step").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_id, 'p' || user_id % 5 AS projectId, event_type, epoch_us(ts) // 1000 AS t FROM events)
SELECT projectId, 'daemon-' || event_type || '-' || array_to_string(list_transform(range(7, -1, -1), lambda k: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((t // CAST(pow(36, k) AS BIGINT)) % 36 + 1 AS BIGINT), 1)), '') AS sessionId, t AS step,
  '{"eventType":"' || event_type || '","id":' || event_id || '}' AS payload FROM e""")
def emit_stream_event(spark, d):
    e = events(spark, d).select(F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("projectId"), F.col("event_type").alias("eventType"), F.to_json(F.struct(F.col("event_id").alias("id"))).alias("payload"), "atMs")
    return suggestions.stream_events(e).select("projectId", "sessionId", "step", "payload")


FIRST_SEEN = "list_filter(l, lambda x, i: list_position(l, x) = i)"
CLEAN_TAG = r"regexp_replace(regexp_replace(lower(trim(x, ' ' || chr(9) || chr(10) || chr(13))), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"""WITH w AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), ' '), lambda x: {CLEAN_TAG}), lambda x: regexp_full_match(x, '[a-z][a-z0-9_-]{{1,23}}')) AS l FROM documents)
SELECT doc_id, array_to_string(({FIRST_SEEN})[:24], ',') AS tags FROM w""")
def normalize_tag_list(spark, d):
    """The first 24 tags that the words of a text make."""
    words = F.split(F.coalesce("text", F.lit("")), " ")
    return T.read(spark, d, "documents").select("doc_id", F.array_join(text.normalize_tags(words, 24), ",").alias("tags"))


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+|[^\\s]') AS ts FROM documents)
SELECT doc_id, sha1(trim(list_reduce(list_prepend('', ts), lambda acc, x: CASE WHEN acc = '' OR x IN ('.', ',', '!', '?', ';', ':', ')', ']', '}', '%') OR right(acc, 1) IN ('(', '[', '{') THEN acc || x ELSE acc || ' ' || x END))) AS joined FROM t""")
def detokenize(spark, d):
    """Texts from their tokens: marks join to the word before, or to what they open."""
    tokens = text.tokenize_ngram(F.coalesce("text", F.lit("")))
    return T.read(spark, d, "documents").select("doc_id", F.sha1(udfs.detokenized(tokens)).alias("joined"))


@query("""WITH u AS (SELECT page_id, list_transform(string_split(coalesce(url, ''), ''), lambda c: unicode(c)::BIGINT) AS us FROM pages)
SELECT page_id, list_reduce(list_prepend(2166136261::BIGINT, us), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM u""")
def fnv1a(spark, d):
    """Checksums of urls, whose characters are code units."""
    return T.read(spark, d, "pages").select("page_id", udfs.of_text(F.coalesce("url", F.lit("")), hashing.fnv1a, "bigint").alias("h"))


@query(f"""WITH {CANDIDATE}, r AS (SELECT *, novelty * 0.62::DOUBLE + c1 * 0.38::DOUBLE AS s1, novelty * 0.6::DOUBLE + c2 * 0.4::DOUBLE AS s2 FROM cv), w AS (SELECT *, (s1 + s2) / 2 AS score FROM r), a AS (SELECT *, {ACTION} AS action FROM w),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id // 5 ORDER BY score >= 0.42 DESC, list_position(['merge', 'store', 'compress', 'reject'], action), score DESC, novelty DESC, doc_id) AS k, doc_id - min(doc_id) OVER (PARTITION BY doc_id // 5) AS i, count(*) OVER (PARTITION BY doc_id // 5) AS cnt FROM a)
SELECT doc_id // 5 AS key, CAST(i AS INT) AS index, CAST(cnt AS INT) AS n, action, round(score, 6) AS score FROM o WHERE k = 1""")
def candidate_choice(spark, d):
    """The best of each five candidates."""
    k = F.col("doc_id")
    made = candidates(spark, d).select(F.expr("doc_id div 5").alias("key"), k.cast("int").alias("place"), evolution.critic_fallback(F.col("title"), F.col("summary"), F.col("snippets")).alias("r"))
    return rounded(evolution.choose_candidate(made.select("key", "place", "r.*"), "key").select("key", "index", "n", "action", "score"))


@query("""WITH f AS (SELECT doc_id, 'src/' || lang || '/f' || doc_id || ['.ts', '.py', '.md', '.H', '.test.ts', '.cpp'][doc_id % 6 + 1] AS path, strlen(text) AS bytes FROM documents)
SELECT doc_id, path FROM f WHERE bytes <= 4000 AND NOT path LIKE '%.test.ts' AND NOT contains(path, '/fr/') AND regexp_matches(lower(path), '\\.(ts|tsx|cts|mts|h|hpp|hh|hxx|cpp|cc|cxx)$')""")
def policy_files(spark, d):
    """Files that a policy takes: of two languages, up to 4,000 bytes, outside a folder, no tests."""
    p = rules.Policy(exclude=["**/fr/**", "*.test.ts"], languages=["TypeScript", "C++"], max_file_bytes=4000)
    k = F.col("doc_id")
    path = F.concat(F.lit("src/"), "lang", F.lit("/f"), k.cast("string"), T.pick((".ts", ".py", ".md", ".H", ".test.ts", ".cpp"), k % 6))
    f = T.read(spark, d, "documents").select("doc_id", path.alias("path"), F.octet_length("text").alias("bytes"))
    kept = rules.path_matches(F.col("path"), p.include, p.exclude) & text.extension(F.col("path")).isin(*rules.extensions(p.languages)[0]) & (F.col("bytes") <= p.max_file_bytes)
    return f.where(kept).select("doc_id", "path")


@query(f"WITH {NGRAM} SELECT fromId, CAST(count(*) AS BIGINT) AS n, CAST(sum(q) AS BIGINT) AS q FROM tr GROUP BY 1")
def load_ngram_model(spark, d):
    """A model that was saved and loaded again."""
    docs = T.read(spark, d, "documents")
    vocab = ngram.vocabulary(docs)
    path = f"{shared_folder(spark)}/strata-model-{uuid.uuid4().hex}"
    ngram.save(vocab, ngram.transitions(docs, vocab), path)
    _, model = ngram.load(spark, path)
    return model.groupBy(F.col("fromId").cast("long").alias("fromId")).agg(F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("q"))


@query("""WITH f AS (SELECT doc_id, source AS projectId, 'src/' || doc_id || '.ts' AS path, coalesce(text, '') AS s FROM documents), st AS (SELECT *, doc_id % 3 = 0 AS known FROM f)
SELECT count(*) AS filesScanned, count_if(known AND strlen(s) <= 20000) AS codeFilesSkippedUnchanged, CAST(sum(CASE WHEN known OR strlen(s) > 20000 THEN 0 ELSE ceil(length(s) / 1400) END) AS BIGINT) AS codeChunks, count_if(NOT known AND strlen(s) <= 20000) AS staleMemoriesRemoved FROM st""")
def run_ingestion(spark, d):
    """What a run of ingestion reports: each third file is stored unchanged, files over 20,000 bytes aren't read, and every
    file that is read had one memory that it no longer has."""
    docs = T.read(spark, d, "documents").select("doc_id", F.col("source").alias("projectId"), F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"), F.coalesce("text", F.lit("")).alias("source"))
    files = docs.withColumn("bytes", F.octet_length("source"))
    known = F.col("doc_id") % 3 == 0
    limit = F.col("bytes") <= 20_000
    stored = ingest.fingerprints(files.where(known & limit).select("projectId", F.lit("code").alias("sourceType"), F.col("path").alias("sourceRef"), "source")).drop("source").withColumns({"contentBytes": F.lit(0).cast("long"), "firstIngestedAt": F.lit(1).cast("long"), "lastIngestedAt": F.lit(1).cast("long")})
    one = F.lit(0.5)
    memories = files.select(F.concat(F.lit("gone_"), F.col("doc_id").cast("string")).alias("id"), "projectId", F.lit("code_entity").alias("kind"), F.lit("code").alias("sourceType"), F.lit("t").alias("title"), F.lit("s").alias("summary"), F.lit("c").alias("content"), F.array(F.lit("x")).alias("tags"), one.alias("importance"), one.alias("confidence"), F.col("path").alias("sourceRef"), F.lit(1).alias("createdAt"), F.lit(1).alias("lastAccessedAt"))
    report = ingest.run_ingestion(files.drop("doc_id"), stored, memories, rules.Policy(max_file_bytes=20_000), 9)["report"]
    return report.select("filesScanned", "codeFilesSkippedUnchanged", "codeChunks", "staleMemoriesRemoved")
