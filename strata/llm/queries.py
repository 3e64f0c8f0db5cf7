"""The registered queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fingerprint, merkle, neardup, packing, quality, sharding, suffixdedup, swappacking, tokencount, toxicity, urlfilter, vectorcodes
from .shared import ascii_lower, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Rules of op2: verdict, host and path.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.quality_scores(documents, quality.train(documents, table(spark, sf_dir, "labels")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.toxicity(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(table(spark, sf_dir, "documents"), 8)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_likeness(table(spark, sf_dir, "documents"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.repeated_passages(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.codes(table(spark, sf_dir, "embeddings"))


def op12_whole_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swappacking.pack_whole(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op13(documents: DataFrame) -> DataFrame:
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    made = merkle.manifest(documents, changed={"text": F.when(tampered, ascii_lower(F.col("text"))).otherwise(F.col("text"))})
    back = made.withColumn("folded_root", merkle.folded(F.col("changed_leaf"), F.col("steps")))
    return back.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_url_filter": op2_url_filter,
        "op3_quality": op3_quality,
        "op4_toxicity": op4_toxicity,
        "op5_hilbert_shards": op5_hilbert_shards,
        "op6_decontamination": op6_decontamination,
        "op7_near_duplicates": op7_near_duplicates,
        "op8_fingerprints": op8_fingerprints,
        "op9_repeated_passages": op9_repeated_passages,
        "op10_packing": op10_packing,
        "op11_vector_codes": op11_vector_codes,
        "op12_whole_packing": op12_whole_packing,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


OP2_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  CASE WHEN regexp_extract(rest, '^[^?#]*') LIKE '%/%' THEN substr(regexp_extract(rest, '^[^?#]*'), instr(regexp_extract(rest, '^[^?#]*'), '/')) ELSE '' END AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT h.page_id, h.host, h.path, rhost || rpath AS rule, verdict, length(rhost || rpath) AS n FROM h LEFT JOIN r ON (h.host = rhost OR ends_with(h.host, '.' || rhost)) AND starts_with(h.path, rpath))
SELECT page_id, host, path, arg_max(rule, n) AS rule, coalesce(arg_max(verdict, n), 'allow') AS verdict FROM m GROUP BY page_id, host, path
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w FROM documents),
b AS (SELECT item_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 13) AS n, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM bw),
ns AS (SELECT DISTINCT n FROM p),
dw AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n),
hits AS (SELECT doc_id, item_id, i, p.n FROM (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM dw) x JOIN p ON x.s = p.s AND x.n = p.n),
pos AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM d),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(doc_id, near) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.near = l.a),
c AS (SELECT doc_id, min(near) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""


def op11_sql(rounds: int = 6) -> str:
    out = [
        "q AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)] AS x FROM q, range(8) r(part))",
        "c0 AS (SELECT part, e, x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM q ORDER BY vec_id LIMIT 16) USING (vec_id))",
    ]
    for n in range(rounds + 1):
        out.append(f"a{n} AS MATERIALIZED (SELECT vec_id, part, x, e, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN (SELECT part, e, x AS y FROM c{n}) USING (part) QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, e) = 1)")
        if n < rounds:
            out.append(f"m{n} AS (SELECT part, e, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY i) AS x FROM (SELECT part, e, i, sum(v) AS s, count(*) AS c FROM (SELECT part, e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{n}) GROUP BY part, e, i) GROUP BY part, e)")
            out.append(f"c{n + 1} AS MATERIALIZED (SELECT part, e, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m USING (part, e))")
    last = f"b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{rounds}), f AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)"
    return f"WITH {', '.join(out)}, {last} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f JOIN q USING (vec_id), b"


def op13_sql(levels: int = 10, tops: int = 4) -> str:
    """SQL for op13: ``levels`` and ``tops`` bound the depth of a language's tree and of the tree of subroots."""
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
    head = " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    out = [
        "crc(t) AS MATERIALIZED (SELECT list(v ORDER BY i) FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))",
        "d AS (SELECT *, CASE WHEN doc_id IS NULL THEN text WHEN xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)), 4294967295) % 3 = 0"
        " THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM documents, crc)",
        f"leaves AS (SELECT doc_id, coalesce('+' || lang, '') AS k, sha256({head} || {field.format('text')}) AS leaf, sha256({head} || {field.format('other')}) AS changed FROM d)",
        "t0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS c, leaf AS digest FROM leaves)",
    ]
    for n in range(levels):
        out.append(f"t{n + 1} AS MATERIALIZED (SELECT k, i // 8 AS i, any_value((c + 7) // 8) AS c, any_value(c) AS below, list(digest ORDER BY i) AS kids, CASE WHEN any_value(c) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY i)) END AS digest FROM t{n} GROUP BY k, i // 8)")
    out.append(f"s0 AS MATERIALIZED (SELECT k, digest AS subroot, digest, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS c FROM t{levels})")
    for n in range(tops):
        out.append(f"s{n + 1} AS MATERIALIZED (SELECT i // 8 AS i, any_value((c + 7) // 8) AS c, any_value(c) AS below, list(digest ORDER BY i) AS kids, CASE WHEN any_value(c) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY i)) END AS digest FROM s{n} GROUP BY i // 8)")
    step = "CASE WHEN below = 1 THEN folded ELSE sha256(array_to_string(list_concat(list_concat(kids[:pos % 8], [folded]), kids[pos % 8 + 2:]), '')) END AS folded, CASE WHEN below = 1 THEN proof ELSE proof || array_to_string(list_concat(kids[:pos % 8], kids[pos % 8 + 2:]), '') END AS proof"
    out.append("f0 AS (SELECT doc_id, k, leaf, i AS pos, changed AS folded, '' AS proof FROM t0)")
    for n in range(levels):
        out.append(f"f{n + 1} AS (SELECT doc_id, f.k, leaf, pos // 8 AS pos, {step} FROM f{n} f JOIN t{n + 1} t ON f.k = t.k AND f.pos // 8 = t.i)")
    out.append(f"g0 AS (SELECT doc_id, leaf, subroot, s.i AS pos, folded, proof FROM f{levels} f JOIN s0 s USING (k))")
    for n in range(tops):
        out.append(f"g{n + 1} AS (SELECT doc_id, leaf, subroot, pos // 8 AS pos, {step} FROM g{n} g JOIN s{n + 1} s ON g.pos // 8 = s.i)")
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified FROM g{tops}, s{tops}"


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op6_decontamination": OP6_SQL, "op7_near_duplicates": OP7_SQL, "op11_vector_codes": op11_sql(), "op13_merkle_manifest": op13_sql()}
