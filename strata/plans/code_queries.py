"""Queries of code: structural counts, feature vectors and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest
from ..sources import tables as T
from .registry import query

RUN = r"[\p{L}\p{N}_]+"
KEYWORDS = ", ".join(f"'{k}'" for k in ingest.KEYWORDS)
NAME = "[A-Za-z_][A-Za-z0-9_]*"
IMPORT = r"""^\s*(?:import\s+[^\n]+|from\s+\S+\s+import\s+[^\n]+|#include\s+[<"][^>"]+[>"])"""


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def struct_sql(table: str, key: str, column: str) -> str:
    """The fifteen counts in SQL: ``f`` has a row per ``key``. Words are runs of letters, digits and _."""
    lines = f"regexp_split_to_array({column}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')"
    three = [rf"(?m)^\s*(?:async\s+)?function\s+({NAME})\s*\(", rf"(?m)^\s*def\s+({NAME})\s*\(", rf"({NAME})\s*=\s*\([^\)]*\)\s*=>"]
    functions = "list_distinct(" + " || ".join(f"regexp_extract_all({column}, {quoted(p)}, 1)" for p in three) + ")"
    return f"""a AS (SELECT {key}, coalesce({column}, '') AS {column} FROM {table}),
b AS (SELECT {key}, {column}, regexp_extract_all({column}, '{RUN}') AS words, {functions} AS functions, list_distinct(regexp_extract_all({column}, '(?m)^\\s*(?:export\\s+)?class\\s+({NAME})', 1)) AS classes,
  list_filter(regexp_extract_all({column}, '{RUN}\\s*\\('), lambda x: regexp_full_match(x, '{NAME}\\s*\\(')) AS calls, regexp_extract_all({column}, {quoted("(?m)" + IMPORT)}) AS imports, {lines} AS lines,
  regexp_extract_all({column}, '[{{}}]') AS marks FROM a),
c AS (SELECT *, list_distinct(list_filter(words, lambda w: regexp_full_match(w, '[A-Za-z_][A-Za-z0-9_]{{2,}}') AND w NOT IN ({KEYWORDS}))) AS ids,
  list_reduce(list_prepend({{'d': 0, 'm': 0}}, list_transform(marks, lambda x: {{'d': CASE WHEN x = '{{' THEN 1 ELSE -1 END, 'm': 0}})), lambda acc, step: {{'d': greatest(0, acc['d'] + step['d']), 'm': greatest(acc['m'], acc['d'] + step['d'])}}) AS deep,
  list_max(list_transform(list_filter(lines, lambda l: trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''), lambda l: (length(l) - length(ltrim(l, ' '))) // 4)) AS indent,
  list_distinct(list_filter(list_transform(list_transform(imports, lambda m: trim(m, ' ' || chr(9) || chr(10) || chr(13))), lambda m: CASE WHEN m LIKE '#include%' THEN regexp_extract(m, '#include\\s+[<"]([^>"]+)', 1) WHEN m LIKE 'from %' THEN regexp_split_to_array(m, '\\s+')[2] WHEN m LIKE 'import %' THEN trim(split_part(split_part(substr(m, 8), ' as ', 1), ',', 1)) ELSE '' END), lambda m: m <> '')) AS deps FROM b),
f AS (SELECT {key}, len(functions) AS num_functions, len(classes) AS num_classes, 0 AS num_interfaces, len(list_filter(words, lambda w: w IN ('for', 'while', 'do'))) AS num_loops, len(list_filter(words, lambda w: w IN ('if', 'switch', 'case', 'elif'))) AS num_branches,
  len(list_filter(calls, lambda x: regexp_extract(x, '{NAME}') NOT IN ({KEYWORDS}))) AS num_calls, len(imports) AS num_imports, len(list_filter(words, lambda w: w = 'return')) AS num_returns, greatest(deep['m'], coalesce(indent, 0)) AS max_depth, len(lines) - CASE WHEN lines[-1] = '' THEN 1 ELSE 0 END AS line_count,
  len(ids) AS identifier_count, len(list_filter(functions, lambda n: (length({column}) - length(replace({column}, n || '(', ''))) // (length(n) + 1) >= 2)) > 0 AS recursion_flag, 1 + num_loops + num_branches AS cyclomatic_proxy,
  CASE WHEN len(ids) > 0 THEN list_sum(list_transform(ids, lambda x: length(x))) / len(ids)::DOUBLE ELSE 0 END AS avg_identifier_len, len(deps) AS unique_dependency_count FROM c)"""


# A piece of code for each part: its words name functions, classes, imports and calls, its size decides the nesting.
CODE_SQL = r"""code AS (SELECT p_partkey, replace(p_type, ' ', '_') AS t, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_size AS z FROM part),
src AS (SELECT p_partkey, 'import ' || a || ' as x, y' || chr(10) || 'from ' || b || '.' || a || ' import ' || t || chr(10) || chr(10) || '#include <' || b || '.h>' || chr(13) || chr(10) || 'export class ' || upper(a) || ' {' || chr(10) || repeat(' ', z) || 'def ' || a || '(é, ' || b || '):' || chr(10)
  || repeat('{ if (x) { ', z % 4) || ' for z' || z || ' in ' || t || '(' || b || '(1)): return ' || CASE WHEN z % 2 = 0 THEN a ELSE b END || '(' || a || ')' || chr(10) || 'éfor = 1; ' || b || ' = (p, q) => { while (true) ' || b || ' (p) }' || repeat('}', z % 7) || chr(10) || 'else  if (' || a || 'é(2)) async function ' || t || ' ()' || CASE WHEN z % 3 = 0 THEN chr(10) ELSE '' END AS s FROM code)"""


def code_of(spark, d):
    p = T.read(spark, d, "part")
    t, a, b, z = F.replace("p_type", F.lit(" "), F.lit("_")), F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_size").cast("int")
    times = lambda x, n: F.expr("''") if n is None else F.repeat(F.lit(x), n)
    s = F.concat(
        F.lit("import "), a, F.lit(" as x, y\nfrom "), b, F.lit("."), a, F.lit(" import "), t, F.lit("\n\n#include <"), b, F.lit(".h>\r\nexport class "), F.upper(a), F.lit(" {\n"), times(" ", z), F.lit("def "), a, F.lit("(é, "), b, F.lit("):\n"),
        times("{ if (x) { ", z % 4), F.lit(" for z"), z.cast("string"), F.lit(" in "), t, F.lit("("), b, F.lit("(1)): return "), F.when(z % 2 == 0, a).otherwise(b), F.lit("("), a, F.lit(")\néfor = 1; "), b, F.lit(" = (p, q) => { while (true) "), b, F.lit(" (p) }"), times("}", z % 7),
        F.lit("\nelse  if ("), a, F.lit("é(2)) async function "), t, F.lit(" ()"), F.when(z % 3 == 0, "\n").otherwise(""),
    )
    return p.select("p_partkey", s.alias("s"))


COUNTS = ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in ingest.STRUCT_NAMES if n not in ("avg_identifier_len", "recursion_flag"))


def counts_of(made):
    return [F.round(made[n], 6).alias(n) if n == "avg_identifier_len" else made[n].alias(n) if n == "recursion_flag" else made[n].cast("long").alias(n) for n in ingest.STRUCT_NAMES]


@query(f"WITH {CODE_SQL}, {struct_sql('src', 'p_partkey', 's')} SELECT p_partkey, {COUNTS}, recursion_flag, round(avg_identifier_len, 6) AS avg_identifier_len FROM f")
def build_struct(spark, d):
    """All fifteen counts of a piece of code for each part."""
    return code_of(spark, d).select("p_partkey", ingest.structure(F.col("s")).alias("m")).select("p_partkey", *counts_of(F.col("m.stats")))


@query(f"WITH {struct_sql('documents', 'doc_id', 'text')} SELECT doc_id, {COUNTS}, recursion_flag, round(avg_identifier_len, 6) AS avg_identifier_len FROM f")
def build_struct_of_texts(spark, d):
    """The same counts of whole documents."""
    return T.read(spark, d, "documents").select("doc_id", ingest.structure(F.col("text")).alias("m")).select("doc_id", *counts_of(F.col("m.stats")))


FLOATS = ", ".join(f"CAST({n} AS FLOAT)" for n in ingest.STRUCT_NAMES)


@query(f"WITH {struct_sql('pages', 'page_id', 'html')}, v AS (SELECT page_id, [{FLOATS}] AS v FROM f) SELECT page_id, " + ", ".join(f"round(v[{i + 1}], 4) AS f{i:02}" for i in range(15)) + ", len(v) AS n FROM v")
def build_feature_vector(spark, d):
    """The vectors of whole pages, place by place."""
    v = T.read(spark, d, "pages").select("page_id", ingest.feature_vector(ingest.structure(F.col("html"))["stats"]).alias("v"))
    return v.select("page_id", *(F.round(F.col("v")[i], 4).alias(f"f{i:02}") for i in range(15)), F.size("v").cast("long").alias("n"))


# A TypeScript file for each part, whose braces also stand in a comment and a string.
TS_SQL = r"""ts AS (SELECT p_partkey, 'f_' || split_part(p_name, ' ', 1) AS a, 't_' || split_part(p_name, ' ', 2) AS b, upper('c_' || split_part(p_name, ' ', 2)) AS c FROM part),
pieces AS (SELECT *, 'if (i) { ' || b || '.go("} {", ' || a || '[0]) } else { stop() }' AS br, 'run(n: string): void { return ' || a || '(n) }' AS me FROM ts), more AS (SELECT *, 'for (const i of x) { ' || br || ' }' AS lo, 'class ' || c || ' { ' || me || ' }' AS cl FROM pieces),
fu AS (SELECT *, 'function ' || a || '(x: ' || b || ') {' || chr(10) || '  ' || lo || chr(10) || '}' AS fn FROM more)"""


@query(f"""WITH {TS_SQL}, e AS (
  SELECT p_partkey, 'function' AS kind, a AS name, 'function ' || a || '(x: ' || b || ')' AS signature, 'likely O(n) with branching' AS hint, b || '.go,stop' AS calls, 2 AS startLine, 4 AS endLine, fn AS piece FROM fu
  UNION ALL SELECT p_partkey, 'loop', 'i', 'for (const i of x)', 'likely O(n) with branching', b || '.go,stop', 3, 3, lo FROM fu UNION ALL SELECT p_partkey, 'branch', 'i', 'if (i)', 'branch-heavy, data-dependent cost', b || '.go,stop', 3, 3, br FROM fu
  UNION ALL SELECT p_partkey, 'class', c, 'class ' || c, 'structural helper, cost likely linear in its input size', a, 5, 5, cl FROM fu UNION ALL SELECT p_partkey, 'method', 'run', 'run(n: string): void', 'structural helper, cost likely linear in its input size', a, 5, 5, me FROM fu)
SELECT p_partkey, kind, name, signature, hint, calls, startLine, endLine, sha256(replace(piece, '  ', ' ')) AS sourceHash, CAST(ceil(length(piece) / 4) AS INT) AS tokens FROM e""")
def extract_entities(spark, d):
    """The entities of a file for each part."""
    p = T.read(spark, d, "part")
    a, b, c = (F.concat(F.lit(x), F.split_part("p_name", F.lit(" "), F.lit(i))) for x, i in (("f_", 1), ("t_", 2), ("c_", 2)))
    lit = F.lit
    source = F.concat(
        lit("// class "), a, lit(" {\nexport function "), a, lit("(x: "), b, lit(") {\n  for (const i of x) { if (i) { "), b, lit('.go("} {", '), a, lit("[0]) } else { stop() } }\n}\n/* { */ class "), F.upper(c), lit(" { run(n: string): void { return "), a, lit("(n) } }\n"),
    )
    e = ingest.entities(p.select(F.concat(lit("src/"), F.col("p_partkey").cast("string"), lit(".ts")).alias("path"), source.alias("source")))
    return e.select(F.regexp_extract("path", "[0-9]+", 0).cast("long").alias("p_partkey"), "kind", "name", "signature", F.col("complexityHint").alias("hint"), F.array_join("dependencies", ",").alias("calls"), "startLine", "endLine", "sourceHash", "tokens")
