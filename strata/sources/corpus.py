"""Texts for model training from files, memories and datasets."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text
from ..operators.lineage import checkpointed

# What a dataset text must mention anywhere, or look like, to count as technical.
TECHNICAL = (
    "api", "json", "schema", "memory", "cache", "model", "prompt", "token", "retrieval", "context", "agent", "llm", "embedding", "vector",
    "typescript", "python", "node", "function", "class", "cli", "branch", "project", "merge", "critic", "score",
)
CODE = r"\b(function|class|const|let|var|return|async|await|import|export)\b|=>|\{\s*\""

# Files and folders of a project whose texts a model learns from, or doesn't.
EXTENSIONS = (
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".json", ".md", ".txt", ".py", ".java", ".go", ".rs", ".c", ".cc", ".cpp", ".h", ".hpp", ".css", ".scss", ".html", ".yml", ".yaml", ".toml", ".ini",
)
SKIPPED_FOLDERS = (".git", "node_modules", "dist", "build", "coverage", "out", "data", "logs", "tmp", ".tmp", ".venv", "venv", ".cache", "target", ".next")


def project_corpus(files: DataFrame, budget: int = 2_000_000, least: int = 32, group: str = "projectId", order: str = "path", column: str = "source") -> DataFrame:
    """Normalised texts of each project in order of path until ``budget`` characters; the last one is cut to fit, and
    texts of one path count together.

    Lengths alone are summed in order, over ranges of paths, so neither texts nor all of a project's rows meet in a task.
    """
    clean = files.withColumn("snippet", text.normalize_whitespace(F.col(column))).where(F.length("snippet") >= least)
    sizes = clean.groupBy(F.col(group).alias("g"), F.col(order).alias("o")).agg(F.sum(F.length("snippet")).alias("n"))
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(sizes.repartitionByRange(parts, "g", "o").withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("g", "part").agg(F.sum("n").alias("n"))  # a row per partition, and one more per project
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("g", "part").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_parts = totals.select(F.col("g").alias("og"), F.col("part").alias("op"), earlier.alias("earlier")).where(F.col("earlier") < budget)
    before = ranged.join(open_parts, F.col("g").eqNullSafe(F.col("og")) & (F.col("part") == F.col("op"))).select("g", "o", (F.col("earlier") + within).alias("before")).where(F.col("before") < budget)
    kept = clean.join(before, clean[group].eqNullSafe(before["g"]) & clean[order].eqNullSafe(before["o"])).drop("g", "o")
    return kept.withColumn("snippet", F.substr("snippet", F.lit(1), (F.lit(budget) - F.col("before")).cast("int"))).drop("before")


def memory_corpus(memories: DataFrame, limit: int = 250, most: int = 4000) -> DataFrame:
    """(id, snippet) of the newest memories."""
    newest = memories.orderBy(F.desc("lastAccessedAt"), "id").limit(limit)
    return newest.select("id", F.substring(F.concat(F.lit("# memory:"), "id", F.lit("\n"), F.concat_ws("\n", "title", "summary", "content")), 1, most).alias("snippet"))


def leaves(value: Column, kind: T.DataType, least: int = 24, depth: int = 0, deepest: int = 4) -> Column:
    """The normalised texts of ``least`` characters and more in a nested value, in the order of its fields and items, down
    to ``deepest`` levels below it; an expression made from the value's type."""
    none = F.expr("CAST(array() AS array<string>)")
    if depth > deepest:
        return none
    if isinstance(kind, T.StringType):
        clean = text.normalize_whitespace(value)
        return F.filter(F.array(clean), lambda x: F.length(x) >= least)
    if isinstance(kind, T.StructType):
        parts = [leaves(value[f.name], f.dataType, least, depth + 1, deepest) for f in kind.fields]
        return F.coalesce(F.concat(*parts), none) if parts else none
    if isinstance(kind, T.MapType):
        return F.coalesce(F.flatten(F.transform(F.map_values(value), lambda x: leaves(x, kind.valueType, least, depth + 1, deepest))), none)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda x: leaves(x, kind.elementType, least, depth + 1, deepest))), none)
    return none


def json_texts(value: object, deepest: int = 4) -> Iterator[str]:
    """The strings in a JSON value in the order of its keys and items, down to ``deepest`` levels."""
    if isinstance(value, str):
        yield value
    elif deepest and isinstance(value, dict | list):
        for x in value.values() if isinstance(value, dict) else value:
            yield from json_texts(x, deepest - 1)


def json_leaves(column: Column, least: int = 24) -> Column:
    """The same of JSON objects as text, whose keys keep their order; what isn't JSON has none."""

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        def texts(value: str | None) -> list[str]:
            try:
                return list(json_texts(json.loads(value or "null")))
            except ValueError:
                return []

        return values.map(texts)

    return F.filter(F.transform(run(column), text.normalize_whitespace), lambda x: F.length(x) >= least)


def technical(rows: DataFrame, parts: Column, name: str, most: int = 3000) -> DataFrame:
    """Rows whose ``parts``, joined and cut to ``most``, are technical, as ``snippet`` under a heading."""
    low = text.simple_lower(F.col("joined"))
    told = low.rlike("|".join(TECHNICAL)) | low.rlike(text.ascii_bounds(CODE).replace(r"\s", r"[\t\n\f\r ]"))
    kept = rows.withColumn("joined", F.substring(F.array_join(parts, "\n"), 1, most)).where((text.trim(F.col("joined")) != "") & told)
    return kept.withColumn("snippet", F.concat(F.lit(f"# dataset:{name}\n"), "joined")).drop("joined")


def dataset_corpus(rows: DataFrame, *columns: str, name: str = "dataset", least: int = 24, most: int = 3000) -> DataFrame:
    """Technical rows of a dataset: their texts of ``least`` characters and more, joined, cut to ``most``, under a heading."""
    clean = [text.normalize_whitespace(F.col(c)) for c in columns]
    return technical(rows, F.filter(F.array(*clean), lambda x: F.length(x) >= least), name, most)


def nested_corpus(rows: DataFrame, *columns: str, name: str = "dataset", as_json: bool = False, least: int = 24, most: int = 3000) -> DataFrame:
    """The same of nested columns, whose texts are sought four levels down from the row; with ``as_json`` of one column
    of JSON objects as text, each of which is a row."""
    if as_json:
        return technical(rows, json_leaves(F.col(columns[0]), least), name, most)
    each = [leaves(F.col(c), rows.schema[c].dataType, least, 1) for c in columns]
    return technical(rows, F.concat(*each), name, most)
