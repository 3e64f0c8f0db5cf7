"""Engine tables made from the star schema, and readers for files. Every mapping is deterministic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import KINDS, SOURCE_TYPES

#: 2024-01-01 in milliseconds; all adapters count from it, none reads a clock.
T0 = 1_704_067_200_000
NOW = T0 + 40 * 86_400_000


#: Tables between these sizes in bytes are dealt out anew if they have fewer partitions than there are cores.
SPREAD_BYTES = (4 << 20, 1 << 30)


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores: one written in few row groups would be a task or two, however it is split.

    Larger tables, and those with a partition for each core, stay as they are, so what is shuffled has a bound.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if not SPREAD_BYTES[0] <= size <= SPREAD_BYTES[1] or df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores, df.columns[0])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as memories; labels set importance and confidence where there are any."""
    d, g = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    k = F.col("doc_id")
    created = F.lit(T0) + k * 60_000
    return d.join(g, "doc_id", "left").select(
        F.concat(F.lit("doc_"), k.cast("string")).alias("id"), F.col("source").alias("projectId"), pick(KINDS, k % 6).alias("kind"), pick(SOURCE_TYPES, k % 4).alias("sourceType"),
        F.substring("text", 1, 72).alias("title"), F.substring("text", 1, 180).alias("summary"), F.col("text").alias("content"), F.array("lang", "source").alias("tags"),
        F.coalesce(F.lit(0.4) + F.lit(0.4) * F.col("quality"), F.lit(0.6)).alias("importance"), F.coalesce(F.lit(0.9) - F.lit(0.3) * F.col("toxic"), F.lit(0.75)).alias("confidence"),
        created.alias("createdAt"), (created + k * 7919 % 86_400 * 1000).alias("lastAccessedAt"), F.concat(F.lit("src/"), F.col("lang"), F.lit("/"), (k % 97).cast("string"), F.lit(".ts")).alias("sourceRef"),
    )


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a log of writes: one upsert or delete of a logical row on a branch, at a microsecond."""
    e = read(spark, sf_dir, "events")
    u = F.col("user_id")
    return e.select(
        F.lit("p0").alias("projectId"), pick(("main", "feature", "release"), u % 3).alias("branch"), F.concat(F.lit("L"), (u % 50).cast("string")).alias("logicalId"), "event_id",
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("operation"), F.unix_micros(F.col("ts").cast("timestamp")).alias("validFrom"),
        F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("title"), F.col("event_type").alias("summary"), F.col("props").alias("content"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100)).alias("importance"), F.lit(0.75).alias("confidence"), (u % 7).cast("string").alias("sourceRef"),
    )


BRANCH_ROWS = [("p0", "main", None), ("p0", "release", "main"), ("p0", "feature", "release")]


def branches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BRANCH_ROWS, "projectId string, branch string, parentBranch string")


def current_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last write of each logical row per branch; deletes among them are tombstones."""
    w = Window.partitionBy("projectId", "branch", "logicalId").orderBy(F.desc("validFrom"), F.desc("event_id"))
    return writes(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as scheduler runs."""
    e = read(spark, sf_dir, "events")
    started = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    outcome = F.create_map(*[F.lit(x) for p in {"purchase": "applied", "view": "dry-run-only", "click": "indexed", "signup": "skipped", "error": "error"}.items() for x in p])[F.col("event_type")]
    return e.select(
        F.col("event_id").alias("runId"), F.concat(F.lit("scope"), (F.col("user_id") % 5).cast("string")).alias("schedulerScope"), pick(("timer", "manual", "startup"), F.col("event_id") % 3).alias("trigger"),
        outcome.alias("outcome"), (F.col("event_type") == "view").alias("dryRunOnly"), started.alias("startedAt"), (F.floor(F.col("value") * 10)).cast("long").alias("durationMs"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation, customer and supplier as a directed graph with weights in [0, 1]."""
    n, c, s = (read(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))

    def edge(df: DataFrame, a: str, af: str, b: str, bf: str, kind: str, weight: Column) -> DataFrame:
        return df.select(F.concat(F.lit(a), F.col(af).cast("string")).alias("fromNode"), F.concat(F.lit(b), F.col(bf).cast("string")).alias("toNode"), F.lit(kind).alias("type"), weight.alias("weight"), F.lit("p0").alias("projectId"))

    of = F.lit
    return (
        edge(n, "r", "n_regionkey", "n", "n_nationkey", "contains", of(0.9) - F.col("n_nationkey") * of(0.01))
        .unionByName(edge(c, "n", "c_nationkey", "c", "c_custkey", "has", (F.col("c_custkey") % 100) / of(100.0)))
        .unionByName(edge(s, "n", "s_nationkey", "s", "s_suppkey", "has", (F.col("s_suppkey") % 50) / of(50.0)))
    )


def text_files(spark: SparkSession, root: str, extensions: tuple[str, ...] | None = None, most_bytes: int | None = None, most_files: int | None = None, skipped: tuple[str, ...] | None = None) -> DataFrame:
    """(path, bytes, source) of whole text files under ``root``: known extensions, no heavy folders, no large files.

    Names that begin with a dot or an underscore are hidden from file sources.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"), F.col("value").alias("source"))
    below = F.regexp_replace("path", rf"^.*?\Q{root.rstrip('/')}\E", "")
    files = files.where(~below.rlike("/(" + "|".join(d.replace(".", "\\.") for d in skipped or SKIPPED_FOLDERS) + ")/"))
    if extensions:
        files = files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*extensions))
    if most_bytes is not None:
        files = files.where(F.col("bytes") <= most_bytes)
    return files.orderBy("path").limit(most_files) if most_files else files


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects, one a line, as of pairs for training; lines that aren't JSON are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


# Folders that are never read, extensions of code.
SKIPPED_FOLDERS = (
    ".git", "node_modules", "dist", "build", "coverage", ".next", "out", ".venv", "venv", "__pycache__", ".tox", ".pytest_cache", ".mypy_cache", ".cache", ".pnpm-store", ".turbo", ".idea", "target",
)
CODE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".py", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".java", ".go", ".rs")
