"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest thing any operator here broadcasts, in bytes.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; one of our own only where that is unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="strata-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Bytes of rows that travel to Python at once; Spark's own default is 64 MB.
BATCH_BYTES = 4 << 20


#: Bytes of input for a partition, as long as there are three for each core.
PART_BYTES = 16 << 20


def parts_of(df: DataFrame) -> int:
    """How many partitions a table of this size needs at most; small ones in many parts make many tiny files."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(1 << 30, max(3 * df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES)))


def text_batches(df: DataFrame) -> DataFrame:
    """``df`` in no more partitions than it needs, after the session's Arrow batches have been limited to
    ``BATCH_BYTES``, if they were larger.

    A longer text travels alone and whole. The setting is read when a query starts, so it stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.match(r"(\d+)([kmg]?)b?$", conf.get(key).strip().lower())
    factor = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    if not now or not 0 < int(now[1]) * factor[now[2]] <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df.coalesce(parts_of(df))


#: Paths of the tables that ``written`` has made in this process, in order.
MADE: list[str] = []


def written(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """``df`` as a Parquet table of at most ``parts`` files in the shared folder: cuts lineage and outlives executors;
    see ``remove_written``."""
    df = df.coalesce(parts) if parts else df
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strata-{name}-{uuid.uuid4().hex}"
    MADE.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(spark: SparkSession, since: int = 0, but: DataFrame | None = None) -> None:
    """Removes the tables made since the ``since``-th, but those that ``but`` reads; results made from them must be stored by then."""
    kept = {x.split("?")[0].rsplit("/", 1)[0] for x in but.inputFiles()} if but is not None else set()
    jvm = spark.sparkContext._jvm
    for path in [p for p in MADE[since:] if not any(k.endswith(p.split(":", 1)[-1].lstrip("/")) for k in kept)]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        MADE.remove(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front as long as ``df`` has a column that is called so."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name = f"_{name}"
    return name


def checked_broadcast(values: object, n_bytes: int, spark: SparkSession, what: str, limit: int = BROADCAST_BYTES):
    """A broadcast variable, refused beyond ``limit`` bytes."""
    if n_bytes > limit:
        raise ValueError(f"{what}: {n_bytes} bytes exceed the broadcast limit of {limit}")
    return spark.sparkContext.broadcast(values)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else kept; null stays null."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: For str.translate: A-Z to a-z and nothing else.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def lowered(text: str) -> str:
    """A-Z lower-cased in Python, quickly where the text is ASCII."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def columns_of(batch: pa.RecordBatch, *names: str) -> list[list]:
    """The named columns of a batch as Python lists."""
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into at most ``rows`` rows, so that long texts don't pile up."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
