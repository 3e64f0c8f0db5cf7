"""Cutting the lineage of iterative plans with tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only on a local master without it."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="strata-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Paths of the tables that ``kept`` has made in this process, in order.
KEPT: list[str] = []


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder; it stays until ``remove_kept``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strata-{name}-{uuid.uuid4().hex}"
    KEPT.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_kept(spark: SparkSession, since: int = 0) -> None:
    """Removes the tables made since the ``since``-th; results made from them must be stored by then."""
    for path in KEPT[since:]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    del KEPT[since:]
