"""Shared scratch space for intermediate tables."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is missing a local session gets a temporary folder; a cluster
    must name a shared one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="repoatlas-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage through the reliable checkpoint folder."""
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows from a table in the shared folder, for tables that several readers share."""
    path = new_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small_enough(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A stored table, sent to all tasks if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= most else df


_TABLES: dict[tuple, str] = {}


# Rows of a file where a table is written by the tasks that made it. Scans pack files into about
# a task a core: small ones make even tasks.
_FILE_ROWS = 10_000


def stored(spark: SparkSession, key: tuple, build, shuffled: bool = True) -> DataFrame:
    """A derived table, written to the shared folder on first use in an application.

    Later readers scan Parquet: column pruning and pushed filters instead of a recompute.
    Rows that a shuffle has just spread evenly need not be ``shuffled`` again.
    """
    key = (spark.sparkContext.applicationId, *key)
    if key not in _TABLES:
        path = new_dir(spark, "table")
        if shuffled:
            # Files follow the data: adaptive execution sizes the partitions of a rebalance.
            build().hint("rebalance").write.parquet(path)
        else:
            build().write.option("maxRecordsPerFile", _FILE_ROWS).parquet(path)
        _TABLES[key] = path
    return spark.read.parquet(_TABLES[key])
