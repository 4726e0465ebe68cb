"""Facts by content: what a file of a language declares follows from its hash alone.

    <base>/facts/run_id=<id>/...   imports, classes and functions of the hashes a run met first

Rows never change, so what a run that died has left is either complete or not there, and is
written anew under the same id. A hash that two runs wrote counts once.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoatlas.schemas import FACTS
from repoatlas.sources.state_store import read_or_empty

KEY = ["language", "file_hash"]


def load(spark: SparkSession, base: str) -> DataFrame:
    return read_or_empty(spark, f"{base}/facts", FACTS)


def add(spark: SparkSession, base: str, run_id: str, facts: DataFrame) -> None:
    rows = facts.select(*FACTS.names).hint("rebalance")
    rows.write.mode("overwrite").parquet(f"{base}/facts/run_id={run_id}")


def firsts(needed: DataFrame, known: DataFrame) -> DataFrame:
    """repo, path of one file for each content of ``needed`` that is not known yet.

    Copies are counted down in every task before the shuffle.
    """
    one = needed.where(F.col("file_hash").isNotNull()).groupBy(*KEY)
    one = one.agg(F.min(F.struct("repo", "path")).alias("first"))
    return one.join(known.select(*KEY), KEY, "left_anti").select("first.*")


def of_files(needed: DataFrame, known: DataFrame) -> DataFrame:
    """repo, path, language, imports, classes, functions of ``needed``; files without content
    have empty lists."""
    wanted = known.join(needed.select(*KEY).distinct(), KEY, "left_semi").dropDuplicates(KEY)
    joined = needed.select("repo", "path", *KEY).join(wanted, KEY, "left")
    lists = (f for f in FACTS.fields if f.name not in KEY)
    return joined.select(
        "repo",
        "path",
        "language",
        *(F.coalesce(f.name, F.array().cast(f.dataType)).alias(f.name) for f in lists),
    )
