"""Document tables, and their text form."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoatlas.schemas import MODULE_DOCS, OVERVIEWS


def write_docs(docs: DataFrame, path: str) -> None:
    """module_docs as a table, partitioned by repository."""
    docs.hint("rebalance", "repo").write.mode("overwrite").partitionBy("repo").parquet(path)


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODULE_DOCS).parquet(path).select(*MODULE_DOCS.names)


def write_overviews(overviews: DataFrame, path: str) -> None:
    overviews.hint("rebalance", "repo").write.mode("overwrite").partitionBy("repo").parquet(path)


def read_overviews(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OVERVIEWS).parquet(path).select(*OVERVIEWS.names)


def export_text(docs: DataFrame, path: str) -> None:
    """Plain text, one folder per document: repo=<repo>/doc_file=<name>/part=<n>."""
    (
        docs.select("repo", "doc_file", "part", "content")
        .write.mode("overwrite")
        .partitionBy("repo", "doc_file", "part")
        .text(path)
    )


def read_exported(spark: SparkSession, path: str) -> DataFrame:
    """Whole texts back from ``export_text`` (the writer ends each with a newline)."""
    schema = "value string, repo string, doc_file string, part int"
    whole = spark.read.schema(schema).text(path, wholetext=True)
    return whole.select(
        "repo", "doc_file", "part", F.regexp_replace("value", r"\n\z", "").alias("content")
    )


def read_markdown(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """All ``*.md`` files of a folder, whole, as (repo, doc_file, part, content)."""
    whole = spark.read.text(path, wholetext=True, pathGlobFilter="*.md")
    return whole.select(
        F.lit(repo).alias("repo"),
        F.col("_metadata.file_name").alias("doc_file"),
        F.lit(0).alias("part"),
        F.col("value").alias("content"),
    )
