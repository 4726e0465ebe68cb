"""Change detection by content hash."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repoatlas.functions import text
from repoatlas.sources.workspace import written


def hash_files(files: DataFrame) -> DataFrame:
    """hashed_files(repo, path, file_hash); the content stays behind."""
    return files.select("repo", "path", text.content_hash(F.col("content")).alias("file_hash"))


def changed_files(current: DataFrame, state_files: DataFrame) -> DataFrame:
    """Current files whose (path, hash) is not saved: new or modified."""
    return current.join(
        state_files.select("repo", "path", "file_hash"), ["repo", "path", "file_hash"], "left_anti"
    )


def with_saved_hash(current: DataFrame, state_files: DataFrame) -> DataFrame:
    saved = state_files.select("repo", "path", F.col("file_hash").alias("old_hash"))
    return current.join(saved, ["repo", "path"], "left")


def is_changed():
    return ~F.col("old_hash").eqNullSafe(F.col("file_hash"))


def change_kinds(current: DataFrame, state_files: DataFrame) -> DataFrame:
    """Every current file as added, modified or unchanged."""
    return with_saved_hash(current, state_files).withColumn(
        "change",
        F.when(F.col("old_hash").isNull(), F.lit("added"))
        .when(is_changed(), F.lit("modified"))
        .otherwise(F.lit("unchanged")),
    )


def changed_except(current: DataFrame, state_files: DataFrame) -> DataFrame:
    """The same answer as a set difference on (repo, path, hash)."""
    columns = ["repo", "path", "file_hash"]
    return current.select(*columns).exceptAll(state_files.select(*columns).distinct())


def first_paths(changed: DataFrame, limit: int = 10) -> DataFrame:
    """First paths per repository with their place.

    The rank filter is pushed below the shuffle, so a task keeps ``limit`` rows per
    repository and a hot repository is never gathered.
    """
    place = F.row_number().over(W.partitionBy("repo").orderBy("path"))
    return changed.select("repo", "path", place.alias("place")).where(F.col("place") <= limit)


def status_summary(current: DataFrame, changed: DataFrame, limit: int = 10) -> DataFrame:
    """Changed count, up-to-date flag, first paths and how many are left out."""
    repos = current.select("repo").distinct()
    # Counts and names read the list of changed files; the anti join runs once for both.
    changed = written(changed.select("repo", "path"), "changed")
    counts = changed.groupBy("repo").agg(F.count(F.lit(1)).alias("n_changed"))
    names = (
        first_paths(changed, limit)
        .groupBy("repo")
        .agg(F.sort_array(F.collect_list("path")).alias("first_paths"))
    )
    n = F.coalesce("n_changed", F.lit(0)).cast("long")
    return (
        repos.join(counts, "repo", "left")
        .join(names, "repo", "left")
        .select(
            "repo",
            n.alias("n_changed"),
            (n == 0).alias("up_to_date"),
            F.coalesce("first_paths", F.array().cast("array<string>")).alias("first_paths"),
            F.greatest(n - limit, F.lit(0)).cast("long").alias("n_more"),
        )
    )


def update_preview(run_files: DataFrame) -> DataFrame:
    """What a run would touch: modules and their number of files."""
    return run_files.groupBy("repo", "module").agg(F.count(F.lit(1)).alias("n_files"))
