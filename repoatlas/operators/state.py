"""State roll-ups and merges."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoatlas.operators.grouping import ordered_items
from repoatlas.settings import PART_BYTES


def state_rows(run_files: DataFrame) -> DataFrame:
    return run_files.select("repo", "path", "file_hash", "module")


def state_modules(run_files: DataFrame, run_ts: Column, budget: int = PART_BYTES) -> DataFrame:
    """state_modules(repo, module, part, generated_at, source_hashes) of a run."""
    items = ordered_items(
        run_files, ["repo", "module"], ["path"], F.col("file_hash"), budget=budget
    )
    return items.select(
        "repo",
        "module",
        "part",
        run_ts.alias("generated_at"),
        F.col("items").alias("source_hashes"),
    )


def upsert(saved: DataFrame, updates: DataFrame, keys) -> DataFrame:
    """Saved rows stay unless an update has their key; nothing is ever removed."""
    keys = list(keys)
    return updates.unionByName(
        saved.join(updates.select(*keys).distinct(), keys, "left_anti")
    )


def upsert_files(saved: DataFrame, run_files: DataFrame) -> DataFrame:
    """One full outer join: each file path occurs once on either side."""
    new = run_files.select(
        "repo", "path", F.struct("file_hash", "module").alias("new")
    )
    old = saved.select("repo", "path", F.struct("file_hash", "module").alias("old"))
    return (
        new.join(old, ["repo", "path"], "full_outer")
        .select("repo", "path", F.coalesce("new", "old").alias("s"))
        .select("repo", "path", "s.*")
    )


def last_run(runs: DataFrame) -> DataFrame:
    return runs.groupBy("repo").agg(F.max("last_run").alias("last_run"))


def files_of_scope(
    current: DataFrame, changed: DataFrame, scope: str = "changed"
) -> DataFrame:
    """Files of a run: the changed ones, or all files of the modules they touch."""
    if scope == "changed":
        return changed
    touched = changed.select("repo", "module").distinct()
    return current.join(touched, ["repo", "module"], "left_semi")
