"""Is the map of each repository up to date?"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoatlas.functions import globs
from repoatlas.operators import changes
from repoatlas.settings import JobOptions
from repoatlas.sources.rules import filter_by_rules


def select_files(files: DataFrame, options: JobOptions, rules: DataFrame | None = None) -> DataFrame:
    """Path filter, placed before any use of the content."""
    if rules is not None:
        return filter_by_rules(files, rules)
    return files.where(globs.selected(F.col("path"), options.include, options.exclude))


def status(
    files: DataFrame, state_files: DataFrame, options: JobOptions, rules: DataFrame | None = None
) -> DataFrame:
    current = changes.hash_files(select_files(files, options, rules))
    return changes.status_summary(current, changes.changed_files(current, state_files))
