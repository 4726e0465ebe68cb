"""Modules: grouping of files and their combined hash."""

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoatlas.functions import paths
from repoatlas.operators.grouping import ordered_items, split_by_size
from repoatlas.settings import PART_BYTES
from repoatlas.sources.workspace import written

_MODULE = ["repo", "module"]


def assign_modules(files: DataFrame, strategy: str = "directory", depth: int = 2) -> DataFrame:
    path = F.col("path")
    return files.withColumn("module", paths.module_name(path, strategy, depth)).withColumn(
        "module_path", paths.module_path(path, strategy, depth)
    )


def module_groups(run_files: DataFrame, budget: int = PART_BYTES) -> DataFrame:
    """modules(repo, module, part, module_path, files); files in path order."""
    size = F.octet_length("path") + F.octet_length("module_path") + HASH_BYTES
    items = ordered_items(
        run_files, _MODULE, ["path"], F.struct("path", "file_hash", "module_path"), size, budget
    )
    return items.select(
        *_MODULE,
        "part",
        F.col("items")[0]["module_path"].alias("module_path"),
        F.transform(
            "items",
            lambda f: F.struct(f["path"].alias("path"), f["file_hash"].alias("file_hash")),
        ).alias("files"),
    )


# A hash with its name.
HASH_BYTES = 71


def _digest_runs(batches):
    """SHA-256 over the chunks of each module, which arrive sorted; keeps one digest."""
    key, digest = None, None
    for batch in batches:
        done = []
        for repo, module, chunk, times in zip(
            batch["repo"], batch["module"], batch["chunk"], batch["times"]
        ):
            if (repo, module) != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (repo, module), hashlib.sha256()
            data, block = chunk.encode(), min(times, 10_000)
            for _ in range(times // block):
                digest.update(data * block)
            digest.update(data * (times % block))
        if done:
            yield pd.DataFrame(done, columns=["repo", "module", "combined_hash"])
    if key is not None:
        yield pd.DataFrame([(*key, digest.hexdigest())], columns=["repo", "module", "combined_hash"])


def combined_hashes(run_files: DataFrame, budget: int = PART_BYTES) -> DataFrame:
    """combined_hash per module: SHA-256 of its sorted, joined file hashes.

    Copies count. The hashes of a module within the budget are joined in memory. Beyond that a
    digest has to read its input in order, so each module's hashes are sorted and joined in
    parallel, in slices by their leading digits, and only those slices stream through the
    digest.
    """
    rows = written(run_files.select(*_MODULE, "file_hash"), "file-hashes")
    few, many = split_by_size(rows, _MODULE, F.lit(HASH_BYTES), budget)
    joined = F.array_join(F.sort_array(F.collect_list("file_hash")), "")
    small = few.groupBy(*_MODULE).agg(F.sha2(joined, 256).alias("combined_hash"))
    return small.unionByName(_streamed_hashes(many))


def _streamed_hashes(run_files: DataFrame) -> DataFrame:
    # A file without a hash adds nothing, as in the joined text above.
    hashed = run_files.withColumn("file_hash", F.coalesce("file_hash", F.lit("")))
    copies = hashed.groupBy(*_MODULE, "file_hash").agg(F.count(F.lit(1)).alias("times"))
    # Sixteen bits of the digest: slices of a module stay even, whatever its size.
    slice_of = F.substring("file_hash", 1, len("sha256:") + 4)
    single = F.col("times") == 1
    # A hash with copies is a chunk of its own; the rest of a slice is cut around it.
    runs = copies.groupBy(*_MODULE, slice_of.alias("slice")).agg(
        F.array_sort(F.collect_list(F.struct("file_hash", "times"))).alias("hashes"),
        F.min(single).alias("all_single"),
    )
    chunks = runs.select(
        *_MODULE,
        F.explode(
            F.when(
                F.col("all_single"),
                F.array(
                    F.struct(
                        F.array_join(F.transform("hashes", lambda h: h["file_hash"]), "").alias(
                            "chunk"
                        ),
                        F.lit(1).cast("long").alias("times"),
                    )
                ),
            ).otherwise(
                F.transform(
                    "hashes",
                    lambda h: F.struct(h["file_hash"].alias("chunk"), h["times"].alias("times")),
                )
            )
        ).alias("c"),
    ).select(*_MODULE, "c.chunk", "c.times")
    return (
        chunks.repartition(*_MODULE)
        .sortWithinPartitions(*_MODULE, "chunk")
        .mapInPandas(_digest_runs, "repo string, module string, combined_hash string")
    )
