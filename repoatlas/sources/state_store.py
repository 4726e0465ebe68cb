"""State as a log: immutable run folders with changed rows, and a table of published runs.

    <base>/files/run_id=<id>/repo=<repo>/...     state_files that a run changed
    <base>/modules/run_id=<id>/repo=<repo>/...   state_modules that it changed
    <base>/runs/...                              the log of runs, appended last

A repository's first run holds its whole state, later ones only what they changed; reading
takes of each key the row of the latest run. Where the changed rows since the last whole state
have grown to a share of it, ``compact`` writes the repository anew. A run writes only its own
repositories, under a new run id, and becomes visible with its rows in ``runs``. A failed run
leaves nothing that is read.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoatlas.schemas import RUN_LOG, STATE_FILES, STATE_JSON, STATE_MODULES, STATE_RUNS
from repoatlas.sources.workspace import written

# Run ids that are current at the same time up to which loads name them in a filter.
PRUNED_RUNS = 1_000
# Changed rows since the last whole state, as a share of it, from which on it is written anew.
COMPACT_SHARE = 0.5
KEYS = {"files": ["repo", "path"], "modules": ["repo", "module"]}
SCHEMAS = {"files": STATE_FILES, "modules": STATE_MODULES}


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def run_log(spark: SparkSession, base: str) -> DataFrame:
    return read_or_empty(spark, f"{base}/runs", RUN_LOG)


def load_runs(spark: SparkSession, base: str) -> DataFrame:
    """state_runs: what was published, without compactions."""
    return run_log(spark, base).where("not compacted").select(*STATE_RUNS.names)


def latest_runs(spark: SparkSession, base: str) -> DataFrame:
    """The last published run of each repository."""
    runs = run_log(spark, base).where("not compacted").groupBy("repo")
    return runs.agg(F.max_by("run_id", "seq").alias("run_id"), F.max_by("last_run", "seq").alias("last_run"))


def live_runs(log: DataFrame) -> DataFrame:
    """Rows of the log whose folders still count: from a repository's last whole state on."""
    since = log.where("is_whole").groupBy("repo").agg(F.max("seq").alias("since"))
    return log.join(since, "repo").where("seq >= since").drop("since")


def _load(spark: SparkSession, base: str, kind: str) -> DataFrame:
    schema = SCHEMAS[kind]
    stored = _copy(schema).add("run_id", "string")
    rows = read_or_empty(spark, f"{base}/{kind}", stored)
    live = live_runs(run_log(spark, base)).select("repo", "run_id", "seq")
    # A filter of literals on the partition column keeps old folders from being read.
    runs = [r.run_id for r in live.select("run_id").distinct().limit(PRUNED_RUNS + 1).collect()]
    if len(runs) <= PRUNED_RUNS:
        rows = rows.where(F.col("run_id").isin(runs))
    rows = rows.join(live, ["repo", "run_id"])
    key = KEYS[kind]
    if kind == "files":
        # One row of a run for each path.
        rest = F.struct(*(c for c in schema.names if c not in key))
        newest = rows.groupBy(*key).agg(F.max_by(rest, "seq").alias("r"))
        return newest.select(*(c if c in key else f"r.{c}" for c in schema.names))
    # A module may have several parts, which stay where they are.
    newest = rows.groupBy(*key).agg(F.max("seq").alias("seq"))
    return rows.join(newest, [*key, "seq"], "left_semi").select(*schema.names)


def _copy(schema):
    return type(schema)(list(schema.fields))


def load_files(spark: SparkSession, base: str) -> DataFrame:
    """state_files as the published runs leave them; empty where nothing was saved."""
    return _load(spark, base, "files")


def load_modules(spark: SparkSession, base: str) -> DataFrame:
    return _load(spark, base, "modules")


def save(
    spark: SparkSession,
    base: str,
    run_id: str,
    files: DataFrame,
    modules: DataFrame,
    run_ts: Column,
    share: float = COMPACT_SHARE,
) -> None:
    """Write the changed rows of a run, publish them, and compact where it is due.

    A run that died before it was published is overwritten; a published run id is refused.
    """
    log = run_log(spark, base)
    if not log.where(F.col("run_id") == run_id).isEmpty():
        raise ValueError(f"run {run_id} is published already")
    _write(spark, base, run_id, {"files": files, "modules": modules})
    order = log.groupBy("repo").agg(F.max("seq").alias("last"))
    changed = _counts(spark, base, run_id).join(order, "repo", "left")
    _publish(base, run_id, changed, F.coalesce("last", F.lit(-1)) + 1, F.col("last").isNull(), run_ts, False)
    compact(spark, base, f"{run_id}-compacted", share)


def _write(spark: SparkSession, base: str, run_id: str, tables: dict) -> None:
    for kind, df in tables.items():
        (
            # Even files per repository; a hot repository is split over tasks.
            df.hint("rebalance", "repo")
            .write.mode("overwrite")
            .partitionBy("repo")
            .parquet(f"{base}/{kind}/run_id={run_id}")
        )


def _counts(spark: SparkSession, base: str, run_id: str) -> DataFrame:
    stored = spark.read.schema(_copy(STATE_FILES)).parquet(f"{base}/files/run_id={run_id}")
    return stored.groupBy("repo").agg(F.count(F.lit(1)).alias("n_files"))


def _publish(base, run_id, repos, seq, is_whole, last_run, compacted) -> None:
    repos.select(
        "repo",
        F.lit(1).cast("int").alias("version"),
        last_run.cast("timestamp").alias("last_run"),
        F.lit(run_id).alias("run_id"),
        seq.cast("long").alias("seq"),
        is_whole.alias("is_whole"),
        F.lit(compacted).alias("compacted"),
        F.col("n_files").cast("long").alias("n_files"),
    ).write.mode("append").parquet(f"{base}/runs")


def compact(spark: SparkSession, base: str, run_id: str, share: float = COMPACT_SHARE) -> int:
    """Writes the whole state of the repositories whose changed rows exceed ``share`` of it, and
    publishes it in place of their runs so far. Returns how many there were."""
    live = live_runs(run_log(spark, base))
    sizes = live.groupBy("repo").agg(
        F.sum(F.when(F.col("is_whole"), F.col("n_files")).otherwise(0)).alias("whole"),
        F.sum(F.when(F.col("is_whole"), 0).otherwise(F.col("n_files"))).alias("changed"),
        F.max("seq").alias("last"),
        F.max_by("last_run", "seq").alias("at"),
    )
    # One row a repository, and the log is about to grow: stored first.
    due = written(sizes.where(F.col("changed") > F.col("whole") * share), "compaction")
    n = due.count()
    if n:
        tables = {k: _load(spark, base, k).join(due.select("repo"), "repo", "left_semi") for k in KEYS}
        _write(spark, base, run_id, tables)
        counted = _counts(spark, base, run_id).join(due, "repo")
        _publish(base, run_id, counted, F.col("last") + 1, F.lit(True), F.col("at"), True)
    return n


def drop_superseded(spark: SparkSession, base: str, most: int = PRUNED_RUNS) -> list[str]:
    """Deletes the folders of up to ``most`` runs that no repository reads any more; their ids.

    To be called while no older reader is at work.
    """
    log = run_log(spark, base)
    old = log.select("run_id").distinct().join(live_runs(log).select("run_id"), "run_id", "left_anti")
    runs = [r.run_id for r in old.limit(most).collect()]
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    for run_id in runs:
        for kind in KEYS:
            folder = jvm.Path(f"{base}/{kind}/run_id={run_id}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return runs


def import_json(spark: SparkSession, path: str, repo: str) -> tuple[DataFrame, DataFrame]:
    """(state_files, state_modules) of a saved JSON document; empty if absent or broken."""
    try:
        doc = spark.read.schema(STATE_JSON).json(path, multiLine=True)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        doc = spark.createDataFrame([], STATE_JSON)
    files = doc.select(F.explode("files").alias("path", "f")).select(
        F.lit(repo).alias("repo"), "path", F.col("f.hash").alias("file_hash"), "f.module"
    )
    modules = doc.select(F.explode("modules").alias("module", "m")).select(
        F.lit(repo).alias("repo"),
        "module",
        F.lit(0).alias("part"),
        F.to_timestamp("m.generated_at").alias("generated_at"),
        "m.source_hashes",
    )
    return files, modules
