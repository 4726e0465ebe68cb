"""Change feed over arriving file versions.

    <out>/stream=<id>/batch=<n>/...          the changes of a micro-batch, written as a whole
    <checkpoint>/feed/arrived/...            the hashes of the batch at work
    <checkpoint>/feed/state/upto=<n>/bucket=<b>/...  the last hash of each file after batch n
    <checkpoint>/feed/log/...                finished states, one row each

The last hash of a file is that of its latest change after the last state, or the state's own.
A batch reads the buckets its files fall into, and compares versions by a window; the steps are
native. A replayed batch sees only batches before it and overwrites its own folder, so it
changes nothing.
"""

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repoatlas.functions import text
from repoatlas.sources.state_store import read_or_empty

CHANGES = "repo string, path string, version bigint, file_hash string, change string"

# Buckets of the state, by a hash of (repo, path); also the most rows of a list of touched ones.
BUCKETS = 256
# Changes since the last state, as a share of its rows, from which on it is written anew.
COMPACT_SHARE = 0.5

_HASHES = "repo string, path string, version bigint, file_hash string, bucket int"
_LOG = "upto bigint, n_files bigint"


def _bucket() -> Column:
    return F.pmod(F.xxhash64("repo", "path"), F.lit(BUCKETS)).cast("int").alias("bucket")


def stream_id(checkpoint: str) -> str:
    """Names the folder of a stream's changes: streams with their own checkpoints share ``out``."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def hashed_versions(versions: DataFrame) -> DataFrame:
    """(repo, path, version, file_hash, bucket): content is hashed before anything is shuffled."""
    file_hash = text.content_hash(F.col("content")).alias("file_hash")
    return versions.select("repo", "path", "version", file_hash, _bucket())


def changed_versions(known: DataFrame, arrived: DataFrame) -> DataFrame:
    """The arrived versions that differ from the one before.

    ``known(repo, path, version, file_hash, seq)`` holds earlier changes, ``seq`` the order of
    their batches. Versions of a file count in the order of batch and version; of equal versions
    the smaller hash is first. A version without content is no change to an unknown file. Only
    known files that arrived are shuffled: their list goes to the known ones by a broadcast where
    adaptive execution finds it small.
    """
    keys = arrived.select("repo", "path").distinct()
    columns = ["repo", "path", "version", "file_hash", "seq"]
    before = known.join(keys, ["repo", "path"], "left_semi").select(*columns, F.lit(False).alias("new"))
    after = arrived.withColumn("seq", F.lit(None).cast("bigint")).select(*columns, F.lit(True).alias("new"))
    order = Window.partitionBy("repo", "path").orderBy(
        F.col("seq").asc_nulls_last(), "version", "file_hash"
    )
    return (
        before.unionByName(after)
        .withColumn("last", F.lag("file_hash").over(order))
        .where(F.col("new") & ~F.col("file_hash").eqNullSafe(F.col("last")))
        .select(
            "repo", "path", "version", "file_hash",
            F.when(F.col("last").isNull(), "added").otherwise("modified").alias("change"),
        )
    )


class _Feed:
    """The tables of one stream, and the step for a batch."""

    def __init__(self, spark, out, checkpoint, saved, share):
        self.spark, self.saved, self.share = spark, saved, share
        self.changes_path = f"{out}/stream={stream_id(checkpoint)}"
        self.folder = f"{checkpoint.rstrip('/')}/feed"

    def log(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.folder}/log", _LOG)

    def changes(self) -> DataFrame:
        return read_or_empty(self.spark, self.changes_path, f"{CHANGES}, batch bigint")

    def known(self, before: int) -> DataFrame:
        """The rows that hold each file's last change before a batch, with their bucket."""
        last = self.log().where(F.col("upto") < before).agg(F.max("upto")).first()[0]
        since = self.changes().where(F.col("batch") < before)
        if last is not None:
            since = since.where(F.col("batch") > last)
        rows = since.select(
            "repo", "path", "version", "file_hash", _bucket(), F.col("batch").alias("seq")
        )
        if last is None:
            return rows
        state = self.spark.read.schema(_HASHES).parquet(f"{self.folder}/state/upto={last}")
        return rows.unionByName(state.withColumn("seq", F.lit(-1).cast("bigint")))

    def write_state(self, rows: DataFrame, upto: int) -> None:
        path = f"{self.folder}/state/upto={upto}"
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        counted = self.spark.read.schema(_HASHES).parquet(path)
        counted.agg(
            F.lit(upto).cast("bigint").alias("upto"), F.count(F.lit(1)).alias("n_files")
        ).write.mode("append").parquet(f"{self.folder}/log")

    def first_state(self) -> None:
        """What was saved before the stream began; later starts find it written."""
        if self.saved is not None and self.log().isEmpty():
            saved = self.saved.select(
                "repo", "path", F.lit(None).cast("bigint").alias("version"), "file_hash", _bucket()
            )
            self.write_state(saved, -1)

    def step(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id == 0:
            self.first_state()
        batch.write.mode("overwrite").parquet(f"{self.folder}/arrived")
        arrived = self.spark.read.schema(_HASHES).parquet(f"{self.folder}/arrived")
        touched = [r.bucket for r in arrived.select("bucket").distinct().collect()]
        known = self.known(batch_id).where(F.col("bucket").isin(touched))
        changed_versions(known, arrived).write.mode("overwrite").parquet(
            f"{self.changes_path}/batch={batch_id}"
        )
        self.compact(batch_id)

    def compact(self, batch_id: int) -> None:
        """A new state once the changes since the last one exceed a share of it."""
        last = self.log().where(F.col("upto") <= batch_id).agg(F.max_by(F.struct("upto", "n_files"), "upto")).first()[0]
        upto, n_files = (-1, 0) if last is None else last
        changes = self.changes().where(F.col("batch").between(upto + 1, batch_id)).count()
        if changes > self.share * n_files:
            newest = F.max_by(F.struct("version", "file_hash"), F.struct("seq", "version", "file_hash"))
            rows = self.known(batch_id + 1).groupBy("bucket", "repo", "path").agg(newest.alias("r"))
            self.write_state(rows.select("repo", "path", "r.version", "r.file_hash", "bucket"), batch_id)


def run_feed(
    versions: DataFrame,
    out: str,
    checkpoint: str,
    saved: DataFrame | None = None,
    share: float = COMPACT_SHARE,
) -> None:
    """Process everything that has arrived and append the changes to a table.

    ``versions`` streams (repo, path, version, content). ``saved``, the state files of the last
    run, is what the first batch of a new checkpoint compares with. Both folders are to be ones
    that all executors share.
    """
    feed = _Feed(versions.sparkSession, out.rstrip("/"), checkpoint, saved, share)
    query = (
        hashed_versions(versions)
        .writeStream.foreachBatch(feed.step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_changes(spark: SparkSession, out: str) -> DataFrame:
    """The changes of all streams that write to a table."""
    changes = spark.read.schema(CHANGES).option("basePath", out).parquet(out)
    return changes.select("repo", "path", "version", "file_hash", "change")


def feed_state(spark: SparkSession, saved: DataFrame, out: str) -> DataFrame:
    """(repo, path, file_hash) after the feed: the last change of each file over the saved state."""
    latest = read_changes(spark, out).groupBy("repo", "path").agg(
        F.max_by("file_hash", "version").alias("new_hash")
    )
    return saved.select("repo", "path", "file_hash").join(
        latest, ["repo", "path"], "full_outer"
    ).select("repo", "path", F.coalesce("new_hash", "file_hash").alias("file_hash"))
