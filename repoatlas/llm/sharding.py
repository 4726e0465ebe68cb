"""Shards by a two-pass external shuffle: scatter into buckets, then Fisher-Yates in each."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoatlas.llm.common import written
from repoatlas.sources.workspace import new_dir

SHARDS = 24
# Bytes of texts in a bucket, about.
BUCKET_BYTES = 4 << 20
# Buckets for each task of the second pass, on average: enough of them to come out even. Beyond
# so many tasks, more.
TASK_BUCKETS = 8
MOST_TASKS = 100_000
# Buckets whose counts one task sums up.
BLOCK = 1024
# A row costs this much besides its text.
ROW_BYTES = 8


@dataclass(frozen=True)
class Sharding:
    shards: int = SHARDS
    seed: int = 12
    bucket_bytes: int = BUCKET_BYTES


def size_of(text: Column) -> Column:
    """Bytes of a text in UTF-8 (null: none) and of its row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def _scattered(docs: DataFrame, plan: Sharding, buckets: int) -> DataFrame:
    """Rows as a struct with their number in the table and a bucket that follows from it."""
    return docs.select(
        F.monotonically_increasing_id().alias("number"),
        F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"),
    ).withColumn("bucket", F.pmod(F.xxhash64(F.lit(plan.seed), "number"), F.lit(buckets)).cast("int"))


def bucket_orders(counts: DataFrame, seed: int, buckets: int) -> DataFrame:
    """bucket, start, places: what comes before a bucket, and a Fisher-Yates shuffle of the
    places of its ``n`` rows. One row for each of ``counts(bucket, n)``.

    ``shuffle`` draws by its seed, the partition and the rows before, so buckets are dealt by
    number and sorted. Starts are summed within blocks of buckets and over blocks.
    """
    block = F.floor(F.col("bucket") / BLOCK)
    tasks = -(-buckets // BLOCK)
    before = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.withColumn("block", block)
    totals = rows.groupBy("block").agg(F.sum("n").alias("n"))
    # One row a block: some thousand at 100 TB.
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("block", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("block_start"))
    rows = rows.withColumn("inner", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return (
        rows.join(starts, "block")
        .select("bucket", "n", (F.col("block_start") + F.col("inner")).alias("start"))
        .repartition(tasks, "bucket")
        .sortWithinPartitions("bucket")
        .select(
            "bucket",
            "start",
            F.shuffle(F.sequence(F.lit(0), F.col("n").cast("int") - 1), seed).alias("places"),
        )
    )


def write_shards(docs: DataFrame, plan: Sharding = Sharding()) -> str:
    """Writes all rows in an order drawn at random, in shards whose counts differ by at most one.

    Returns the folder: Parquet files under ``shard=<n>``, with ``row`` (all columns as a
    struct, so no name can clash) and ``slot``, gapless from 0 in each shard.

    Pass one scatters the rows evenly into buckets of about ``bucket_bytes`` by a seeded hash
    of their number in the table; whatever ids, sources or texts repeat, no bucket is hot.
    Pass two takes each bucket in the order of those numbers, moves every row to the place that
    a Fisher-Yates shuffle of the bucket's places gives it, and writes. Buckets one after another
    are the order of all rows; shards are equal runs of it. Rows move once, and no task holds
    more than Spark's sorts do. Rows without text or id count like others, repeated rows
    stay apart, an empty table gives no files. ``docs`` is read three times and has to give its
    rows in the same order: a table, or a checkpoint. Reruns over the same splits agree.
    """
    totals = docs.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size_of(F.col("text"))), F.lit(0)).alias("bytes")
    ).first()
    buckets = max(1, -(-totals.bytes // plan.bucket_bytes))
    tasks = min(-(-buckets // TASK_BUCKETS), MOST_TASKS)
    counts = _scattered(docs, plan, buckets).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    orders = written(bucket_orders(counts, plan.seed, buckets), "bucket-orders")
    moved = _scattered(docs, plan, buckets).repartition(tasks, "bucket")
    place = Window.partitionBy("bucket").orderBy("number")
    numbered = moved.withColumn("nth", F.row_number().over(place))
    at = F.element_at("places", F.col("nth"))
    ranked = numbered.join(orders, "bucket").select("row", (F.col("start") + at).alias("rank"))
    shard = F.expr(f"cast((rank * {plan.shards}) div {max(1, totals.rows)} as int)")
    first = F.expr(f"(cast(shard as long) * {max(1, totals.rows)} + {plan.shards - 1}) div {plan.shards}")
    placed = ranked.withColumn("shard", shard).withColumn("slot", F.col("rank") - first)
    folder = new_dir(docs.sparkSession, "shards")
    (
        placed.select("row", "shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(folder)
    )
    return folder


def read_shards(docs: DataFrame, folder: str) -> DataFrame:
    """row, shard, slot of the shards written from ``docs``."""
    spark = docs.sparkSession
    shape = docs.select(
        F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"),
        F.lit(0).cast("long").alias("slot"),
        F.lit(0).alias("shard"),
    ).schema
    return spark.read.schema(shape).parquet(folder)


def shard_places(docs: DataFrame, plan: Sharding = Sharding()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (always null: the law is
    ``rows``) of each row, as the written shards give them. A null text has the checksum 0."""
    text = F.col("row.text")
    return read_shards(docs, write_shards(docs, plan)).select(
        F.col("row.doc_id").alias("doc_id"),
        size_of(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
