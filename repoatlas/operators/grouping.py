"""Ordered lists and texts per group, safe for groups of any size.

A group whose values fit a budget of bytes becomes one array or one text. A larger one is
ordered across the cluster and cut where running sums of bytes pass the budget; joining its
parts gives the whole. Each group is treated by its own size, so a hot one changes no other.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repoatlas.settings import PART_BYTES
from repoatlas.sources.workspace import materialize, written


def split_by_size(rows: DataFrame, keys, size: Column, budget: int) -> tuple[DataFrame, DataFrame]:
    """Rows of a stored table whose group fits the budget, and those of the other groups."""
    long = rows.groupBy(*keys).agg(F.sum(size).alias("n")).where(F.col("n") > budget).select(*keys)
    return rows.join(long, list(keys), "left_anti"), rows.join(long, list(keys), "left_semi")


def with_place(df: DataFrame, keys, order, size: Column) -> DataFrame:
    """``before``: the sum of ``size`` over a group's rows before each; a hot group is spread
    over many tasks.

    ``order`` must tell the rows of a group apart.
    """
    spread = materialize(
        df.withColumn("size", size)
        .repartitionByRange(*keys, *order)
        .withColumn("slice", F.spark_partition_id())
    )
    earlier = W.partitionBy(*keys).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    starts = spread.groupBy(*keys, "slice").agg(F.sum("size").alias("n"))
    starts = starts.select(*keys, "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    above = W.partitionBy(*keys, "slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = F.coalesce(F.sum("size").over(above), F.lit(0))
    return (
        spread.withColumn("local", local)
        .join(starts, [*keys, "slice"])
        .withColumn("before", F.col("start") + F.col("local"))
        .drop("start", "local", "slice", "size")
    )


def ordered_items(
    df: DataFrame, keys, order, value: Column, size: Column | None = None, budget: int = PART_BYTES
) -> DataFrame:
    """keys, part, items: the group's values in order, in ascending parts of about ``budget``
    bytes.

    ``size`` gives the bytes of a value, by default those of a text. Nothing is cut within a
    value, so a part goes over the budget by less than one.
    """
    keys, order = list(keys), list(order)
    size = F.octet_length(value) if size is None else size
    # Read several times, so computed once.
    rows = written(
        df.select(*keys, *order, value.alias("value"), (F.coalesce(size, F.lit(0)) + 1).cast("long").alias("bytes")),
        "items",
    )
    whole, long = split_by_size(rows, keys, F.col("bytes"), budget)
    cut = with_place(long, keys, order, F.col("bytes"))
    part = F.floor(F.col("before") / budget).cast("int")
    rows = whole.withColumn("part", F.lit(0)).unionByName(cut.withColumn("part", part).drop("before"))
    return rows.groupBy(*keys, "part").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(*order, "value"))), lambda r: r["value"]
        ).alias("items")
    )


def ordered_text(
    df: DataFrame, keys, order, value: Column, sep: str, budget: int = PART_BYTES
) -> DataFrame:
    """keys, part, text. Every part but the first starts with the separator."""
    items = ordered_items(df, keys, order, value, budget=budget)
    return items.select(
        *keys,
        "part",
        F.concat(
            F.when(F.col("part") > 0, F.lit(sep)).otherwise(F.lit("")),
            F.array_join("items", sep),
        ).alias("text"),
    )
