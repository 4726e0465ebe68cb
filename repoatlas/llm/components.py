"""Connected components of a distributed edge table by large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoatlas.llm.common import written

STEPS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node reachable.

    Each step attaches the neighbours of a node to the smallest of them. A node with many
    neighbours needs only its minimum, which is aggregated before the shuffle; the join
    that brings it back is one that adaptive execution splits. Tables lie in the shared
    folder after each step.
    """
    edges = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    nodes = edges.select("a").union(edges.select("b")).distinct()
    state = _mark(edges)
    for _ in range(STEPS):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _attach(both, "b > a")
        small = written(_attach(large, None), "edges")
        now = _mark(small)
        edges = small
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"no fixed point in {STEPS} steps")
    roots = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return nodes.select(F.col("a").alias("node")).join(roots, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )


def _attach(edges: DataFrame, only: str | None) -> DataFrame:
    """Edges from each neighbour of a node, and from the node, to the smallest of them all."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = edges.join(least, "a")
    moved = (joined.where(only) if only else joined).select(F.col("b").alias("x"), "m")
    if only is None:
        moved = moved.union(least.select(F.col("a").alias("x"), "m"))
    return moved.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
    return tuple(row)
