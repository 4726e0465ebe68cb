"""What the operators on vectors share: whole entries, numpy blocks, joins with hot keys."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Floors beyond this count as this; all sums of them fit 38 digits.
LARGEST = float(1 << 62)
# Sums and products below this are exact in 64-bit integers.
EXACT = 1 << 62
# A key with more than this part of all rows is sent to all tasks: fewer such keys than this.
HOT_PART = 1000


def finite(vector: Column) -> Column:
    return F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    )


def usable_vectors(embeddings: DataFrame, multiple: int = 1) -> tuple[DataFrame, int]:
    """The rows with a finite vector, all of one length, and that length (0: no such row).

    Null vectors, vectors with null or non-finite entries, and those whose length is no
    positive multiple of ``multiple`` are left out. Where lengths differ the most frequent
    one stays, of equally frequent ones the largest.
    """
    size = F.size("embedding")
    rows = embeddings.where(
        F.col("embedding").isNotNull() & (size > 0) & (size % multiple == 0) & finite(F.col("embedding"))
    )
    lengths = rows.groupBy(size.alias("length")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    length = most[0].length if most else 0
    return rows.where(size == length), length


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column without nulls as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def whole(values: np.ndarray, small: bool) -> np.ndarray:
    """Whole numbers as 64-bit integers, or as Python's where products of them may not fit."""
    return values.astype(np.int64) if small else np.vectorize(int, otypes=[object])(values)


def map_blocks(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str
) -> DataFrame:
    """``mapInArrow`` with a function from record batches to dicts of columns."""
    types = df.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(types)
        for out in function(batches):
            columns = [
                out[f.name].cast(f.type)
                if isinstance(out[f.name], pa.Array)
                else pa.array(out[f.name], f.type)
                for f in arrow
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, types)


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix as a list column; entries that are not numbers become null."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(
        np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32),
        pa.array(rows.ravel(), from_pandas=True),
    )


def join_totals(rows: DataFrame, totals: DataFrame, key: str, count: str, n: int) -> DataFrame:
    """``rows`` with the row of ``totals`` for their key; ``count`` says how many rows have it.

    Keys that hold over a thousandth of all ``n`` rows are fewer than a thousand: these go
    to all tasks. What is shuffled has no hot key.
    """
    hot = F.col(count) * HOT_PART > F.lit(n)
    few = F.broadcast(totals.where(hot))
    rest = rows.join(F.broadcast(totals.where(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(totals.where(~hot), key))
