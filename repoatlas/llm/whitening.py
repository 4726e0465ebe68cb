"""Whitening of embeddings by a covariance weighted with how often each vector occurs."""

from decimal import Decimal
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoatlas.llm.common import written
from repoatlas.llm.vectors import (
    EXACT,
    LARGEST,
    join_totals,
    lists,
    map_blocks,
    matrix,
    usable_vectors,
    whole,
)

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
_LONG = (1 << 63) - 1


def whole_entries(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, x: the entries as floor(SCALE * c) + SHIFT, and key, a digest of x. And the length."""
    rows, length = usable_vectors(embeddings)

    def entry(c: Column) -> Column:
        scaled = F.least(F.greatest(c.cast("double") * SCALE, F.lit(-LARGEST)), F.lit(LARGEST))
        return F.floor(scaled) + F.lit(SHIFT).cast("long")

    rows = rows.select("vec_id", F.transform("embedding", entry).alias("x"))
    return rows.withColumn("key", F.unhex(F.sha2(F.array_join("x", ","), 256))), length


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """key, x, times: each vector once. A hot one is counted in every task before the shuffle."""
    return rows.groupBy("key").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("times"))


@dataclass(frozen=True)
class Fit:
    """Of a list of n vectors: sums, eigenvalues (falling) and eigenvectors (columns)."""

    n: int
    sums: list
    small: bool  # n times any entry fits 64 bits
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def usable(self) -> np.ndarray:
        """Which eigenvalues are above rounding."""
        top = float(self.values.max(initial=0.0))
        return self.values > top * len(self.values) * np.finfo(float).eps


def _sums(distinct: DataFrame, length: int) -> tuple[int, list, bool]:
    """Number of vectors, exact sum of each entry, and whether n times any entry fits 64 bits."""

    def run(batches):
        n, sums, largest = 0, [0] * length, 0
        for batch in batches:
            x = matrix(batch.column("x"), length)
            times = batch.column("times").to_numpy()
            here = int(times.sum())
            top = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
            small = top * max(1, here) < EXACT
            found = whole(times, small) @ whole(x, small)
            n, largest = n + here, max(largest, top)
            sums = [a + int(b) for a, b in zip(sums, found)]
        yield {"n": [n], "largest": [largest], "sums": [[Decimal(s) for s in sums]]}

    parts = map_blocks(
        distinct.select("x", "times"), run, "n long, largest long, sums array<decimal(38,0)>"
    )
    # One row a task is counted; the driver gets one row an entry.
    parts = written(parts, "vector-sums")
    n, largest = parts.agg(F.sum("n"), F.max("largest")).first()
    if not n:
        return 0, [0] * length, True
    entry = parts.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s"))
    sums = [int(r.s) for r in entry.orderBy("i").collect()]
    return n, sums, 2 * largest * n < EXACT


def _centred(x: np.ndarray, n: int, sums: list, small: bool) -> np.ndarray:
    """n * x - sums, exactly."""
    return whole(x, small) * n - np.array(sums, np.int64 if small else object)


def fit(distinct: DataFrame, length: int) -> Fit:
    """Covariance of ``distinct(x, times)``, each vector counted ``times``, divisor n.

    Each task multiplies centred blocks, scaled by the roots of their weights, and gives one
    matrix; the matrices are summed entry by entry, so the driver gets length squared numbers.
    """
    n, sums, small = _sums(distinct, length)
    if not n:
        return Fit(0, sums, True, np.zeros(0), np.zeros((0, 0)), 0.0)

    def run(batches):
        total = np.zeros((length, length))
        for batch in batches:
            centred = _centred(matrix(batch.column("x"), length), n, sums, small).astype(float) / n
            scaled = centred * np.sqrt(batch.column("times").to_numpy()).astype(float)[:, None]
            total += scaled.T @ scaled
        yield {"entries": lists(total.reshape(1, -1))}

    parts = map_blocks(distinct.select("x", "times"), run, "entries array<double>")
    entry = parts.select(F.posexplode("entries").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("c"))
    found = [r.c for r in entry.orderBy("i").collect()]
    covariance = np.array(found).reshape(length, length) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(length)])
    return Fit(n, sums, small, np.maximum(values, 0.0), vectors * signs, float(np.trace(covariance)))


def whitened_vectors(distinct: DataFrame, length: int, model: Fit, components: int) -> DataFrame:
    """key, times, deviation, whitened: once for each distinct vector."""
    k = min(components, length)
    root = np.sqrt(np.where(model.usable[:k], model.values[:k], np.nan))
    axes = model.vectors[:, :k] / root
    n, sums, small = model.n, model.sums, model.small

    def run(batches):
        for batch in batches:
            centred = _centred(matrix(batch.column("x"), length), n, sums, small)
            largest = int(np.abs(centred).max(initial=0))
            squares = centred if largest * largest * length < EXACT else whole(centred, False)
            deviation = [int(d) for d in (squares * squares).sum(axis=1)]
            yield {
                "key": batch.column("key"),
                "times": batch.column("times"),
                "deviation": [d if d <= _LONG else None for d in deviation],
                "whitened": lists((centred.astype(float) / n) @ axes),
            }

    return map_blocks(
        distinct, run, "key binary, times long, deviation long, whitened array<double>"
    )


def identity_error(whitened: DataFrame, usable: list[int]) -> float | None:
    """Largest entry of the weighted covariance of ``whitened`` minus the identity."""
    if not usable:
        return None
    value, times = (lambda i: F.element_at("whitened", i + 1)), F.col("times")
    mean = whitened.agg(F.sum("times"), *(F.sum(times * value(i)) for i in usable)).first()
    n = mean[0]
    middle = {i: s / n for i, s in zip(usable, mean[1:])}
    pairs = [(i, j) for i in usable for j in usable if i <= j]
    found = whitened.agg(
        *(
            F.sum(times * (value(i) - F.lit(middle[i])) * (value(j) - F.lit(middle[j])))
            for i, j in pairs
        )
    ).first()
    return max(abs(s / n - (i == j)) for s, (i, j) in zip(found, pairs))


def whiten(embeddings: DataFrame, components: int = COMPONENTS, counted: bool = True) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened,
    explained, identity_error.

    Equal vectors become one with the number of its copies, which is its weight in the fit
    (``counted`` false: each counts once). Each distinct vector is whitened once and joins back
    by a digest of its entries; a vector that holds many rows is sent to all tasks, so its rows
    stay where they are.

    Vectors that are null, empty or hold null or non-finite entries have no rows; where
    lengths differ see ``usable_vectors``. Floors beyond 62 bits count as that. Null and
    repeated ids stay rows. A component without variance has a null ``whitened`` and counts
    neither in the error; a deviation that does not fit a long is null. Other columns are not
    read.
    """
    rows, length = whole_entries(embeddings)
    distinct = distinct_vectors(rows)
    weight = F.col("times") if counted else F.lit(1).cast("long")
    distinct = written(distinct.select("key", "x", "times", weight.alias("weight")), "distinct-vectors")
    weighted = distinct.select("key", "x", F.col("weight").alias("times"))
    model = fit(weighted, length)
    schema = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double,"
        " identity_error double"
    )
    if not model.n:
        return embeddings.sparkSession.createDataFrame([], schema)
    scored = written(whitened_vectors(weighted, length, model, components), "whitened")
    k = min(components, length)
    error = identity_error(scored, [int(i) for i in np.flatnonzero(model.usable[:k])])
    copies = distinct.select("key", F.col("times").alias("copies"))
    scored = scored.drop("times").join(copies, "key") if not counted else scored.withColumnRenamed("times", "copies")
    total = model.n if counted else rows.count()
    explained = F.array(
        *(
            F.lit(float(v) / model.trace if model.trace > 0 else None).cast("double")
            for v in model.values[:k]
        )
    )
    joined = join_totals(rows.select("vec_id", "key"), scored, "key", "copies", total)
    return joined.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened")).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        (F.col("i") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("i") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
