"""Vector codes: one codebook for each part of the vectors, fitted by whole-number Lloyd rounds.

Rounds are exact. A part keeps its distance to the entry it has; where that entry did not move,
only the entries that did are compared with it.
"""

import hashlib
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoatlas.llm.common import written
from repoatlas.llm.vectors import (
    LARGEST,
    join_totals,
    map_blocks,
    matrix,
    usable_vectors,
    whole,
)
from repoatlas.sources.workspace import new_dir

SCALE = 4096
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Codes:
    parts: int = 8
    entries: int = 16  # 256 at most: an index is a byte
    rounds: int = 6


def scaled(vectors: np.ndarray, parts: int) -> np.ndarray:
    """floor(SCALE * x) as (row, part, position): 64-bit integers if distances of them fit."""
    floors = np.clip(np.floor(vectors.astype(float) * SCALE), -LARGEST, LARGEST)
    return whole(floors, _small(floors)).reshape(len(floors), parts, -1)


def _small(floors: np.ndarray) -> bool:
    largest = float(np.abs(floors).max(initial=0.0))
    return 4 * largest * largest * max(1, floors.shape[-1]) < float(1 << 61)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of ``book(entry, position)`` for each row
    of ``x(row, position)``; ties go to the lower index."""
    best, code = None, np.zeros(len(x), np.uint8)
    for e in range(len(book)):
        apart = x - book[e]
        distance = (apart * apart).sum(axis=1)
        if best is None:
            best = distance
            continue
        closer = np.asarray(distance < best, bool)
        code[closer] = e
        best = np.where(closer, distance, best)
    return code, best


def advance(x, book, moved, code, distance):
    """New ``code`` and ``distance`` of the rows of one part, in place, after the entries in
    ``moved`` changed.

    Rows whose entry stayed compare the moved entries with the distance they have; the others
    are compared with all entries.
    """
    stays = ~moved[code]
    again, rows = np.flatnonzero(~stays), np.flatnonzero(stays)
    if len(again):
        code[again], distance[again] = nearest(x[again], book)
    for e in np.flatnonzero(moved):
        if not len(rows):
            break
        apart = x[rows] - book[e]
        d = (apart * apart).sum(axis=1)
        closer = np.asarray((d < distance[rows]) | ((d == distance[rows]) & (e < code[rows])), bool)
        code[rows[closer]], distance[rows[closer]] = e, d[closer]


def _first_books(rows: DataFrame, shape: Codes, length: int) -> np.ndarray:
    """(part, entry, position): the parts of the smallest ids; no more than ``entries`` rows are
    read. Null ids come last, equal ids by their vectors."""
    order = [F.col("vec_id").asc_nulls_last(), "vector"]
    first = rows.orderBy(*order).limit(shape.entries).select("vector").collect()
    x = np.array([r.vector for r in first], float).reshape(len(first), length)
    return scaled(x, shape.parts).transpose(1, 0, 2)


# Rows with their state, then rows with a task's members and sums of an entry. A vector is the
# bytes of its numbers, which pass to Python without a step per number.
STATE = (
    "vec_id long, label string, vector binary, codes binary, distances binary,"
    " part int, entry int, members long, sums array<decimal(38,0)>"
)


def _unpacked(column: pa.Array, kind: str) -> np.ndarray:
    """Equally long byte strings as rows of a matrix."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), -1)


def _round(table: DataFrame, kind: str, books: np.ndarray, moved: np.ndarray | None, parts: int) -> DataFrame:
    """The rows with new codes and exact distances; after them, from each task, the members and
    sums of the entries.

    Vectors too large for 64-bit distances are compared with all entries in whole numbers of
    any size, and carry no distances.
    """
    small = books.dtype != object and _small(books.reshape(-1, books.shape[2]).astype(float))

    def run(batches):
        members = np.zeros(books.shape[:2], np.int64)
        sums = np.zeros(books.shape, object)
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            given = batch.column("vector")
            packed = pa.types.is_binary(given.type)
            vectors = _unpacked(given, kind) if packed else matrix(given, parts * books.shape[2])
            x = scaled(vectors, parts)
            exact = small and x.dtype != object
            code = np.zeros((n, parts), np.uint8)
            distance = np.zeros((n, parts), np.int64 if exact else object)
            old = None if moved is None else batch.column("distances")
            if old is not None and exact and old.null_count == 0:
                code = _unpacked(batch.column("codes"), "u1").copy()
                distance = _unpacked(old, "<i8").astype(np.int64)
                for p in range(parts):
                    mine, near = code[:, p].copy(), distance[:, p].copy()
                    advance(x[:, p], books[p], moved[p], mine, near)
                    code[:, p], distance[:, p] = mine, near
            else:
                for p in range(parts):
                    code[:, p], distance[:, p] = nearest(x[:, p], books[p])
            for p in range(parts):
                members[p] += np.bincount(code[:, p], minlength=books.shape[1])
                total = np.zeros(books.shape[1:], x.dtype)
                np.add.at(total, code[:, p], x[:, p])
                sums[p] += total.astype(object)
            yield {
                "vec_id": batch.column("vec_id"),
                "label": batch.column("label"),
                "vector": given if packed else [v.tobytes() for v in vectors],
                "codes": [c.tobytes() for c in code],
                "distances": [d.astype("<i8").tobytes() for d in distance] if exact else [None] * n,
                "part": [None] * n,
                "entry": [None] * n,
                "members": [None] * n,
                "sums": [None] * n,
            }
        used = np.argwhere(members > 0)
        blank = [None] * len(used)
        yield {
            **{c: blank for c in ("vec_id", "label", "vector", "codes", "distances")},
            "part": used[:, 0].tolist(),
            "entry": used[:, 1].tolist(),
            "members": [int(members[p, e]) for p, e in used],
            "sums": [[Decimal(int(s)) for s in sums[p, e]] for p, e in used],
        }

    return map_blocks(table, run, STATE)


def _moved_books(table: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries as floors of their members' means, and which differ from before. The driver
    gets one number for each position of each entry."""
    found = (
        table.where("part is not null")
        .select("part", "entry", "members", F.posexplode("sums").alias("i", "s"))
        .groupBy("part", "entry", "i")
        .agg(F.sum("members").alias("n"), F.sum("s").alias("s"))
        .collect()
    )
    new = books.astype(object)
    for r in found:
        new[r.part, r.entry, r.i] = int(r.s) // r.n
    moved = (new != books).any(axis=2)
    if books.dtype != object:
        new = new.astype(np.int64)
    return new, np.asarray(moved, bool)


def _saved(table: DataFrame) -> tuple[DataFrame, str]:
    path = new_dir(table.sparkSession, "vector-codes")
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path), path


def _drop(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def compress(embeddings: DataFrame, shape: Codes = Codes()) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label (as text), code, error of each usable vector, and the codebooks as (part,
    entry, position).

    Each round rewrites the rows with their codes and distances into the shared folder and drops
    the table before it, so two tables are held and a lost executor costs one task's rows. The
    rows never move between tasks, so copies are no hot key.

    Vectors that are null, empty, hold null or non-finite entries or do not cut into equal
    parts have no rows; where lengths differ see ``usable_vectors``. Floors beyond 62 bits
    count as that; an error that does not fit a long is null. Fewer vectors than entries give
    fewer entries. Null and repeated ids stay rows.
    """
    spark = embeddings.sparkSession
    rows, length = usable_vectors(embeddings, shape.parts)
    single = embeddings.schema["embedding"].dataType.elementType.simpleString() == "float"
    kind = "f4" if single else "f8"
    rows = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label") if "label" in embeddings.columns
        else F.lit(None).cast("string").alias("label"),
        F.transform("embedding", lambda c: c if single else c.cast("double")).alias("vector"),
    )
    out = "vec_id long, label string, code string, error long"
    books = _first_books(rows, shape, length) if length else np.zeros((shape.parts, 0, 0), np.int64)
    if not books.size:
        return spark.createDataFrame([], out), books
    table, path = _saved(_round(rows, kind, books, None, shape.parts))
    for _ in range(shape.rounds):
        books, moved = _moved_books(table, books)
        if not moved.any():
            break  # nothing can change any more
        before = path
        table, path = _saved(_round(table.where("part is null"), kind, books, moved, shape.parts))
        _drop(spark, before)
    final = table.where("part is null")

    def finish(batches):
        for batch in batches:
            errors = []
            x = None
            for i, raw in enumerate(batch.column("distances").to_pylist()):
                if raw is not None:
                    errors.append(int(np.frombuffer(raw, "<i8").astype(object).sum()))
                    continue
                if x is None:
                    x = scaled(_unpacked(batch.column("vector"), kind), shape.parts)
                one = [nearest(x[i : i + 1, p].astype(object), books[p].astype(object))[1][0] for p in range(shape.parts)]
                errors.append(sum(int(d) for d in one))
            yield {
                "vec_id": batch.column("vec_id"),
                "label": batch.column("label"),
                "code": [bytes(c).hex() for c in batch.column("codes").to_pylist()],
                "error": [e if e <= _LONG else None for e in errors],
            }

    return map_blocks(final, finish, out), books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(int(c)) for c in books.ravel()).encode()).hexdigest()


def vector_codes(embeddings: DataFrame, shape: Codes = Codes()) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256.

    ``label_error`` sums the errors of a label's rows (rows without label are one group); it is
    null if it does not fit a long. Sums are made in every task before the shuffle, and labels
    that hold many rows go to all tasks.
    """
    coded, books = compress(embeddings, shape)
    key = F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))
    coded = coded.withColumn("key", key)
    exact = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.groupBy("key").agg(
        F.when(F.count("error") == F.count(F.lit(1)), exact).try_cast("long").alias("label_error"),
        F.count(F.lit(1)).alias("copies"),
    )
    sums = written(sums, "label-errors")
    total = sums.agg(F.sum("copies")).first()[0] or 0
    return join_totals(coded, sums, "key", "copies", total).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )
