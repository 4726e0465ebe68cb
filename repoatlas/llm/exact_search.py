"""Exact top-k by inner product with the threshold algorithm over sorted lists per dimension."""

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repoatlas.llm.common import arrow_map, written

SCALE = 256
K = 5
EVERY = 50
# Rows of a tile and queries that it is asked; both bound what a task holds.
ROWS = 2048
QUERIES = 4096
FIRST_DEPTH = 8
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and v, the components as floor(SCALE * x), of the vectors that take part."""
    x = F.col("embedding")
    finite = F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    )

    def floor(y):
        # Larger doubles are whole already, and beyond what a long holds.
        return F.when(F.abs(y) < _EXACT, F.floor(y).cast("double")).otherwise(y)

    scaled = F.transform(x, lambda c: floor(c.cast("double") * SCALE))
    return embeddings.where(F.col("vec_id").isNotNull() & x.isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v")
    )


class Lists:
    """The rows of a tile with one dimension count: vectors and a sorted list per dimension."""

    def __init__(self, ids, vectors):
        self.ids = np.array(ids, np.int64)
        self.x = np.array(vectors, np.float64).reshape(len(ids), -1)
        self.up = np.argsort(self.x, axis=0, kind="stable")
        self.up_values = np.take_along_axis(self.x, self.up, axis=0)
        self.largest = float(np.abs(self.x).max(initial=0.0))

    def top(self, query_id: int, query, k: int):
        """The k best (score, id) among the other ids; ties go to the smaller id.

        Sorted access goes down all lists at once, in steps that double; each row seen for
        the first time is scored in full. No unseen row can score more than the query times
        the values reached in the lists, so the search ends when that is below the k-th.
        """
        q = np.array(query, np.float64)
        x, values, n = self.x, self.up_values, len(self.ids)
        bound = self.largest * float(np.abs(q).max(initial=0.0)) * max(1, len(q))
        if bound >= _EXACT:  # beyond what doubles hold exactly: whole numbers of any size
            whole = np.vectorize(int, otypes=[object])
            x, values, q = whole(x), whole(values), whole(q)
        used = np.flatnonzero(q != 0)
        if not len(used):
            used = np.arange(min(1, len(q)))
        falling = np.array([q[d] > 0 for d in used], bool)
        seen = np.zeros(n, bool)
        done = np.zeros(n, bool)
        best: list[tuple] = []
        low, high = 0, min(FIRST_DEPTH, n)
        while low < n:
            depth = np.arange(low, high)
            at = np.where(falling, n - 1 - depth[:, None], depth[:, None])
            seen[self.up[at, used].ravel() if len(used) else np.arange(n)] = True
            fresh = np.flatnonzero(seen & ~done)
            done[fresh] = True
            fresh = fresh[self.ids[fresh] != query_id]
            if len(fresh):
                best = self._merge(best, fresh, x[fresh] @ q, k)
            if done.all():
                break
            edge = values[np.where(falling, n - high, high - 1), used] @ q[used]
            if len(best) == k and edge < best[-1][0]:
                break
            low, high = high, min(2 * high, n)
        return best

    def _merge(self, best, fresh, scores, k):
        if len(best) == k:
            hope = np.flatnonzero(scores >= best[-1][0])
            fresh, scores = fresh[hope], scores[hope]
        elif len(fresh) > 4 * k and scores.dtype != object:
            edge = np.partition(scores, len(scores) - k)[len(scores) - k]
            hope = np.flatnonzero(scores >= edge)
            fresh, scores = fresh[hope], scores[hope]
        found = [(int(s), i) for s, i in zip(scores.tolist(), self.ids[fresh].tolist())]
        return heapq.nsmallest(k, best + found, key=lambda r: (-r[0], r[1]))


def exact_top_k(
    embeddings: DataFrame, k: int = K, every: int = EVERY, rows: int = ROWS, queries: int = QUERIES
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows with
    another vec_id and as many components. Rows are dealt to blocks and queries to chunks by
    hash; a tile is one block with its sorted lists, asked by one chunk of queries, so what a
    task holds is bounded. Vectors that are null or hold null or non-finite components take no
    part, nor do rows without vec_id. Repeated rows are candidates each; a repeated query is
    asked once, with its smallest vector. Scores beyond a long are cut to its limits. Other
    columns are not read.
    """
    vectors = written(whole_vectors(embeddings), "vectors")
    asked = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = written(asked, "queries")
    blocks = max(1, -(-vectors.count() // rows))
    chunks = max(1, -(-asked.count() // queries))

    def dealt(df, other, side, tile):
        return df.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(other - 1)))).select(
            tile.cast("long").alias("tile"), F.lit(side).alias("side"), "vec_id", "v"
        )

    block = F.pmod(F.xxhash64("vec_id", F.hash("v")), F.lit(blocks))
    chunk = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(chunks))
    sent = dealt(vectors, chunks, 0, block * chunks + F.col("other")).union(
        dealt(asked, blocks, 1, F.col("other") * chunks + chunk)
    )

    def search(batches):
        tile, held, lists = None, {}, {}
        for batch in batches:
            out = {"query_id": [], "vec_id": [], "score": []}
            for number, side, vec_id, v in zip(
                batch["tile"], batch["side"], batch["vec_id"], batch["v"]
            ):
                if number != tile:
                    tile, held, lists = number, {}, {}
                if side == 0:
                    ids, rows_held = held.setdefault(len(v), ([], []))
                    ids.append(vec_id)
                    rows_held.append(v)
                    continue
                if len(v) not in lists and len(v) in held:
                    lists[len(v)] = Lists(*held.pop(len(v)))
                if len(v) in lists:
                    for score, found in lists[len(v)].top(vec_id, v, k):
                        out["query_id"].append(vec_id)
                        out["vec_id"].append(found)
                        out["score"].append(max(-_LONG - 1, min(_LONG, score)))
            yield out

    grouped = sent.repartition("tile").sortWithinPartitions("tile", "side", "vec_id")
    found = arrow_map(grouped, search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
