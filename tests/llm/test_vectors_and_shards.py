"""Whitening, vector codes and shards against plain versions, and on odd rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from repoatlas.llm import sharding, vector_codes, whitening

import edge

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def odd_vectors(spark, width=8):
    def vector(*head):
        return [*head, *([0.25] * (width - len(head)))]

    rows = [
        (0, vector(1.0, 2.0), 1), (0, vector(1.0, 2.0), 1), (1, vector(NAN), 1), (2, vector(INF), 1),
        (3, vector(None), 1), (4, None, 1), (None, vector(1.0, 1.0), 1), (5, [1.0], 1), (6, [], 2),
        (7, vector(-0.5, 0.5), None), (8, vector(-0.5, 0.5), None), (9, vector(0.001), 2),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def given(spark):
    """The table, with copies that hold a third of the rows, ties and repeats."""
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    hot = table.where("vec_id = 7")
    copies = hot.withColumn("vec_id", F.explode(F.sequence(F.lit(10_000).cast("long"), F.lit(10_250).cast("long"))))
    return table.unionByName(copies).unionByName(table.where("vec_id < 3")).repartition(5)


def kept(rows, width=64):
    return [
        r for r in rows
        if r.embedding is not None and len(r.embedding) == width
        and all(c is not None and np.isfinite(c) for c in r.embedding)
    ]


def plain_whitening(rows):
    x = np.floor(np.array([r.embedding for r in rows], float) * 1024).astype(int) + 100_000
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    deviation = [sum(int(v) ** 2 for v in row) for row in (n * x - s).tolist()]
    trace = float((centred**2).sum() / n)
    return n, deviation, centred @ axes / np.sqrt(values), values / trace


def test_whitening(spark):
    table = given(spark)
    rows = kept(table.collect())
    n, deviation, whitened, explained = plain_whitening(rows)
    expected = sorted(
        (r.vec_id, k + 1, n, d, round(abs(w[k]), 7), round(explained[k], 7))
        for r, d, w in zip(rows, deviation, whitened)
        for k in range(8)
    )
    out = whitening.whiten(table).collect()
    found = sorted(
        (r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 7), round(r.explained, 7))
        for r in out
    )
    assert len(found) == len(expected)
    for f, e in zip(found, expected):
        assert f[:4] == e[:4] and np.allclose(f[4:], e[4:], rtol=1e-6, atol=1e-6)
    assert {r.identity_error for r in out} == {out[0].identity_error}
    assert 0 <= out[0].identity_error < 1e-9
    # One sign for all rows of a component.
    by_id = {(r.vec_id, r.component): r.whitened for r in out}
    for k in range(8):
        ours = np.array([by_id[r.vec_id, k + 1] for r in rows])
        assert abs(abs(np.dot(ours, whitened[:, k])) / n - 1) < 1e-6


def test_whitening_counts_each_distinct_vector_once_if_told(spark):
    table = spark.createDataFrame(
        [(i, [float(v), float(v * v % 5)], 0) for i, v in enumerate([1, 1, 1, 2, 3, 4])], SCHEMA
    )
    once = whitening.whiten(table.dropDuplicates(["embedding"]))
    twice = whitening.whiten(table, counted=False)
    assert {r.n for r in twice.collect()} == {4} and twice.count() == 12
    found = {(r.vec_id, r.component): round(r.whitened, 9) for r in twice.collect()}
    for r in once.collect():
        assert found[r.vec_id, r.component] == round(r.whitened, 9)


def test_whitening_of_odd_rows(spark):
    rows = whitening.whiten(odd_vectors(spark).withColumn("x", F.lit(1)).withColumn("key", F.lit("a")))
    rows = rows.collect()
    assert Counter(r.vec_id for r in rows) == {0: 16, None: 8, 7: 8, 8: 8, 9: 8}
    assert {r.n for r in rows} == {6}
    # Six entries never change: such components have no variance.
    assert {r.component for r in rows if r.whitened is None} >= {3, 4, 5, 6, 7, 8}
    assert all(r.identity_error < 1e-9 for r in rows)
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(3)], SCHEMA)
    for r in whitening.whiten(same).collect():
        assert (r.deviation, r.whitened, r.explained, r.identity_error) == (0, None, None, None)
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    huge = spark.createDataFrame([(0, [3e38, 1.0], 0), (1, [-3e38, 2.0], 0)], SCHEMA)
    assert {r.deviation for r in whitening.whiten(huge).collect()} == {None}


def plain_codes(rows, parts=8, entries=16, rounds=6):
    x = [[int(np.floor(float(c) * 4096)) for c in r.embedding] for r in rows]
    width = len(x[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in x]
    order = sorted(
        range(len(rows)), key=lambda i: (rows[i].vec_id is None, rows[i].vec_id or 0, rows[i].embedding)
    )
    books = [[list(cut[i][p]) for i in order[:entries]] for p in range(parts)]

    def assign():
        out = []
        for v in cut:
            best = [
                min((sum((a - b) ** 2 for a, b in zip(v[p], e)), i) for i, e in enumerate(books[p]))
                for p in range(parts)
            ]
            out.append(([i for _, i in best], sum(d for d, _ in best)))
        return out

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            members = defaultdict(list)
            for v, (code, _) in zip(cut, codes):
                members[code[p]].append(v[p])
            for i, m in members.items():
                books[p][i] = [sum(c) // len(m) for c in zip(*m)]
    codes = assign()
    errors = Counter()
    for r, (_, e) in zip(rows, codes):
        errors[r.label] += e
    flat = ",".join(str(c) for b in books for e in b for c in e)
    digest = hashlib.sha256(flat.encode()).hexdigest()
    return sorted(
        (
            (r.vec_id, "".join(f"{i:02x}" for i in code), e, errors[r.label], digest)
            for r, (code, e) in zip(rows, codes)
        ),
        key=repr,
    )


def test_vector_codes(spark):
    table = given(spark).withColumn("label", F.when(F.col("vec_id") % 7 > 0, F.col("label")))
    found = sorted((tuple(r) for r in vector_codes.vector_codes(table).collect()), key=repr)
    assert found == plain_codes(kept(table.collect()))


def test_active_entries_give_what_full_scans_give():
    draw = np.random.default_rng(4)
    x = draw.integers(-3, 4, (500, 2))
    book = draw.integers(-3, 4, (16, 2))
    code, distance = vector_codes.nearest(x, book)
    for _ in range(30):
        moved = draw.random(16) < 0.3
        book = np.where(moved[:, None], draw.integers(-3, 4, (16, 2)), book)
        vector_codes.advance(x, book, moved, code, distance)
        full = vector_codes.nearest(x, book)
        assert (code == full[0]).all() and (distance == full[1]).all()


def test_vector_codes_of_odd_rows(spark):
    odd = odd_vectors(spark)
    found = sorted((tuple(r) for r in vector_codes.vector_codes(odd).collect()), key=repr)
    rows = kept(odd.collect(), 8)
    assert found == plain_codes(rows)
    huge = spark.createDataFrame([(i, [3e12 * (i - 1), *[float(i)] * 7], None) for i in range(30)], SCHEMA)
    found = sorted((tuple(r) for r in vector_codes.vector_codes(huge.repartition(3)).collect()), key=repr)
    limit = (1 << 63) - 1
    expected = [
        (v, c, e if e <= limit else None, s if s <= limit else None, d)
        for v, c, e, s, d in plain_codes(huge.collect())
    ]
    assert [f[:2] + f[4:] for f in found] == [e[:2] + e[4:] for e in expected]
    assert [f[2] for f in found] == [e[2] for e in expected]
    assert vector_codes.vector_codes(spark.createDataFrame([], SCHEMA)).count() == 0
    narrow = spark.createDataFrame([(1, [1.0, 2.0], 1)], SCHEMA)
    assert vector_codes.vector_codes(narrow).count() == 0


@pytest.mark.parametrize("bucket_bytes", [20_000, 1 << 30])
def test_shards(spark, bucket_bytes):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").unionByName(edge.documents(spark))
    docs = docs.coalesce(3).checkpoint()
    plan = sharding.Sharding(bucket_bytes=bucket_bytes)
    folder = sharding.write_shards(docs, plan)
    back = sharding.read_shards(docs, folder)
    assert edge.plain(back.select("row.*")) == edge.plain(docs)
    slots = defaultdict(list)
    for r in back.select("shard", "slot").collect():
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    # Drawn at random: of documents that were neighbours, few are.
    place = {r.row.doc_id: (r.shard, r.slot) for r in back.collect()}
    near = sum(place[i][0] == place[i + 1][0] and place[i + 1][1] - place[i][1] == 1 for i in range(900))
    assert near < 10
    again = sharding.read_shards(docs, sharding.write_shards(docs, plan))
    assert edge.plain(again.select("row.doc_id", "shard", "slot")) == edge.plain(
        back.select("row.doc_id", "shard", "slot")
    )
    other = sharding.write_shards(docs, sharding.Sharding(seed=5, bucket_bytes=bucket_bytes))
    other = sharding.read_shards(docs, other).select("row.doc_id", "shard", "slot")
    assert edge.plain(other) != edge.plain(again.select("row.doc_id", "shard", "slot"))


def test_shards_of_odd_rows(spark):
    for frame in (edge.documents(spark), edge.clashing(spark).withColumn("shard", F.lit(99))):
        rows = sharding.shard_places(frame.checkpoint()).collect()
        assert len(rows) == len(edge.rows())
        expected = Counter(
            (r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in edge.rows()
        )
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expected
        assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    assert sharding.shard_places(edge.empty(spark)).count() == 0


def test_places_are_shuffled_like_fisher_yates(spark):
    """All orders of a small bucket come up about equally often."""
    counts = spark.createDataFrame([(b, 3) for b in range(3000)], "bucket int, n long")
    rows = sharding.bucket_orders(counts, 3, 3000).collect()
    assert sorted(r.start for r in rows) == list(range(0, 9000, 3))
    seen = Counter(tuple(r.places) for r in rows)
    assert len(seen) == 6 and all(400 < n < 600 for n in seen.values())


def test_native_shards_use_no_python(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    plan = contract.queries()["op12_shuffled_shards"](spark, SF_DIR)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert docs.count() == 1000
