"""SimHash near-duplicates: every pair of fingerprints within a radius, compared in tiles."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoatlas.llm.common import arrow_map, ascii_words, written
from repoatlas.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 2
# Fingerprints of a tile, about.
TILE = 2048
QUARTERS = 4


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is set if it is set in over half of the hashes of all word shingles.

    Words are cut at ASCII white space with A-Z lower-cased; fewer words than a shingle
    are one shingle, no words give zero.
    """
    return _majority(shingle_hashes(text, shingle))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of all word shingles in order, repeats included."""
    import xxhash

    words = ascii_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, SEED) for p in parts), np.uint64)


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 65_536):
        block = hashes[low : low + 65_536].astype("<u8", copy=False)
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed 64-bit number."""

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in batch["text"]], np.uint64)
            yield {"doc_id": batch["doc_id"], "fp": values.view(np.int64).tolist()}

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def _quarter_bits(fp: Column) -> list[Column]:
    quarter = [F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(QUARTERS)]
    return [F.bit_count(q) for q in quarter]


def _neighbours(radius: int) -> list[tuple]:
    """Differences of the four bit counts that fingerprints within the radius can have."""
    steps = [()]
    for _ in range(QUARTERS):
        steps = [
            (*s, d)
            for s in steps
            for d in range(-radius, radius + 1)
            if sum(map(abs, s)) + abs(d) <= radius
        ]
    return steps


def _code(counts) -> Column:
    code = F.lit(0)
    for c in counts:
        code = code * 32 + c
    return code.cast("int")


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect all of ``distinct(fp)`` that differ in at most ``radius`` bits.

    Fingerprints are tiled by the bit counts of their four quarters, and large tiles are
    cut by hash. Counts of linked fingerprints differ by no more than the radius in sum, so
    a tile meets only tiles that near; all other pairs of tiles are skipped. A tile's own
    rows are held, the rows of its neighbours stream past in blocks. Where a tile holds
    many links, only a forest that connects the same fingerprints leaves it.
    """
    counted = distinct.select("fp", *(b.alias(f"q{k}") for k, b in enumerate(_quarter_bits(F.col("fp")))))
    quarters = [F.col(f"q{k}") for k in range(QUARTERS)]
    counted = counted.withColumn("home", _code(quarters))
    # At most 17**4 rows, whatever the input: the number of tiles for each quadruple of counts.
    sizes = (
        written(counted.groupBy("home").count(), "tiles")
        .select("home", F.ceil(F.col("count") / tile).cast("int").alias("cuts"))
    )
    own = counted.join(F.broadcast(sizes), "home").withColumn(
        "cut", F.pmod(F.xxhash64("fp", F.lit(1)), "cuts").cast("int")
    )
    own = written(own.select("fp", "home", "cut", *quarters), "tiled")
    moves = [m for m in _neighbours(radius) if m >= (0,) * QUARTERS]
    targets = F.array(
        *(_code([q + F.lit(d) for q, d in zip(quarters, m)]) for m in moves)
    )
    valid = F.array(
        *(
            F.least(*(q + F.lit(d) for q, d in zip(quarters, m))) >= 0
            for m in moves
        )
    )
    away = (
        own.select("fp", "home", "cut", F.explode(F.arrays_zip(targets.alias("t"), valid.alias("v"))).alias("e"))
        .where("e.v")
        .select("fp", "home", "cut", F.col("e.t").alias("target"))
        .join(F.broadcast(sizes.select(F.col("home").alias("target"), "cuts")), "target")
        .select("fp", "home", "cut", "target", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("c"))
        .where("target <> home or c >= cut")
    )
    # Bit 0 of the side: a tile's own rows come first.
    sent = away.select(
        (F.col("target").cast("long") * (1 << 32) + F.col("c")).alias("tile"),
        ((F.col("target") != F.col("home")) | (F.col("c") != F.col("cut"))).cast("int").alias("side"),
        "fp",
    )

    def compare(batches):
        group = None
        for batch in batches:
            tiles = np.array(batch["tile"], np.int64)
            sides = np.array(batch["side"], np.int8)
            fps = np.array(batch["fp"], np.int64).view(np.uint64)  # bits of all, sign included
            edges = []
            starts = np.flatnonzero(np.r_[True, tiles[1:] != tiles[:-1]]) if len(tiles) else []
            for low, high in zip(starts, [*starts[1:], len(tiles)]):
                if group is None or group.tile != tiles[low]:
                    group = _Tile(tiles[low])
                group.add(fps[low:high], sides[low:high], radius, edges)
            found = np.concatenate(edges) if edges else np.zeros((0, 2), np.uint64)
            found = found.view(np.int64)
            yield {"a": found[:, 0].tolist(), "b": found[:, 1].tolist()}

    grouped = sent.repartition("tile").sortWithinPartitions("tile", "side")
    return arrow_map(grouped, compare, "a long, b long")


class _Tile:
    """Rows of one tile, which may come in several batches: its own first."""

    def __init__(self, tile):
        self.tile = tile
        self.own = np.zeros(0, np.uint64)

    def add(self, fps, sides, radius, edges):
        own, others = fps[sides == 0], fps[sides == 1]
        if len(own):
            everything = np.concatenate([self.own, own])
            self._against(own, everything, radius, edges)
            self.own = everything
        if len(others) and len(self.own):
            self._against(others, self.own, radius, edges)

    def _against(self, left, right, radius, edges):
        """Forest edges among the pairs of left and right within the radius."""
        step = max(1, (1 << 20) // max(1, len(right)))
        for low in range(0, len(left), step):
            block = left[low : low + step]
            bits = np.bitwise_count(block[:, None] ^ right[None, :])
            i, j = np.nonzero(bits <= radius)
            differ = block[i] != right[j]
            a, b = block[i[differ]], right[j[differ]]
            if len(a):
                edges.append(forest(a, b))


def forest(a, b):
    """Edges from each node to the smallest that it is connected to."""
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = codes[: len(a)], codes[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return np.stack([nodes[moved], nodes[label[moved]]], axis=1)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Equal fingerprints become one before anything is compared. Null texts and texts
    without words have fingerprint zero and link like others. Repeated rows give repeated
    rows. A null doc_id is never the smallest of a component; a component of such rows
    alone has a null component_id. Other columns are not read.
    """
    marks = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    edges = links(distinct.select("fp"), radius)
    roots = written(components(edges), "roots")
    linked = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = written(linked.join(least, "root").select("fp", "component_id"), "named")
    return marks.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Whole rows of one document of each component of ``near_duplicates``: the one with the
    smallest doc_id.

    Rows are told apart by a key that is written once with them, so null and repeated ids lose
    nothing: of rows that share the smallest id one stays, and a row without id stays only
    where no other row of its component has one. Texts without words are one component.
    """
    keyed = written(
        docs.select(
            F.monotonically_increasing_id().alias("key"),
            F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"),
        ),
        "keyed",
    )

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in batch["text"]], np.uint64)
            yield {"key": batch["key"], "doc_id": batch["doc_id"], "fp": values.view(np.int64).tolist()}

    marks = arrow_map(
        keyed.select("key", F.col("row.doc_id").cast("long").alias("doc_id"), "row.text"),
        run,
        "key long, doc_id long, fp long",
    )
    # One row for each fingerprint: of its rows only the first can stay.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    distinct = written(marks.groupBy("fp").agg(first), "distinct")
    roots = written(components(links(distinct.select("fp"), radius)), "roots")
    stay = (
        distinct.join(roots, distinct.fp == roots.node, "left")
        .groupBy(F.coalesce("root", "fp").alias("root"))
        .agg(F.min("first").alias("first"))
        .select(F.col("first.key").alias("key"))
    )
    # The list of those who stay grows with the rows: whole rows meet it by one shuffle, at every
    # size.
    return keyed.join(written(stay, "stay").hint("merge"), "key", "left_semi").select("row.*")
