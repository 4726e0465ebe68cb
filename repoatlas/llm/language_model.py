"""Language-model scores: logistic mixing of hashed-context bit predictors over whole texts.

A text is coded in order, bit by bit: its words with a space between them, and an end byte.
Each bit is predicted from counts under hashed contexts of several orders, the bytes before it
in the text, across words. The predictions are mixed in the logistic domain by weights that
a gate chooses by how much the longer contexts have seen, and an adaptive map refines the mix.
Counts cover all training texts and are gathered by shuffles over table blocks; the mixer
learns online from all training texts, block of texts by block, with each occurrence left out
of the counts it is predicted from.

A byte's bits depend on it and on the seven bytes before it alone: within a block of texts a
string of eight bytes is coded once, and counts as often as it occurs.
"""

import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoatlas.llm.common import arrow_map, ascii_words, fold_of, written

FOLDS, HELD_OUT = 5, 1
# Bytes before the bit's byte that a predictor sees, and the bits of its table.
ORDERS = ((1, 17), (2, 19), (3, 21), (5, 22), (7, 22))
REACH = 7
OFFSETS = np.cumsum([0, *(1 << bits for _, bits in ORDERS)])
SLOTS = int(OFFSETS[-1])
BLOCK = 1 << 15
# Predictors whose counts choose the weights.
LONG, MIDDLE = 4, 2
GATES = 8 * 5
BUCKETS = 33
RATE = 0.02
START_WEIGHT = 0.3
PRIOR = 0.4
# The end of a text is a token of its own; words have a space between them.
END_OF_TEXT = b"\n"
# Tokens, and their longest, whose base scores go to all tasks: some 10 MB. The rest meet theirs
# in a join.
FREQUENT = 65_536
FREQUENT_BYTES = 64
# Distinct tokens that a task counts before it sends them on.
COUNTED = 300_000
# Bytes of texts that are coded together, strings coded at once, and bytes that a mixer learns
# from before mixers are averaged.
TEXT_BLOCK = 6_000_000
STRINGS = 16_384
LEARNER_BYTES = 24_000_000
# Sums over mixers are of whole multiples of this, so that their order does not count.
GRAIN = 2.0**-16
LOG2_10 = math.log2(10)
# Of each value of a half byte: its four bits, and the places in a row that predict them. Place 1 is
# the first bit, 2 and 3 the second after a zero and a one, and so on.
BITS = (np.arange(16)[:, None] >> np.arange(3, -1, -1) & 1).astype(np.float32)
NODES = (16 + np.arange(16)[:, None]) >> np.arange(4, 0, -1)


def sort_places(strings: np.ndarray) -> np.ndarray:
    """Sorts the strings in place and returns where each was: by the highest two bytes first, so
    that the sorts are short."""
    top = (strings >> np.uint64(48)).astype(np.uint16)
    order = np.argsort(top, kind="stable").astype(np.int32)
    strings[:] = strings[order]
    top = top[order]
    edges = (np.flatnonzero(top[1:] != top[:-1]) + 1).tolist()
    for low, high in zip([0, *edges], [*edges, len(strings)]):
        inner = np.argsort(strings[low:high])
        strings[low:high] = strings[low:high][inner]
        order[low:high] = order[low:high][inner]
    return order


class Events:
    """The bytes to predict in texts, each distinct byte after the same bytes once.

    ``times`` is how often each occurs. With ``places``, ``per_text`` sums values over texts.
    """

    def __init__(self, texts: list[bytes], places: bool = False):
        flat = np.frombuffer(b"".join([text + END_OF_TEXT for text in texts]), np.uint8)
        sizes = np.array([len(text) + 1 for text in texts], np.int64)
        self.begins = np.cumsum(sizes) - sizes
        # The byte itself is lowest and the one before it highest, so that in order of these
        # strings equal contexts of every order lie together.
        strings = flat
        for kind, width in ((np.uint16, 1), (np.uint32, 2), (np.uint64, 4)):
            wide = strings.astype(kind)
            wide <<= kind(8 * width)
            wide[width:] |= strings[:-width]
            strings = wide
        strings <<= np.uint64(8)
        strings |= flat
        for place in range(REACH):
            of_text = (1 << 64) - (1 << 64 - 8 * place) | 255
            strings[self.begins[sizes > place] + place] &= np.uint64(of_text)
        if places:
            order = sort_places(strings)
        else:
            strings.sort()
        fresh = np.ones(len(strings), bool)
        fresh[1:] = strings[1:] != strings[:-1]
        if places:
            self.place = np.empty(len(strings), np.int32)
            self.place[order] = np.cumsum(fresh, dtype=np.int32) - 1
            del order
        first = np.flatnonzero(fresh)
        self.strings = strings[first]
        self.times = np.diff(np.append(first, len(strings)))

    def __len__(self):
        return len(self.strings)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of an event's values over the bytes of each text."""
        return np.add.reduceat(values[self.place], self.begins, dtype=np.float64)

    def halves(self, part=slice(None)):
        """(rows per predictor, value) for both halves of the bytes of a part of the events: a row
        of a table holds what is seen of the half under one context."""
        strings = self.strings[part]
        byte = strings & np.uint64(255)
        high, low = byte >> np.uint64(4), byte & np.uint64(15)
        first, second = [], []
        for (order, bits), offset in zip(ORDERS, OFFSETS):
            seen = strings >> np.uint64(64 - 8 * order)
            if order == 1:
                row = seen * np.uint64(17)
                rows = row, row + np.uint64(1) + high
            else:
                mixed = seen * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
                mixed *= np.uint64(0xBF58476D1CE4E5B9)
                mixed ^= mixed >> np.uint64(32)
                then = (mixed + (high + np.uint64(1))) * np.uint64(0x94D049BB133111EB)
                then ^= then >> np.uint64(31)
                top = np.uint64(64 - (bits - 4))
                rows = [(x * np.uint64(0x9E3779B97F4A7C15)) >> top for x in (mixed, then)]
            for rows_of_half, row in zip((first, second), rows):
                rows_of_half.append((row.view(np.int64) << 4) + int(offset))
        yield first, high.view(np.int64)
        yield second, low.view(np.int64)

    def bits(self):
        """(slots per predictor, bit) for each of the eight bits of every event's byte."""
        for rows, value in self.halves():
            for n in range(4):
                yield [row + NODES[value, n] for row in rows], BITS[value, n]


class Mixer:
    """Weights by gate and the adaptive map, with the online update."""

    def __init__(self):
        self.weights = np.full((GATES, len(ORDERS)), START_WEIGHT)
        self.seen = np.zeros(GATES)
        self.hits = np.zeros((GATES, BUCKETS))
        self.total = np.zeros((GATES, BUCKETS))

    @staticmethod
    def levels(total):
        """How much a long and a middle context have seen, as the gate counts it."""
        level = np.log2(total + 1)
        return np.minimum(level, 7).astype(np.int64), np.minimum(level / 2, 4).astype(np.int64)

    def predict(self, zeros, ones):
        """Inputs, gate and the mixed probability of a one."""
        inputs = np.log((ones + PRIOR) / (zeros + PRIOR))
        long, _ = self.levels(zeros[LONG] + ones[LONG])
        _, middle = self.levels(zeros[MIDDLE] + ones[MIDDLE])
        gate = long * 5 + middle
        return inputs, gate, self.squash(self.mix(inputs, gate, self.weights.T))

    @staticmethod
    def mix(inputs, gate, weights):
        """Inputs weighed by the gate's weights and summed; a gate may hold for several bits."""
        total = 0
        for x, weight in zip(inputs, weights):
            chosen = weight.take(gate)
            total += x * chosen.reshape(chosen.shape + (1,) * (x.ndim - chosen.ndim))
        return np.clip(total, -12, 12)

    @staticmethod
    def squash(mixed):
        return 1 / (1 + np.exp(-mixed))

    def learn(self, inputs, gate, mixed, bit, weight):
        """One step for the four bits of each half byte, which share a gate."""
        step = (bit - self.squash(mixed)) * (np.float32(RATE) * weight)[:, None]
        mass = 4 * np.bincount(gate, weight, GATES)
        for k, x in enumerate(inputs):
            moved = np.bincount(gate, np.einsum("nb,nb->n", step, x), GATES)
            self.weights[:, k] += 50 * moved / (mass + 50) / (1 + self.seen / 5_000)
        self.seen += np.minimum(mass, 50)
        at = ((gate * BUCKETS)[:, None] + self.bucket(mixed)).ravel()
        for sums, values in ((self.total, np.repeat(weight, 4)), (self.hits, (weight[:, None] * bit).ravel())):
            sums += np.bincount(at, values, GATES * BUCKETS).reshape(GATES, BUCKETS)

    @staticmethod
    def bucket(mixed):
        return np.rint((mixed + 12) * ((BUCKETS - 1) / 24)).astype(np.int32)

    def refine(self, gate, p):
        """Halfway between the mix and what came of such mixes; the mix where nothing did."""
        mixed = np.clip(np.log(p / (1 - p)), -12, 12)
        slope, base = self.adaptive_map()
        return self.refined(gate * BUCKETS + self.bucket(mixed), p, slope, base)

    def adaptive_map(self):
        """0.5 * (p + (hits + 4 * p) / (total + 4)) as a line in p, for each gate and bucket."""
        slope, base = 0.5 + 2 / (self.total + 4), 0.5 * self.hits / (self.total + 4)
        return slope.ravel(), base.ravel()

    @staticmethod
    def refined(at, p, slope, base):
        return np.clip(p * slope.take(at) + base.take(at), 1e-6, 1 - 1e-6)


def text_blocks(batches):
    """(texts, the columns of their rows), cut by bytes whatever the batches. Texts are their words
    with a space between them."""
    texts, rows, size = [], {}, 0
    for batch in batches:
        others = [c for c in batch if c != "text"]
        for n, text in enumerate(batch["text"]):
            texts.append(b" ".join(ascii_words(text)))
            size += len(texts[-1]) + 1
            for c in others:
                rows.setdefault(c, []).append(batch[c][n])
            if size > TEXT_BLOCK:
                yield texts, rows
                texts, rows, size = [], {}, 0
    if texts:
        yield texts, rows


def token_table(training: DataFrame) -> DataFrame:
    """token, trained (occurrences): one row a token of the training texts.

    Counted in each task before the shuffle.
    """

    def count(batches):
        trained = Counter()
        for batch in batches:
            for text in batch["text"]:
                trained.update(ascii_words(text))
                trained[END_OF_TEXT] += 1
                if len(trained) > COUNTED:
                    yield {"token": list(trained), "trained": list(trained.values())}
                    trained = Counter()
        if trained:
            yield {"token": list(trained), "trained": list(trained.values())}

    counted = arrow_map(training.select("text"), count, "token binary, trained long")
    return written(counted.groupBy("token").agg(F.sum("trained").alias("trained")), "tokens")


def context_counts(training: DataFrame) -> np.ndarray:
    """How often each half byte followed in every row: sums over all training texts, block by
    block. A slot is a row and the value of the half.

    The tables have a fixed size; each task sends its own, compressed, and a block is summed
    in one place.
    """

    def packed(part):
        kind = np.uint8 if part.max() < 1 << 8 else np.uint16 if part.max() < 1 << 16 else np.int64
        return bytes([np.dtype(kind).itemsize]) + zlib.compress(part.astype(kind).tobytes(), 1)

    def unpacked(raw):
        kind = {1: np.uint8, 2: np.uint16, 8: np.int64}[raw[0]]
        return np.frombuffer(zlib.decompress(raw[1:]), kind).astype(np.int64)

    def count(batches):
        table = np.zeros(SLOTS, np.uint32)
        for texts, _ in text_blocks(batches):
            events = Events(texts)
            for low in range(0, len(events), STRINGS):
                part = slice(low, low + STRINGS)
                times = events.times[part].astype(np.uint32)
                for rows, value in events.halves(part):
                    for row in rows:
                        np.add.at(table, row + value, times)
        for low in range(0, SLOTS, BLOCK):
            part = table[low : low + BLOCK]
            if part.any():
                yield {"block": [low // BLOCK], "counts": [packed(part)]}

    def add(batches):
        block, total = None, None
        for batch in batches:
            out = {"block": [], "counts": []}
            for number, raw in zip(batch["block"], batch["counts"]):
                if number != block:
                    if block is not None:
                        out["block"].append(block)
                        out["counts"].append(packed(total))
                    block, total = number, unpacked(raw)
                else:
                    total = total + unpacked(raw)
            yield out
        if block is not None:
            yield {"block": [block], "counts": [packed(total)]}

    schema = "block int, counts binary"
    parts = arrow_map(training.select("text"), count, schema)
    sums = arrow_map(parts.repartition("block").sortWithinPartitions("block"), add, schema)
    table = np.zeros(SLOTS, np.float32)
    for row in sums.toLocalIterator():
        low = row.block * BLOCK
        table[low : low + BLOCK] = unpacked(row.counts)
    return table


def nodes(values: np.ndarray):
    """Zeros and ones seen at every bit of a half, from counts of its values. In a row, place 1 is
    the first bit, 2 and 3 the second after a zero and a one, and so on."""
    rows = values.reshape(-1, 16)
    zeros, ones = np.zeros_like(rows), np.zeros_like(rows)
    for first in (8, 4, 2, 1):
        zeros[:, first : 2 * first], ones[:, first : 2 * first] = rows[:, 0::2], rows[:, 1::2]
        rows = rows[:, 0::2] + rows[:, 1::2]
    return zeros.ravel(), ones.ravel()


def predictions(counts: np.ndarray, left_out: bool):
    """What each slot predicts, and the gate level of each row of the long and the middle
    predictor.

    ``left_out``: two entries a slot, for a bit of zero and of one, and two a row, as if one
    occurrence of that bit had not been counted yet.
    """
    sides = 2 if left_out else 1
    stretched = np.zeros((SLOTS, sides), np.float32)
    levels = np.zeros(SLOTS >> 4, np.uint8)
    for low in range(0, SLOTS, 1 << 20):
        high = min(SLOTS, low + (1 << 20))
        zeros, ones = nodes(counts[low:high])
        for side in range(sides):
            a = np.maximum(zeros - 1, 0) if left_out and side == 0 else zeros
            b = np.maximum(ones - 1, 0) if side == 1 else ones
            stretched[low:high, side] = np.log((b + PRIOR) / (a + PRIOR))
        total = np.maximum((zeros + ones)[1::16] - (1 if left_out else 0), 0)
        long, middle = Mixer.levels(total)
        is_long = np.arange(low, high, 16) >= OFFSETS[LONG]
        levels[low >> 4 : high >> 4] = np.where(is_long, long, middle)
    return stretched.ravel(), levels


def inputs_of(rows, value, table, left_out: bool):
    """Inputs of the mixer for the four bits of a half byte, and its gate."""
    stretched, levels = table
    places = 2 * NODES + BITS.astype(np.int64) if left_out else NODES
    places = places.take(value, axis=0)
    inputs = [stretched.take((row << 1 if left_out else row)[:, None] + places) for row in rows]
    return inputs, levels.take(rows[LONG] >> 4).astype(np.int64) * 5 + levels.take(rows[MIDDLE] >> 4)


def learn_block(mixer: Mixer, events: Events, table):
    """Learning from a block, its parts in a fixed order that takes them from all over it, as
    neighbours have like contexts."""
    parts = range(0, len(events), STRINGS)
    for low in sorted(parts, key=lambda low: low // STRINGS * 0x9E3779B1 & 0xFFFFFFFF):
        part = slice(low, low + STRINGS)
        times = events.times[part].astype(np.float32)
        for rows, value in events.halves(part):
            inputs, gate = inputs_of(rows, value, table, True)
            mixed = mixer.mix(inputs, gate, mixer.weights.T.astype(np.float32))
            mixer.learn(inputs, gate, mixed, BITS.take(value, axis=0), times)


def fit_mixer(training: DataFrame, table) -> Mixer:
    """The mixer after one pass over all training texts.

    Texts are dealt to learners by their hash and come in its order, so that nothing depends on
    how the input is laid out. Learners' weights are averaged by what they have seen, and
    their adaptive maps summed.
    """

    def learn(batches):
        mixer = Mixer()
        for texts, _ in text_blocks(batches):
            learn_block(mixer, Events(texts), table.value)
        values = np.concatenate(
            [
                (mixer.weights * mixer.seen[:, None]).ravel(),
                mixer.seen,
                mixer.hits.ravel(),
                mixer.total.ravel(),
            ]
        )
        yield {"at": list(range(len(values))), "value": np.rint(values / GRAIN).astype(np.int64).tolist()}

    text = F.coalesce("text", F.lit(""))
    texts = training.select(text.alias("text"), F.xxhash64(text).alias("key"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    learners = max(1, math.ceil(size / LEARNER_BYTES))
    dealt = texts.repartition(learners, "key").sortWithinPartitions("key").select("text")
    values = arrow_map(dealt, learn, "at int, value long")
    found = {r["at"]: r["value"] for r in values.groupBy("at").agg(F.sum("value").alias("value")).collect()}
    mixer = Mixer()
    flat = GRAIN * np.array([found.get(n, 0) for n in range(GATES * (len(ORDERS) + 1 + 2 * BUCKETS))])
    ends = np.cumsum([GATES * len(ORDERS), GATES, GATES * BUCKETS])
    weights, seen, hits, total = np.split(flat, ends)
    used = seen > 0
    mixer.weights[used] = weights.reshape(GATES, -1)[used] / seen[used, None]
    mixer.hits, mixer.total = hits.reshape(GATES, BUCKETS), total.reshape(GATES, BUCKETS)
    return mixer


def event_bits(events: Events, table, mixer: Mixer) -> np.ndarray:
    """Bits to code each event's byte."""
    out = np.zeros(len(events), np.float32)
    weights = mixer.weights.T.astype(np.float32)
    slope, base = (a.astype(np.float32) for a in mixer.adaptive_map())
    for low in range(0, len(events), STRINGS):
        part = slice(low, low + STRINGS)
        for rows, value in events.halves(part):
            inputs, gate = inputs_of(rows, value, table, False)
            mixed = mixer.mix(inputs, gate, weights)
            at = (gate * BUCKETS)[:, None] + mixer.bucket(mixed)
            p = mixer.refined(at, mixer.squash(mixed), slope, base)
            p = np.where(BITS.take(value, axis=0) > 0, p, 1 - p)
            out[part] -= np.log2(p[:, 0] * p[:, 1] * p[:, 2] * p[:, 3])
    return out


def language_scores(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte.

    Texts of the folds that are not held out are learned from. ``base_score`` is the smoothed
    unigram log10 probability, ``score`` the model's, the sum over the text's bits in order. Null
    texts are empty: their one token is the end. A null doc_id is in the training folds;
    repeated rows are learned from and scored each. Base scores of tokens seen most (a fixed
    number) are found where their documents are read; all others meet theirs in a join, so no
    frequent word is a hot key. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    training = docs.where("not held_out")
    tokens = token_table(training)
    size = tokens.agg(F.sum("trained").alias("n"), F.count("*").alias("v")).first()
    n, v = size.n or 0, size.v
    counts = context_counts(training)
    shared = spark.sparkContext.broadcast(predictions(counts, left_out=True))
    mixer = fit_mixer(training, shared)
    shared.destroy()
    table = spark.sparkContext.broadcast(predictions(counts, left_out=False))

    def base(trained):
        return F.log10((trained + 0.5) / F.lit(n + 0.5 * (v + 1)))

    short = tokens.where(F.octet_length("token") <= FREQUENT_BYTES)
    frequent = short.orderBy(F.desc("trained"), "token").limit(FREQUENT)
    frequent = frequent.select("token", base(F.col("trained")).alias("base")).collect()
    frequent = spark.sparkContext.broadcast({bytes(r.token): r.base for r in frequent})

    def score(batches):
        from pyspark import TaskContext

        row, hot = TaskContext.get().partitionId() << 40, frequent.value
        number = {token: n for n, token in enumerate(hot)}
        found_base = np.array([*hot.values(), 0.0])
        for texts, rows in text_blocks(batches):
            events = Events(texts, places=True)
            bits = events.per_text(event_bits(events, table.value, mixer))
            del events
            out = {c: [] for c in ("row", "token", "n", "size", "known", "base")}
            heads = {c: [] for c in out}
            for text in texts:
                of_text = text.split()
                of_text.append(END_OF_TEXT)
                found = np.fromiter(map(number.get, of_text, repeat(-1)), np.int32, len(of_text))
                unknown = np.flatnonzero(found < 0)
                for word, times in Counter([of_text[n] for n in unknown.tolist()]).items():
                    out["row"].append(row)
                    out["token"].append(word)
                    out["n"].append(times)
                heads["row"].append(row)
                heads["size"].append(len(of_text))
                heads["known"].append(len(of_text) - len(unknown))
                heads["base"].append(float(found_base[found].sum()))
                row += 1
            empty = [None] * len(out["row"])
            yield {
                "row": out["row"] + heads["row"],
                "doc_id": empty + rows["doc_id"],
                "held_out": empty + rows["held_out"],
                "size": empty + heads["size"],
                "token": out["token"] + [None] * len(texts),
                "n": out["n"] + [1] * len(texts),
                "known": empty + heads["known"],
                "base": empty + heads["base"],
                "lm": empty + (-bits / LOG2_10).tolist(),
                "bytes": empty + [len(text) + 1 for text in texts],
            }

    parts = written(
        arrow_map(
            docs,
            score,
            "row long, doc_id long, held_out boolean, size long, token binary, n long, known long, "
            "base double, lm double, bytes long",
        ),
        "text-tokens",
    )
    rare = parts.where("token is not null").select("row", "token", "n").join(tokens, "token", "left")
    rare = rare.select(
        "row",
        F.lit(None).cast("long").alias("doc_id"),
        F.lit(None).cast("boolean").alias("held_out"),
        F.lit(None).cast("long").alias("size"),
        F.when(F.col("trained") > 0, F.col("n")).otherwise(0).alias("known"),
        (F.col("n") * base(F.coalesce("trained", F.lit(0)))).alias("base"),
        F.lit(None).cast("double").alias("lm"),
        F.lit(None).cast("long").alias("bytes"),
    )
    heads = parts.where("size is not null").drop("token", "n")
    sums = heads.unionByName(rare).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("size").alias("n_tokens"),
        F.sum("known").alias("n_known"),
        F.sum("base").alias("base_score"),
        F.sum("lm").alias("score"),
        F.max("bytes").alias("bytes"),
    )
    return sums.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        (-F.col("score") * LOG2_10 / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )
