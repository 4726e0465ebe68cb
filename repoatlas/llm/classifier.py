"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

The score of a text is a sparse dot product. Tokens are runs of word characters or of other
marks; the n-grams are single tokens and pairs, and one feature counts tokens that repeat the
one before. A feature's value is its count over the root of the number of tokens.
"""

import math
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoatlas.llm.common import arrow_map, fold_of, written

BITS = 18
# Labelled rows that the model is fitted on at most, by hash of their id, and passes over them.
FIT_ROWS = 6_000
PASSES = 3
# Of the fitting: step size, smoothing, and the penalties.
ALPHA, BETA, L1, L2 = 0.1, 1.0, 0.5, 1.0
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.5
MEMO_ENTRIES = 100_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_memo: dict[str, int] = {}
_MIX = np.uint64(0x9E3779B97F4A7C15)
_REPEAT, _BIAS = 0, 1


def _token_hashes(text: str | None) -> np.ndarray:
    tokens = _TOKEN.findall(text or "")
    found = list(map(_memo.get, tokens))
    if None in found:
        if len(_memo) > MEMO_ENTRIES:
            _memo.clear()
        for n, value in enumerate(found):
            if value is None:
                raw = tokens[n].encode("utf-8", "surrogatepass")
                found[n] = _memo[tokens[n]] = zlib.crc32(raw)
    return np.array(found, np.uint64)


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Feature numbers, repeats included, and the value that each occurrence adds."""
    hashes = _token_hashes(text)
    if not len(hashes):
        return np.zeros(0, np.int64), 0.0
    shift = np.uint64(64 - bits)
    single = (hashes * _MIX) >> shift
    pair = ((hashes[:-1] * np.uint64(0x100000001B3) + hashes[1:]) * _MIX) >> shift
    repeats = np.zeros(int((hashes[1:] == hashes[:-1]).sum()), np.uint64)
    numbers = np.concatenate([single, pair, repeats]).astype(np.int64)
    numbers[numbers == _BIAS] = _REPEAT + 2
    return numbers, 1 / math.sqrt(len(hashes))


class Ftrl:
    """Per-coordinate FTRL-proximal updates; weights follow from the sums z and n."""

    def __init__(self, bits: int = BITS):
        self.z = np.zeros(1 << bits)
        self.n = np.zeros(1 << bits)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def update(self, numbers, value, label):
        at, counts = np.unique(numbers, return_counts=True)
        at, x = np.append(at, _BIAS), np.append(counts * value, 1.0)
        w = self.weights(at)
        error = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w @ x))))) - label
        g = error * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def labelled_rows(docs: DataFrame, clean: DataFrame) -> DataFrame:
    """One row for each id of ``clean(doc_id, order, label)`` with documents: of its texts the one
    with the smallest hash, chosen in each task before the shuffle."""
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first")
    return (
        docs.select("doc_id", "text")
        .join(F.broadcast(clean), "doc_id")
        .groupBy("doc_id", "order", "label")
        .agg(first)
        .select("doc_id", "order", "label", "first.text")
    )


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> np.ndarray:
    """Weights from a sample of at most about ``rows`` labelled documents of the other folds.

    A document's label is the rounded mean of its labels (a tie counts as 1). Rows without
    id, label or document are left out. With no usable label all weights are zero and all
    scores 0.5. One task makes the passes, over the sample in order of a hash of the id.
    """
    clean = (
        labels.where("doc_id is not null and quality is not null")
        .where(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
        .withColumn("order", F.xxhash64(F.col("doc_id"), F.lit(1)))
    )
    clean = written(clean, "labels")
    total = clean.count()
    if total > rows:
        # Hashes are even over the signed 64 bits: the share below this bound is rows / total.
        bound = int((rows / total) * 2**64) - 2**63
        clean = clean.where(F.col("order") < F.lit(bound))
    sample = labelled_rows(docs, clean)

    def extract(batches):
        for batch in batches:
            made = [features(t) for t in batch["text"]]
            yield {
                "doc_id": batch["doc_id"],
                "order": batch["order"],
                "label": batch["label"],
                "value": [v for _, v in made],
                "numbers": [n.astype("<u4").tobytes() for n, _ in made],
            }

    extracted = arrow_map(
        sample, extract, "doc_id long, order long, label double, value double, numbers binary"
    )

    def train(batches):
        model, kept = Ftrl(), []
        for batch in batches:
            for label, value, raw in zip(batch["label"], batch["value"], batch["numbers"]):
                kept.append((np.frombuffer(raw, "<u4").astype(np.int32), value, label))
        for _ in range(PASSES):
            for example in kept:
                model.update(*example)
        yield {"weights": [model.weights().astype("<f8").tobytes()]}

    ordered = extracted.repartition(1).sortWithinPartitions("order", "doc_id", "numbers")
    found = [bytes(r.weights) for r in arrow_map(ordered, train, "weights binary").collect()]
    return np.frombuffer(found[0], "<f8") if found else np.zeros(1 << BITS)


def score_of(text: str | None, weights: np.ndarray) -> float:
    numbers, value = features(text)
    total = float(weights[numbers].sum()) * value + float(weights[_BIAS])
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, total))))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with ``_score``, from 0 to 1: how likely the label is 1.

    Only the text is scored. Null and empty texts get what the bias says. Null doc_ids and
    repeated rows are scored row by row; all columns pass through.
    """
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        return pd.Series([score_of(t, weights.value) for t in text], dtype="float64")

    return docs.withColumn("_score", score("text"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return scored(docs.select("doc_id", "text"), labels).select(
        "doc_id",
        (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Whole rows of the documents that are predicted to be good."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text", "doc_id")
    return scored(rows, labels).where(F.col("_score") >= THRESHOLD).select("row.*")
