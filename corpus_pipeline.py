"""From raw documents to packed sequences: five stages, each over all that the one before kept."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoatlas.llm import classifier, mixing, packing, quality_rules, simhash
from repoatlas.llm.common import written

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the rules go, and documents that fail or lose too much."""
    return quality_rules.clean_documents(docs)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds poor go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classifier.keep_good(docs, labels)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group that the fingerprints of op9 link."""
    return simhash.keep_one(docs, simhash.SHINGLE, simhash.RADIUS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's rows as often as its target asks."""
    text = F.col("text")
    return mixing.mix_documents(
        docs, mixing.Mix(), mixing.n_words(text), mixing.quality_weight(text)
    )


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids, by sequence."""
    return packing.pack(docs, TOKENIZER, True, END_ID)


STAGES = [
    ("quality rules", quality_stage),
    ("quality classifier", classifier_stage),
    ("near duplicates", dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# Fitted weights and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
