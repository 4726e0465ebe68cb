"""One query per operator over the whole given tables, with production parameters."""

import public_tokenizers
from pyspark.sql import functions as F

from repoatlas.llm import (
    classifier,
    exact_search,
    language_model,
    mixing,
    packing,
    quality_rules,
    sharding,
    simhash,
    sql,
    token_files,
    unigram_counts,
    vector_codes,
    warc,
    whitening,
)

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix_sources(spark, sf_dir):
    text = F.col("text")
    plan = mixing.mix_plan(
        documents(spark, sf_dir), mixing.Mix(), mixing.n_words(text), mixing.quality_weight(text)
    )
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op2_pack_sequences(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), WORD_BPE, True, 2, with_ids=False)


def op3_warc_round_trip(spark, sf_dir):
    records = warc.record_table(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    archives = warc.write_archives(warc.chunk_table(records))
    return warc.read_archives(archives, with_chunks=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op4_exact_top_k(spark, sf_dir):
    return exact_search.exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_token_counts(spark, sf_dir):
    return unigram_counts.token_counts(documents(spark, sf_dir), PIECES)


def op6_quality_rules(spark, sf_dir):
    judged = quality_rules.judged(documents(spark, sf_dir))
    return judged.select("doc_id", "_rules.*").drop("clean_text")


def op7_token_files(spark, sf_dir):
    files = token_files.write_token_files(documents(spark, sf_dir), BYTE_BPE, False, 0)
    return token_files.read_token_files(files)


def op8_quality_classifier(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classifier.quality_scores(documents(spark, sf_dir), labels)


def op9_simhash_components(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir))


def op10_language_scores(spark, sf_dir):
    return language_model.language_scores(documents(spark, sf_dir))


def op11_whitened_embeddings(spark, sf_dir):
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_shuffled_shards(spark, sf_dir):
    return sharding.shard_places(documents(spark, sf_dir))


def op13_vector_codes(spark, sf_dir):
    return vector_codes.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_pack_sequences,
        op3_warc_round_trip,
        op4_exact_top_k,
        op5_token_counts,
        op6_quality_rules,
        op7_token_files,
        op8_quality_classifier,
        op9_simhash_components,
        op10_language_scores,
        op11_whitened_embeddings,
        op12_shuffled_shards,
        op13_vector_codes,
    )
}

SQL = {"op1_mix_sources": sql.OP1, "op6_quality_rules": sql.OP6}
