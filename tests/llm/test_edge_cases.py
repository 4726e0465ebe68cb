"""Every operator on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from repoatlas.llm import (
    classifier,
    exact_search,
    language_model,
    mixing,
    packing,
    quality_rules,
    simhash,
    token_files,
    unigram_counts,
    warc,
)

import edge

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def labels(spark, rows=((1, 1), (2, 1), (10, 0), (11, 0), (None, 1), (12, None), (7, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int")


def _mix(docs):
    return mixing.mix_plan(
        docs, mixing.Mix(), mixing.n_words(F.col("text")), mixing.quality_weight(F.col("text"))
    )


DOCUMENT_OPERATORS = {
    "mixing": _mix,
    "packing": lambda d: packing.pack(d, WORD, True, 2),
    "rules": lambda d: quality_rules.judged(d).select("doc_id", "_rules.*"),
    "classifier": lambda d: classifier.quality_scores(d, labels(d.sparkSession)),
    "simhash": simhash.near_duplicates,
    "tokens": lambda d: token_files.read_token_files(
        token_files.write_token_files(d, BYTE, False, 0)
    ),
    "unigram": lambda d: unigram_counts.token_counts(d, PIECES),
    "language": language_model.language_scores,
}


@pytest.mark.parametrize("name", DOCUMENT_OPERATORS)
def test_rows_and_clashing_names(spark, name):
    run = DOCUMENT_OPERATORS[name]
    found = run(edge.documents(spark))
    if name == "packing":
        found = found.groupBy("doc_id").agg(F.count_if(F.col("start") == 0).alias("n"))
        assert sum(r.n for r in found.collect()) == len(edge.rows())
    else:
        assert found.count() == len(edge.rows())
    assert run(edge.clashing(spark)).count() >= len(edge.rows())
    assert run(edge.empty(spark)).count() == 0


def test_operators_that_keep_all_columns(spark):
    docs = edge.clashing(spark).withColumn("_rules", F.lit("mine"))
    given = docs.drop("text", "n_chars").distinct().collect()
    keep = [
        quality_rules.clean_documents(docs),
        classifier.keep_good(docs, labels(spark)),
        simhash.keep_one(docs),
        mixing.mix_documents(
            docs, mixing.Mix(), mixing.n_words(F.col("text")), mixing.quality_weight(F.col("text"))
        ),
    ]
    for frame in keep:
        assert frame.columns == docs.columns
        rows = frame.drop("text", "n_chars").distinct().collect()
        assert rows and set(rows) <= set(given)


def test_no_labels(spark):
    docs = edge.documents(spark)
    scores = classifier.quality_scores(docs, labels(spark, ())).select("score").distinct()
    assert [r.score for r in scores.collect()] == [0.5]


def test_search_and_archives_bear_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, v int, tile int"
    nan, inf = float("nan"), float("inf")
    vectors = spark.createDataFrame(
        [
            (0, [1.0, 2.0], 1, 1, 1),
            (0, [1.0, 2.0], 1, 1, 1),
            (1, [nan, 1.0], 1, 1, 1),
            (2, [inf, 1.0], 1, 1, 1),
            (3, [None, 1.0], 1, 1, 1),
            (4, None, 1, 1, 1),
            (None, [1.0, 1.0], 1, 1, 1),
            (5, [1.0], 1, 1, 1),
            (6, [3e30, 1.0], 1, 1, 1),
            (7, [0.5, 0.5], None, None, None),
            (8, [0.5, 0.5], None, None, None),
            (50, [], 1, 1, 1),
        ],
        schema,
    )
    found = edge.plain(exact_search.exact_top_k(vectors))
    top = [tuple(r) for r in found if r[0] == 0]
    assert [r[2] for r in sorted(top, key=lambda r: r[1])] == [6, 7, 8]
    assert top[0][3] == (1 << 63) - 1
    assert exact_search.exact_top_k(spark.createDataFrame([], schema)).count() == 0

    page_schema = "page_id long, url string, html string, chunk string"
    long = "<p>é</p>" * 400_000
    pages = spark.createDataFrame(
        [
            (3, "http://a/\r\nX: y", long, None),
            (1, None, long, None),
            (1, None, long, None),
            (None, "u", long, None),
            (4, "u", None, None),
            (5, "u", "", None),
            (6, "u", "tiny", None),
            (7, "u", "tiny", None),
        ],
        page_schema,
    )
    archives = warc.write_archives(warc.chunk_table(warc.record_table(pages)))
    rows = warc.read_archives(archives, with_chunks=False).collect()
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in rows)
    response = "response"
    assert kinds == [
        (0, "revisit", 1),
        (1, response, None),
        (1, response, None),
        (3, "revisit", 1),
        (4, response, None),
        (5, response, None),
        (6, response, None),
        (7, response, None),
    ]
    assert {r.payload_bytes for r in rows if r.page_id in (1, 3)} == {len(long.encode())}
    none = spark.createDataFrame([], page_schema)
    archives = warc.write_archives(warc.chunk_table(warc.record_table(none)))
    assert warc.read_archives(archives).count() == 0


def test_pipeline_on_an_empty_table(spark):
    docs = edge.empty(spark)
    sf_dir = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 0


def test_keep_one_loses_no_text_to_null_or_repeated_ids(spark):
    words = {name: " ".join(f"{name}{n}" for n in range(80)) for name in "abcd"}
    rows = [
        (None, words["a"]), (None, words["b"]), (None, words["b"]),
        (1, words["c"]), (1, words["d"]), (0, words["d"]), (None, words["d"]),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted((r.text, r.doc_id) for r in simhash.keep_one(docs).collect())
    assert kept == [(words["a"], None), (words["b"], None), (words["c"], 1), (words["d"], 0)]


def test_repeats_of_a_labelled_row_do_not_reach_the_training_task(spark):
    rows = [(i, f"text {k} of {i} " * (k % 7 + 1)) for i in range(20) for k in range(500 if i == 3 else 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    given = labels(spark, [(i, i % 2) for i in range(20)])
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first")
    least = docs.groupBy("doc_id").agg(first).select("doc_id", "first.text")
    assert (classifier.fit(docs, given) == classifier.fit(least, given)).all()
    clean = given.withColumn("order", F.lit(1)).withColumnRenamed("quality", "label")
    assert classifier.labelled_rows(docs, clean).count() == 20
