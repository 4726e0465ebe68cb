"""Prompts as texts and as digests of their lines."""

from pyspark.sql import functions as F

from repoatlas.operators import documents, modules
from repoatlas.operators.structures import file_structures
from repoatlas.plans import queries, update


def _files(spark):
    rows = [("r", f"src/a/f{i}.cpp", f"int f{i}() {{ return {i}; }}\n".encode()) for i in range(30)]
    rows += [("r", "src/b/é.h", "class É { public: int g() { } };\n".encode()), ("r", "src/b/none.h", None)]
    rows += [("r", "src/b/notes.txt", b"text"), ("q", "src/c/only.txt", b"text"), (None, "x.h", b"int h() { }")]
    rows += [("r", "src/b/twice.h", b"int t() { }")] * 2 + [("r", "root/y.h", b""), ("r", "y.h", b"struct Y { };")]
    return spark.createDataFrame(rows, "repo string, path string, content binary")


def test_digests_are_those_of_the_texts(spark):
    files = _files(spark)
    run = modules.assign_modules(files.select("repo", "path"), depth=2)
    found = file_structures(files.where("path like '%.cpp' or path like '%.h'"))
    # Small parts: a text is put together from many.
    texts = documents.module_prompts(run, found, budget=200)
    hashes = documents.prompt_hashes(run, found)
    assert "prompt" not in hashes.columns and set(hashes.columns) == set(texts.columns) - {"prompt"}
    assert sorted(map(str, hashes.collect())) == sorted(map(str, texts.select(*hashes.columns).collect()))
    assert hashes.count() == 5


def test_documents_hold_no_prompt_in_one_piece(spark, monkeypatch):
    def refuse(*args):
        raise AssertionError("the texts of prompts were put together")

    monkeypatch.setattr(documents, "module_prompts", refuse)
    assert queries.module_docs(spark, "/root/testdata/sf0.001").count() > 0


def test_modules_of_includes_are_named_once_a_file(spark):
    files = spark.createDataFrame(
        [("r", "src/a/x.cpp", b'#include <v>\n#include "b.h"\n'), ("r", "src/b.h", b"")],
        "repo string, path string, content binary",
    )
    saved = spark.createDataFrame([], "repo string, path string, file_hash string, module string")
    run = update.prepare_once(files, saved, queries.STAR_FULL)
    rows = update.run_imports(run, queries.STAR_FULL)
    assert [tuple(r) for r in rows.select("path", "ordinal", "name", "is_system", "module").orderBy("ordinal").collect()] == [
        ("src/a/x.cpp", 0, "v", True, "src/a"), ("src/a/x.cpp", 1, "b.h", False, "src/a"),
    ]
    plan = rows.select("module", "name")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("split(path")
