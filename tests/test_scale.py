"""What is read and worked out, as far as plans and written tables show it."""

from pathlib import Path

from pyspark.sql import functions as F

from repoatlas.operators import includes, symbols
from repoatlas.operators.extractors import CPP, Registry
from repoatlas.sources import corpora, workspace

SF_DIR = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _files(spark):
    rows = [
        ("r", "a.cpp", b'#include <vector>\n#include "b.h"  \n#include MACRO  \nint f() { return 1; }\n'),
        ("r", "b.h", b"int g();\r\n"),
        ("r", "c.h", b'\x01\x02#include "\xc3\xa9\xee\x80\xa1.h"\r\n'),
        ("r", "d.h", None),
    ]
    return spark.createDataFrame(rows, "repo string, path string, content binary")


def test_paths_of_rendered_files_need_no_content(spark):
    files = corpora.star_corpus(spark, SF_DIR)
    assert "include" not in _plan(files.select("repo", "path")).replace("include/nation", "")
    # Neither are contents stored: the written tables hold keys and lists.
    app = spark.sparkContext.applicationId
    tables = [spark.read.parquet(p) for k, p in workspace._TABLES.items() if k[0] == app and "star" in k[1]]
    assert tables and not any("content" in t.columns for t in tables)
    assert files.where(F.octet_length("content") != F.col("size")).isEmpty()


def test_values_that_are_null_leave_no_text(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'x'), (null, 'y'), (3, null) AS t(a, b)")
    texts = df.select(
        corpora._fill("@a of @b, @a", a=F.col("a"), b=F.col("b")), corpora._fill("@b", a=F.col("a"), b=F.col("b"))
    ).collect()
    assert [tuple(r) for r in texts] == [("1 of x, 1", "x"), (None, None), (None, None)]


def test_includes_are_read_off_a_content_once(spark):
    files = _files(spark)
    summary = includes.include_summary(files)
    listed = Registry(CPP).imports(files)
    for df in (summary, listed):
        assert _plan(df).count("regexp_extract_all") == 1
    assert [tuple(r) for r in summary.orderBy("path").collect()] == [
        ("r", "a.cpp", 1, "vector", 2, "b.h, MACRO"),
        ("r", "c.h", 0, "", 1, "é!.h"),
    ]
    assert listed.count() == 4


def test_headers_of_functions_are_read_once(spark):
    files = _files(spark)
    plan = _plan(symbols.file_segments(files))
    # The pattern of words in front of a result type.
    assert plan.count("thread_local") == 1
    rows = symbols.functions_of(symbols.scopes(files)).collect()
    assert [(r.path, r.name, r.signature, r.line_start) for r in rows] == [("a.cpp", "f", "int f()", 4)]
