"""Includes read off the top of a text, and how stored rows are spread over a scan's tasks."""

from pyspark.sql import functions as F

from repoatlas.functions import cpp_text, paths
from repoatlas.sources.workspace import stored

# Text -> names, with what a cut behind the last "include" could get wrong.
TEXTS = {
    '#include <a.h>\n#include "b/c.h" // x\nint f() { return 0; }\n': ["a.h", "b/c.h"],
    'x\r\n  # include <a.h>\r\nchar* s = "\\" // no";': ["a.h"],
    '#include <a//b.h>\n#include "a//b.h"\n': ["a//b.h"],
    '/* #include <no.h>\n*/\n#include <a.h>\n': ["a.h"],
    '#include /* include\n*/ <a.h>\n': ["a.h"],
    'auto s = R"(\n#include <no.h>\n)";\n': [],
    'auto s = "\\\n#include <no.h>\\\n";\n#include <a.h>': ["a.h"],
    "// include\n#include NAMED \n#includes <no.h>\nint n = 1'0; // include": ["NAMED"],
    "no word": [],
}


def test_includes_by_line_are_those_of_the_whole_text(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    names = F.transform(cpp_text.include_names(cpp_text.include_texts(F.col("t"))), lambda i: i["name"])
    assert {r.t: r.n for r in rows.select("t", names.alias("n")).collect()} == TEXTS


def test_steps_up_at_the_start_of_a_name(spark):
    cases = {
        ("a/b/x.cpp", "../c.h"): "a/c.h",
        ("a/b/x.cpp", "../../c.h"): "c.h",
        ("a/b/x.cpp", "../../../c.h"): None,
        ("a/./b/x.cpp", "../c.h"): "a/c.h",
        ("x.cpp", "../c.h"): None,
        ("a/x.cpp", "../b/../c.h"): "c.h",
        ("a/x.cpp", "../"): "",
        ("a/x.cpp", None): "a",
    }
    rows = spark.createDataFrame(list(cases), "p string, n string")
    found = rows.select("p", "n", paths.normalize_import(F.col("p"), F.col("n")).alias("to")).collect()
    assert {(r.p, r.n): r.to for r in found} == cases


def test_rows_of_one_task_are_read_by_many(spark):
    rows = stored(
        spark, ("one task", "test"), lambda: spark.range(0, 80_000, 1, 1).toDF("n"), shuffled=False
    )
    most = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count").alias("n")).first().n
    assert rows.count() == 80_000 and most <= 20_000
