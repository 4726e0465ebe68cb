import pathlib

import pytest
from pyspark.sql import functions as F

from repoatlas.functions import globs, paths

PATHS = [
    "a.h", "src/a.h", "srcx/a.h", "src/test/a.cpp", "test/a.cpp", "src/x/third_party/b.h",
    "src/[x]/a.h", "src/a+b.h", "src/a.h\n", "include/deep/er/n_1.hpp", "src/A.H", "x.y/z", "",
    "src/p1/q/x_1.cpp", ".hidden", "dir/.hidden", "a.tar.gz", "dir/a.", "src/ab/c.h", "a[]b", "a", "[!]",
]
# What each pattern matches, in order.
MATCHES = {
    "src/**/*.h": ["src/a.h", "srcx/a.h", "src/x/third_party/b.h", "src/[x]/a.h", "src/a+b.h", "src/ab/c.h"],
    "**/test/**": ["src/test/a.cpp"],
    "**/third_party/**": ["src/x/third_party/b.h"],
    "src/**": [
        "src/a.h", "srcx/a.h", "src/test/a.cpp", "src/x/third_party/b.h", "src/[x]/a.h", "src/a+b.h", "src/a.h\n", "src/A.H", "src/p1/q/x_1.cpp", "src/ab/c.h",
    ],
    "**": PATHS,
    "*.h": ["a.h", "src/a.h", "srcx/a.h", "src/x/third_party/b.h", "src/[x]/a.h", "src/a+b.h", "src/ab/c.h"],
    "src/*.h": ["src/a.h", "src/x/third_party/b.h", "src/[x]/a.h", "src/a+b.h", "src/ab/c.h"],
    "s?c/*.h": ["src/a.h", "src/x/third_party/b.h", "src/[x]/a.h", "src/a+b.h", "src/ab/c.h"],
    "src/[ab].h": ["src/a.h"],
    "src/[!a]*": ["src/test/a.cpp", "src/x/third_party/b.h", "src/[x]/a.h", "src/A.H", "src/p1/q/x_1.cpp"],
    "src/[[]x]/*": ["src/[x]/a.h"],
    "**/p1/**/*_1.cpp": ["src/p1/q/x_1.cpp"],
    "src/a+b.h": ["src/a+b.h"],
    "a*": ["a.h", "a.tar.gz", "a[]b", "a"],
    "*": PATHS,
    "?.h": ["a.h"],
    "[z-a]*": [],
    "src/[": [],
    "include/**/n_[0-9].hpp": ["include/deep/er/n_1.hpp"],
    "*a*b*": ["src/x/third_party/b.h", "src/a+b.h", "src/ab/c.h", "a[]b"],
    "src/a*h": ["src/a.h", "src/a+b.h", "src/ab/c.h"],
    "**.h": ["a.h", "src/a.h", "srcx/a.h", "src/x/third_party/b.h", "src/[x]/a.h", "src/a+b.h", "src/ab/c.h"],
    "src/**/a?h": ["src/a.h", "srcx/a.h", "src/[x]/a.h"],
    "a[]b": ["a[]b"],
    "[!]": ["[!]"],
    "[]": [],
    "[]a]": ["a"],
    "[!]a]*": [
        "src/a.h", "srcx/a.h", "src/test/a.cpp", "test/a.cpp", "src/x/third_party/b.h", "src/[x]/a.h", "src/a+b.h", "src/a.h\n", "include/deep/er/n_1.hpp", "src/A.H", "x.y/z", "src/p1/q/x_1.cpp", ".hidden", "dir/.hidden", "dir/a.", "src/ab/c.h", "[!]",
    ],
}
PATTERNS = list(MATCHES)


def test_globs_in_code(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    literal = df.select(
        "path",
        *[globs.glob_match(F.col("path"), p).alias(f"c{i}") for i, p in enumerate(PATTERNS)],
    ).collect()
    for row in literal:
        for i, pattern in enumerate(PATTERNS):
            assert row[f"c{i}"] == (row.path in MATCHES[pattern]), (row.path, pattern)


def test_globs_from_a_table_agree(spark):
    cases = spark.createDataFrame(
        [(a, b) for a in PATHS for b in PATTERNS], "path string, pattern string"
    )
    rows = cases.select(
        "path",
        "pattern",
        globs.rule_hits(F.col("path"), globs.compiled_rule(F.col("pattern"))).alias("hit"),
    ).collect()
    for row in rows:
        assert row.hit == (row.path in MATCHES[row.pattern]), (row.path, row.pattern)


def test_exclude_beats_include(spark):
    df = spark.createDataFrame([("src/test/a.h",), ("src/a.h",), ("a.txt",)], "path string")
    kept = df.where(globs.selected(F.col("path"), ("src/**/*.h",), ("**/test/**",)))
    assert [r.path for r in kept.collect()] == ["src/a.h"]


def test_default_exclude_keeps_a_top_level_folder(spark):
    df = spark.createDataFrame([("test/a.cpp",), ("src/test/a.cpp",)], "path string")
    kept = df.where(~globs.any_glob(F.col("path"), ("**/test/**",))).collect()
    assert [r.path for r in kept] == ["test/a.cpp"]


@pytest.mark.parametrize(
    "path,strategy,depth,module,module_path",
    [
        ("a.c", "directory", 2, "root", "."),
        ("src/a.c", "directory", 2, "src", "src"),
        ("src/p/a.c", "directory", 2, "src/p", "src/p"),
        ("src/p/q/a.c", "directory", 2, "src/p", "src/p"),
        ("src/p/q/a.c", "directory", 1, "src", "src"),
        ("src/p/a.b.c", "file", 2, "src/p/a.b", "src/p"),
        (".hidden", "file", 2, ".hidden", "."),
        ("src/p/q/a.c", "custom", 2, "src/p/q", "src/p/q"),
        ("a.c", "custom", 2, "root", "."),
    ],
)
def test_modules(spark, path, strategy, depth, module, module_path):
    row = (
        spark.createDataFrame([(path,)], "path string")
        .select(
            paths.module_name(F.col("path"), strategy, depth).alias("m"),
            paths.module_path(F.col("path"), strategy, depth).alias("p"),
        )
        .first()
    )
    assert (row.m, row.p) == (module, module_path)


def test_suffixes_like_pathlib(spark):
    names = [p for p in PATHS if p and "\n" not in p]
    df = spark.createDataFrame([(p,) for p in names], "path string")
    for row in df.select(
        "path",
        paths.suffix(F.col("path")).alias("s"),
        paths.without_suffix(F.col("path")).alias("w"),
        paths.base_name(F.col("path")).alias("b"),
    ).collect():
        pure = pathlib.PurePosixPath(row.path)
        if not row.path.endswith("."):
            assert (row.s, row.w) == (pure.suffix, str(pure.with_suffix("")))
        assert row.b == pure.name


@pytest.mark.parametrize(
    "importing,name,normalized",
    [
        ("src/a/x.cpp", "y.h", "src/a/y.h"),
        ("src/a/x.cpp", "../b/y.h", "src/b/y.h"),
        ("src/a/x.cpp", "./../a/./y.h", "src/a/y.h"),
        ("src/a/x.cpp", "../../y.h", "y.h"),
        ("src/a/x.cpp", "../../../y.h", None),
        ("src/a/x.cpp", "../../../src/y.h", None),
        ("x.cpp", "y.h", "y.h"),
        ("x.cpp", "../y.h", None),
        ("x.cpp", "/abs/y.h", None),
        ("src/x.cpp", "b//y.h", "src/b/y.h"),
        ("src/x.cpp", "b/..y.h", "src/b/..y.h"),
    ],
)
def test_normalize_import(spark, importing, name, normalized):
    df = spark.createDataFrame([(importing, name)], "p string, n string")
    got = df.select(paths.normalize_import(F.col("p"), F.col("n"))).first()[0]
    assert got == normalized


def test_document_names(spark):
    df = spark.createDataFrame([("a/b_c\\d",)], "m string")
    row = df.select(
        paths.doc_file_name(F.col("m")).alias("f"),
        paths.doc_display_name(paths.doc_file_name(F.col("m"))).alias("d"),
        paths.relative_path(F.lit("/r/x/y.c"), "/r").alias("r"),
        paths.relative_path(F.lit("/rr/y.c"), "/r").alias("n"),
    ).first()
    assert tuple(row) == ("a_b_c_d.md", "a/b/c/d", "x/y.c", None)
