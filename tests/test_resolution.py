"""Includes resolved through their distinct pairs of candidates."""

from repoatlas.operators import graph


def test_includes_are_moved_once_and_keep_their_rows(spark):
    imports = spark.createDataFrame(
        [
            ("r", "a/x.cpp", 0, "b/y.h"), ("r", "a/z.cpp", 0, "b/y.h"), ("r", "a/z.cpp", 0, "b/y.h"),
            ("r", "a/x.cpp", 1, "w.h"), ("r", "x.cpp", 0, "../out.h"), ("r", "a/x.cpp", 2, "/abs.h"),
            ("r", "a/x.cpp", 3, None), (None, "a/x.cpp", 0, "b/y.h"), ("r", None, 0, "b/y.h"),
        ],
        "repo string, path string, ordinal int, name string",
    )
    known = spark.createDataFrame(
        [("r", "b/y.h", "b"), ("r", "a/b/y.h", "a/b"), ("r", "a/w.h", "a"), ("r", "a/w.h", "again")],
        "repo string, path string, module string",
    )
    resolved = graph.resolve_imports(imports, known)
    rows = resolved.select("repo", "path", "name", "exact_module", "relative_module", "target_module")
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(
        [
            ("r", "a/x.cpp", "b/y.h", "b", "a/b", "b"), ("r", "a/z.cpp", "b/y.h", "b", "a/b", "b"),
            ("r", "a/z.cpp", "b/y.h", "b", "a/b", "b"), ("r", "a/x.cpp", "w.h", None, "a", "a"),
            ("r", "a/x.cpp", "w.h", None, "again", "again"), ("r", "x.cpp", "../out.h", None, None, None),
            ("r", "a/x.cpp", "/abs.h", None, None, None), ("r", "a/x.cpp", None, None, None, None),
            (None, "a/x.cpp", "b/y.h", None, None, None), ("r", None, "b/y.h", "b", "b", "b"),
        ],
        key=str,
    )
    # The rows of includes are joined once: what they are joined with is made of distinct pairs.
    lines = resolved._jdf.queryExecution().optimizedPlan().toString().splitlines()
    top = next(i for i, line in enumerate(lines) if "Join" in line)
    assert "Relation" in lines[top + 1] or "Relation" in lines[top + 2]
