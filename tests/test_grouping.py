import hashlib

from pyspark.sql import functions as F

from repoatlas.operators import documents, modules
from repoatlas.operators.grouping import ordered_text, with_place


def _run_files(spark, n=600):
    """One module holds most rows, a third of all files are copies of one content."""
    rows = []
    for i in range(n):
        module = "hot" if i % 4 else f"cold{i % 7}"
        content = "same" if i % 3 == 0 else f"c{i}"
        digest = "sha256:" + hashlib.sha256(content.encode()).hexdigest()
        rows.append(("r", f"{module}/f{i:05d}.h", digest, module, module))
    schema = "repo string, path string, file_hash string, module string, module_path string"
    return spark.createDataFrame(rows, schema), rows


def test_parts_join_to_the_whole(spark):
    df, rows = _run_files(spark)
    args = (df, ["repo", "module"], ["path"], F.col("path"), "\n")
    want = {}
    for _, path, _, module, _ in sorted(rows):
        want.setdefault(module, []).append(path)
    cold = {}
    for budget in (100, 1_500, 1 << 20):
        parts = ordered_text(*args, budget=budget).orderBy("module", "part").collect()
        joined = {}
        for r in parts:
            joined[r.module] = joined.get(r.module, "") + r.text
        assert joined == {m: "\n".join(p) for m, p in want.items()}
        # A part goes over the budget by less than one value.
        assert all(len(r.text) <= budget + 20 for r in parts)
        cold[budget] = sorted((r.module, r.part, r.text) for r in parts if r.module != "hot")
    assert sum(r.module == "hot" for r in parts) == 1
    # One hot group leaves the others as they were.
    assert cold[1_500] == cold[1 << 20] and {part for _, part, _ in cold[1_500]} == {0}


def test_running_sums_spread_one_group(spark):
    df, _ = _run_files(spark)
    placed = with_place(df.select("repo", "path"), ["repo"], ["path"], F.length("path"))
    rows = placed.orderBy("path").collect()
    total = 0
    for r in rows:
        assert r.before == total
        total += len(r.path)


def test_combined_hash_of_large_modules(spark):
    df, rows = _run_files(spark)
    want = {}
    for _, _, digest, module, _ in rows:
        want.setdefault(module, []).append(digest)
    want = {m: hashlib.sha256("".join(sorted(h)).encode()).hexdigest() for m, h in want.items()}
    unread = spark.createDataFrame([("r", "hot/x.h", None, "hot", "hot")], df.schema)
    for budget in (1, 71 * 100, 1 << 20):
        for table in (df, df.unionByName(unread)):
            got = modules.combined_hashes(table, budget).collect()
            assert {r.module: r.combined_hash for r in got} == want


def test_module_groups_in_parts(spark):
    df, rows = _run_files(spark)
    got = modules.module_groups(df, budget=5_000).orderBy("part").collect()
    files = [f.path for r in got if r.module == "hot" for f in r.files]
    assert files == sorted(p for _, p, _, m, _ in rows if m == "hot")


def test_long_documents(spark):
    """Documents and overviews in parts are the same text as in one piece."""
    df, _ = _run_files(spark, 60)
    structures = spark.createDataFrame(
        [],
        "repo string, path string, language string, "
        "imports array<struct<name:string,is_system:boolean>>, "
        "classes array<struct<kind:string,class_id:bigint,name:string,line_start:int,line_end:int,"
        "methods:array<struct<position:bigint,name:string,signature:string,line_start:int,line_end:int,visibility:string>>>>, "
        "functions array<struct<position:bigint,name:string,signature:string,line_start:int,line_end:int,visibility:string>>",
    )
    edges = spark.createDataFrame(
        [("r", "hot", f"cold{i}") for i in range(7)] + [("r", "cold1", "hot")],
        "repo string, src_module string, dst_module string",
    )
    none = spark.createDataFrame([], "repo string, prompt_hash string, text string")
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp")
    combined = modules.combined_hashes(df)

    def docs(budget):
        related = documents.related_sections(edges, df.select("repo", "module"), budget)
        prompts = documents.module_prompts(df, structures, budget)
        assert prompts.groupBy("repo", "module").count().where("count > 1").isEmpty()
        return documents.module_docs(prompts, none, combined, related, ts)

    def texts(frame, key):
        out = {}
        for r in frame.orderBy(key, "part").collect():
            out[r[key]] = out.get(r[key], "") + r.content
        return out

    for budget in (1, 150):
        assert texts(docs(budget), "module") == texts(docs(1 << 20), "module")
    whole = documents.overviews(docs(1 << 20), ts)
    assert texts(documents.overviews(docs(150), ts, 100), "repo") == texts(whole, "repo")


def test_shared_document_names(spark):
    docs = spark.createDataFrame(
        [("r", "a/b", "a_b.md", 0, "first"), ("r", "a_b", "a_b.md", 0, "second")],
        "repo string, module string, doc_file string, part int, content string",
    )
    assert documents.doc_name_clashes(docs).first().n_modules == 2
    assert [r.content for r in documents.visible_docs(docs).collect()] == ["second"]
