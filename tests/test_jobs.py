import json
import os

import pandas as pd
import pytest
from pyarrow.fs import LocalFileSystem
from pyspark.sql import functions as F

from repoatlas.operators import changes, documents, graph
from repoatlas.operators.extractors import CPP, Extractor, Registry
from repoatlas.operators.summarize import answer_open, load_attempts, summarize, unanswered
from repoatlas.plans.status import status
from repoatlas.plans.update import module_edges, new_docs, prepare, prepare_once, prompts, update, with_facts
from repoatlas.settings import JobOptions
from repoatlas.sources import docs as doc_tables
from repoatlas.sources import rules, state_store
from repoatlas.sources.tree import list_tree, read_binary_tree, read_tree
from repoatlas.sources.workspace import new_dir
from repoatlas.streaming.feed import CHANGES, _Feed, changed_versions, feed_state, hashed_versions, run_feed

FILES = {
    "src/a/x.cpp": '#include "../b/y.h"\n#include "src/c/z.h"\n#include "x.h"\nint f() { return 1; }\n',
    "src/a/x.h": "struct X { int g() { return 2; } };\n",
    "src/b/y.h": "#include <vector>\nclass Y;\n",
    "src/c/z.h": '#include "../b/y.h"\n',
    "src/c/test/t.cpp": "int t() {}\n",
    "src/c/notes.txt": "not code\n",
}


def _table(spark, files, repo="r"):
    rows = [(repo, p, bytearray(c.encode()), len(c), None) for p, c in files.items()]
    return spark.createDataFrame(
        rows, "repo string, path string, content binary, size bigint, mtime timestamp"
    )


def _none(spark):
    return spark.createDataFrame([], "repo string, prompt_hash string, text string")


def _ts(text):
    return F.lit(text).cast("timestamp")


def test_update_twice_then_change(spark):
    base, options = new_dir(spark, "job"), JobOptions()
    files = _table(spark, FILES)
    assert update(spark, base, files, _none(spark), "one", _ts("2024-01-01"), options)
    first = {r.path: r.module for r in state_store.load_files(spark, base).collect()}
    assert first == {
        "src/a/x.cpp": "src/a", "src/a/x.h": "src/a", "src/b/y.h": "src/b", "src/c/z.h": "src/c",
    }
    assert not update(spark, base, files, _none(spark), "idle", _ts("2024-01-02"), options)
    assert status(files, state_store.load_files(spark, base), options).first().up_to_date

    changed = dict(FILES, **{"src/c/z.h": '#include "../a/x.h"\n'})
    changed.pop("src/b/y.h")
    assert update(
        spark, base, _table(spark, changed), _none(spark), "two", _ts("2024-01-03"), options
    )
    # Deleted files stay in the state; unchanged modules keep their documents.
    assert {r.path for r in state_store.load_files(spark, base).collect()} == set(first)
    assert state_store.latest_runs(spark, base).first().run_id == "two"
    written = doc_tables.read_docs(spark, f"{base}/docs/run_id=two").collect()
    content = {r.module: r.content for r in written}
    assert set(content) == {"src/a", "src/b", "src/c"}
    assert "**Depends on**:\n- [src/a](./src_a.md)\n" in content["src/c"]
    assert "2024-01-01" in content["src/a"] and "2024-01-03" in content["src/c"]
    assert "**Depends on**:\n- [src/b](./src_b.md)\n- [src/c](./src_c.md)" in content["src/a"]
    overview = doc_tables.read_overviews(spark, f"{base}/overviews/run_id=two").first().content
    assert "### Src\n\n- `src/a`\n- `src/b`\n- `src/c`\n\n## Modules\n" in overview
    modules = {r.module: r for r in state_store.load_modules(spark, base).collect()}
    assert str(modules["src/c"].generated_at).startswith("2024-01-03")
    assert str(modules["src/b"].generated_at).startswith("2024-01-01")


def test_full_run_equals_incremental_from_nothing(spark):
    files, empty = _table(spark, FILES), state_store.load_files(spark, new_dir(spark, "none"))
    runs = [prepare(files, empty, JobOptions(mode=m)) for m in ("full", "incremental")]
    rows = [sorted(map(tuple, r.run_files.collect())) for r in runs]
    assert rows[0] == rows[1] and len(rows[0]) == 4


def test_module_scope_takes_all_files_of_touched_modules(spark):
    saved = prepare(_table(spark, FILES), state_store.load_files(spark, new_dir(spark, "n")), JobOptions()).run_files
    changed = _table(spark, dict(FILES, **{"src/a/x.h": "\n"}))
    narrow = prepare(changed, saved, JobOptions()).run_files.collect()
    wide = prepare(changed, saved, JobOptions(scope="module")).run_files.collect()
    assert [r.path for r in narrow] == ["src/a/x.h"]
    assert sorted(r.path for r in wide) == ["src/a/x.cpp", "src/a/x.h"]


def test_difference_forms_agree(spark):
    current = changes.hash_files(_table(spark, FILES))
    saved = current.where(F.col("path") != "src/a/x.h").withColumn("module", F.lit("m"))
    a = changes.changed_files(current, saved).select("path").collect()
    b = changes.changed_except(current, saved).select("path").collect()
    assert a == b and [r.path for r in a] == ["src/a/x.h"]


def test_written_path_beats_relative_path(spark):
    imports = spark.createDataFrame(
        [("r", "src/a/x.cpp", "x.h"), ("r", "src/a/x.cpp", "nope.h")], "repo string, path string, name string"
    )
    known = spark.createDataFrame(
        [("r", "x.h", "root"), ("r", "src/a/x.h", "src/a")], "repo string, path string, module string"
    )
    got = {r.name: r.target_module for r in graph.resolve_imports(imports, known).collect()}
    assert got == {"x.h": "root", "nope.h": None}


def test_rules_per_repository(spark):
    files = _table(spark, {"src/a.cpp": "", "lib/b.py": ""}, "one").unionByName(
        _table(spark, {"src/a.cpp": "", "lib/b.py": ""}, "two")
    )
    own = spark.createDataFrame([("two", "include", "lib/*.py")], "repo string, kind string, pattern string")
    effective = rules.effective_rules(files.select("repo").distinct(), own)
    kept = rules.filter_by_rules(files, effective).select("repo", "path").collect()
    assert sorted(map(tuple, kept)) == [("one", "src/a.cpp"), ("two", "lib/b.py")]


def test_state_document_import(spark, tmp_path):
    doc = {
        "version": 1,
        "last_run": "2024-01-01T00:00:00.5Z",
        "files": {"a.h": {"hash": "sha256:1", "module": "root"}},
        "modules": {"root": {"generated_at": "2024-01-01T00:00:00.5Z", "source_hashes": ["sha256:1"]}},
    }
    path = tmp_path / "state.json"
    path.write_text(json.dumps(doc, indent=2))
    files, modules = state_store.import_json(spark, str(path), "r")
    assert [tuple(r) for r in files.collect()] == [("r", "a.h", "sha256:1", "root")]
    assert modules.first().source_hashes == ["sha256:1"]
    path.write_text("{ broken")
    assert state_store.import_json(spark, str(path), "r")[0].count() == 0
    assert state_store.import_json(spark, str(tmp_path / "absent.json"), "r")[0].count() == 0


def test_raw_tree(spark, tmp_path):
    contents = {
        ".hidden": b"h", "_private/x.h": b"p", "empty.cpp": b"", "with space.h": b"s",
        "deep/er/bad.cpp": b"\xff\xfe", "deep/.git/config": b"g",
    }
    for name, data in contents.items():
        full = tmp_path / name
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(data)
    (tmp_path / "deep" / "loop").symlink_to(tmp_path)
    (tmp_path / "none").mkdir()
    for split in (2_000, 1 << 20):
        rows = read_tree(spark, str(tmp_path), "r", split).collect()
        assert {r.path: bytes(r.content) for r in rows} == contents and len(rows) == len(contents)
        assert all(r.size == len(r.content) and r.repo == "r" for r in rows)
    by_uri = read_tree(spark, tmp_path.as_uri() + "/", "r").collect()
    assert sorted(by_uri) == sorted(rows)
    listed = list_tree(spark, str(tmp_path), "r").collect()
    assert sorted(listed) == sorted((r.repo, r.path, r.size, r.mtime) for r in rows)
    # The way object stores go, on a file system that follows links: without the loop.
    (tmp_path / "deep" / "loop").unlink()
    by_store = read_tree(spark, str(tmp_path), "r", store=LocalFileSystem()).collect()
    assert sorted(by_store) == sorted(rows)
    (tmp_path / os.fsdecode(b"bad\xff.h")).write_bytes(b"b")
    named = (read_tree(spark, str(tmp_path), "r"), list_tree(spark, str(tmp_path), "r"))
    assert all(d.where("path = 'bad\ufffd.h'").count() == 1 for d in named)
    empty = tmp_path / "none"
    assert read_tree(spark, str(empty), "r").count() == list_tree(spark, str(empty), "r").count() == 0
    plain = {r.path for r in read_binary_tree(spark, str(tmp_path), "r").collect()}
    assert plain == {"with space.h", "deep/er/bad.cpp"}


def test_a_flat_folder_is_listed_by_one_task(spark, tmp_path):
    """Each folder gives its entries once, also where files are dealt to many tasks."""
    for n in range(300):
        (tmp_path / f"f{n}.h").write_bytes(b"x" * n)
    files = read_tree(spark, str(tmp_path), "r", 100_000)
    assert files.rdd.getNumPartitions() > 8
    assert files.agg(F.count("path"), F.count_distinct("path"), F.sum("size")).first() == (300, 300, 44850)


def test_markdown_folder(spark, tmp_path):
    (tmp_path / "a_b.md").write_text("# A\n\n**Purpose**: p\n")
    (tmp_path / "skip.txt").write_text("x")
    docs = doc_tables.read_markdown(spark, str(tmp_path), "r")
    rows = documents.doc_markers(docs).collect()
    assert [(r.doc_file, r.purpose, r.consumes) for r in rows] == [("a_b.md", "p", "")]


def test_registry_takes_plug_ins(spark):
    def python_imports(files):
        def run(batches):
            for batch in batches:
                for row in batch.itertuples():
                    for i, line in enumerate(bytes(row.content).decode().splitlines()):
                        if line.startswith("import "):
                            yield pd.DataFrame(
                                [(row.repo, row.path, i, line[7:], False)],
                                columns=["repo", "path", "ordinal", "name", "is_system"],
                            )

        return files.select("repo", "path", "content").mapInPandas(
            run, "repo string, path string, ordinal int, name string, is_system boolean"
        )

    registry = Registry(CPP, Extractor("python", (".py",), python_imports))
    files = _table(spark, {"a.PY": "import os\n", "b.c": "#include <x>\n", "c.txt": "import no\n"})
    rows = registry.imports(files).select("path", "name", "language").collect()
    assert sorted(map(tuple, rows)) == [("a.PY", "os", "python"), ("b.c", "x", "cpp")]


def test_summarizer_only_sees_unanswered_prompts(spark):
    run = prepare(_table(spark, FILES), state_store.load_files(spark, new_dir(spark, "n")), JobOptions())
    all_prompts = prompts(run, JobOptions())
    one = all_prompts.where(F.col("module") == "src/a").select("repo", "prompt_hash", F.lit("t").alias("text"))
    open_prompts = unanswered(all_prompts, one)

    def shout(batches):
        for b in batches:
            yield pd.DataFrame({"repo": b["repo"], "prompt_hash": b["prompt_hash"], "text": b["prompt"].str.upper()})

    answers = summarize(open_prompts, shout).collect()
    assert len(answers) == 2 and all("## MODULE: SRC/" in r.text for r in answers)


def test_change_feed(spark):
    source, out, checkpoint = (new_dir(spark, n) for n in ("in", "out", "ck"))
    schema = "repo string, path string, version bigint, content binary"
    steps = [
        [("a", 1, "x"), ("b", 1, "x"), ("a", 2, "x"), ("a", 3, "y")],
        [("a", 4, "y"), ("b", 2, "z"), ("c", 1, "q")],
        [("a", 5, "x")],
    ]
    for rows in steps:
        spark.createDataFrame([("r", p, v, bytearray(c.encode())) for p, v, c in rows], schema).write.mode(
            "append"
        ).parquet(source)
        run_feed(spark.readStream.schema(schema).parquet(source), out, checkpoint)
    got = spark.read.schema(CHANGES).parquet(out).orderBy("path", "version").collect()
    assert [(r.path, r.version, r.change) for r in got] == [
        ("a", 1, "added"), ("a", 3, "modified"), ("a", 5, "modified"),
        ("b", 1, "added"), ("b", 2, "modified"), ("c", 1, "added"),
    ]
    assert os.path.isdir(out)


def test_plug_in_and_summarizer_in_the_job(spark):
    """A registered language reaches prompts and graph; open prompts reach the summariser."""
    def imports(files):
        return files.select(
            "repo", "path", F.lit(0).alias("ordinal"), F.lit("src/b/y.h").alias("name"), F.lit(False).alias("is_system")
        )

    registry = Registry(CPP, Extractor("toy", (".toy",), imports))
    options = JobOptions(include=("src/**",), registry=registry)
    files = _table(spark, {**FILES, "src/t/a.toy": "x"})
    empty = state_store.load_files(spark, new_dir(spark, "n"))
    run = prepare(files, empty, options)
    edges = {tuple(r) for r in module_edges(run, options).collect()}
    assert ("r", "src/t", "src/b") in edges

    def answer(batches):
        for b in batches:
            yield pd.DataFrame({"repo": b["repo"], "prompt_hash": b["prompt_hash"], "text": "answer"})

    base = new_dir(spark, "job")
    assert update(spark, base, files, _none(spark), "one", _ts("2024-01-01 00:00:00"), options, summarizer=answer)
    texts = [r.content for r in doc_tables.read_docs(spark, f"{base}/docs/run_id=one").collect()]
    assert texts and all(t.startswith("answer") for t in texts)
    assert spark.read.parquet(f"{base}/completions").count() == len(texts)
    with pytest.raises(ValueError):
        state_store.save(spark, base, "one", run.run_files, run.run_files, _ts("2024-01-01 00:00:00"))


def test_explicitly_empty_rules(spark):
    files = _table(spark, {"src/a.cpp": ""}, "one")
    own = spark.createDataFrame([("one", "include", None)], "repo string, kind string, pattern string")
    effective = rules.effective_rules(files.select("repo").distinct(), own)
    assert rules.filter_by_rules(files, effective).count() == 0


def test_change_feed_on_saved_state(spark):
    source, out, checkpoint = (new_dir(spark, n) for n in ("in", "out", "ck"))
    files = _table(spark, {"a": "x", "b": "y", "c": "z"})
    saved = changes.hash_files(files.where("path <> 'c'"))
    versions = files.withColumn("version", F.lit(1).cast("bigint")).select("repo", "path", "version", "content")
    versions = versions.withColumn("content", F.when(F.col("path") == "b", F.lit(b"new")).otherwise(F.col("content")))
    versions.write.parquet(source)
    run_feed(spark.readStream.schema(versions.schema).parquet(source), out, checkpoint, saved)
    got = spark.read.schema(CHANGES).parquet(out).orderBy("path").collect()
    assert [(r.path, r.change) for r in got] == [("b", "modified"), ("c", "added")]
    now = {r.path: r.file_hash for r in feed_state(spark, saved, out).collect()}
    want = {r.path: r.file_hash for r in changes.hash_files(versions).collect()}
    assert now == want


def test_one_read_for_hashes_and_facts_then_only_new_hashes(spark):
    base = new_dir(spark, "job")
    reads, facts = (spark.sparkContext.accumulator(0) for _ in range(2))

    @F.udf("binary")
    def read(content):
        reads.add(1)
        return content

    @F.udf("array<struct<name:string,is_system:boolean>>")
    def words(content):
        facts.add(1)
        return [(w, False) for w in content.split()]

    registry = Registry(Extractor("toy", (".toy",), row_imports=words))
    options = JobOptions(include=("**",), registry=registry)

    def run(files, run_id):
        reads.value = facts.value = 0
        table = _table(spark, files).withColumn("content", read("content"))
        assert update(spark, base, table, _none(spark), run_id, _ts("2024-01-01"), options)
        return reads.value, facts.value, spark.read.parquet(f"{base}/facts/run_id={run_id}").count()

    files = {f"src/m{n % 5}/f{n}.toy": f"text {n % 10}" for n in range(40)}
    assert run(files, "one") == (40, 40, 10)
    new = {f"src/new/f{n}.toy": f"new {n % 2}" for n in range(6)}
    # All are read for their hashes; facts are taken of one file for each new content.
    _, taken, stored = run(files | new, "two")
    assert (taken, stored) == (2, 2)
    assert spark.read.parquet(f"{base}/facts").count() == 12


def test_facts_of_a_run_are_those_of_its_files(spark):
    base, options = new_dir(spark, "job"), JobOptions()
    saved = state_store.load_files(spark, base)
    files = _table(spark, FILES).unionByName(_table(spark, FILES, "copy"))
    stored = with_facts(spark, base, "one", files, saved, options)
    direct = prepare(files, saved, options)
    for table in (prompts, module_edges):
        assert sorted(map(repr, table(stored, options).collect())) == sorted(
            map(repr, table(direct, options).collect())
        )
    assert spark.read.parquet(f"{base}/facts").count() == 4


def _state(spark, rows):
    files = spark.createDataFrame(rows, "repo string, path string, file_hash string, module string")
    modules = files.select("repo", "module").distinct().select(
        "repo", "module", F.lit(0).alias("part"), _ts("2024-01-01").alias("generated_at"),
        F.array(F.lit("h")).alias("source_hashes"),
    )
    return files, modules


def _loaded(spark, base):
    tables = state_store.load_files(spark, base), state_store.load_modules(spark, base)
    return [sorted(map(tuple, t.collect())) for t in tables]


def test_state_log(spark):
    base = new_dir(spark, "state")
    first = [(repo, f"p{n}", "old", f"m{n % 3}") for repo in ("r", "s") for n in range(100)]
    state_store.save(spark, base, "one", *_state(spark, first), _ts("2024-01-01"))
    changed = [("r", "p5", "new", "m9"), ("r", "added", "new", "m9")]
    state_store.save(spark, base, "two", *_state(spark, changed), _ts("2024-01-02"))
    # A run writes what it changed, and no other.
    assert spark.read.parquet(f"{base}/files/run_id=two").count() == 2
    want = {(r, p): (r, p, h, m) for r, p, h, m in first + changed}
    files, modules = _loaded(spark, base)
    assert files == sorted(want.values())
    assert [m[:2] for m in modules] == [("r", "m0"), ("r", "m1"), ("r", "m2"), ("r", "m9"), ("s", "m0"), ("s", "m1"), ("s", "m2")]
    # A run that dies before it is published leaves nothing visible; its id can be used again.
    _state(spark, [("r", "p7", "dead", "m")])[0].write.partitionBy("repo").parquet(f"{base}/files/run_id=three")
    assert _loaded(spark, base) == [files, modules]
    assert state_store.compact(spark, base, "none") == 0
    assert state_store.compact(spark, base, "all", share=0.01) == 1
    assert _loaded(spark, base) == [files, modules]
    latest = {r.repo: r.run_id for r in state_store.latest_runs(spark, base).collect()}
    assert latest == {"r": "two", "s": "one"}
    # The first run still holds one repository; the second holds none.
    assert state_store.drop_superseded(spark, base) == ["two"]
    assert _loaded(spark, base) == [files, modules]
    many = [("r", f"p{n}", "third", "m0") for n in range(60)]
    state_store.save(spark, base, "three", *_state(spark, many), _ts("2024-01-03"))
    assert not state_store.run_log(spark, base).where("run_id = 'three-compacted'").isEmpty()
    assert sum(f[2] == "third" for f in _loaded(spark, base)[0]) == 60


def _prompt_table(spark, n):
    rows = [("r", f"h{i}", f"prompt {i}") for i in range(n)]
    return spark.createDataFrame(rows, "repo string, prompt_hash string, prompt string")


def test_answers_of_finished_buckets_outlive_a_dead_job(spark, tmp_path):
    """A hook that ends its process loses its bucket only; the next start sends what is open."""
    prompts_, path = _prompt_table(spark, 40), new_dir(spark, "answers")
    calls, trap = tmp_path / "calls", tmp_path / "trap"
    calls.mkdir()
    trap.touch()

    def answer(batches):
        for b in batches:
            for h in b["prompt_hash"]:
                if h == "h7" and trap.exists():
                    os._exit(1)
                (calls / f"{h}-{os.urandom(8).hex()}").touch()
            yield pd.DataFrame({"repo": b["repo"], "prompt_hash": b["prompt_hash"], "text": b["prompt"] + "!"})

    with pytest.raises(Exception):
        answer_open(prompts_, answer, path, bucket_rows=5)
    kept = {r.prompt_hash for r in load_attempts(spark, path).collect()}
    assert "h7" not in kept
    trap.unlink()
    before = len(list(calls.iterdir()))
    answers = answer_open(prompts_, answer, path, bucket_rows=5)
    assert {r.prompt_hash: r.text for r in answers.collect()} == {f"h{i}": f"prompt {i}!" for i in range(40)}
    assert load_attempts(spark, path).count() == 40
    # Only what was open is sent after the restart, and a third start sends nothing.
    assert len(list(calls.iterdir())) - before == 40 - len(kept)
    before = len(list(calls.iterdir()))
    answer_open(prompts_, answer, path)
    assert len(list(calls.iterdir())) == before


def test_failed_prompts_stay_as_rows_and_are_retried_by_bound(spark, tmp_path):
    prompts_, path = _prompt_table(spark, 12), new_dir(spark, "answers")
    healed = tmp_path / "healed"

    def answer(batches):
        for b in batches:
            if (b["prompt_hash"] == "h3").any() and not healed.exists():
                raise ValueError("no such model")
            b = b[b["prompt_hash"] != "h5"]
            yield pd.DataFrame({"repo": b["repo"], "prompt_hash": b["prompt_hash"], "text": b["prompt"]})

    answers = answer_open(prompts_, answer, path, most_attempts=2)
    assert {r.prompt_hash for r in answers.collect()} == {f"h{i}" for i in range(12)} - {"h3", "h5"}
    failed = load_attempts(spark, path).where("text is null").collect()
    assert sorted((r.prompt_hash, r.error) for r in failed) == [
        ("h3", "ValueError: no such model"), ("h3", "ValueError: no such model"),
        ("h5", "no answer"), ("h5", "no answer"),
    ]
    healed.touch()
    assert answer_open(prompts_, answer, path, most_attempts=2).count() == 10
    assert answer_open(prompts_, answer, path, most_attempts=3).where("prompt_hash = 'h3'").count() == 1


def _versions(spark, rows):
    return spark.createDataFrame(
        [("r", p, v, None if c is None else bytearray(c.encode())) for p, v, c in rows],
        "repo string, path string, version bigint, content binary",
    )


def test_feed_batches_equal_one_pass_over_all_versions(spark):
    """Many batches with compactions, one replayed, against a plain loop."""
    out, checkpoint = new_dir(spark, "out"), new_dir(spark, "ck")
    feed = _Feed(spark, out, checkpoint, None, 0.3)
    last, want, batches = {}, [], []
    for n in range(6):
        rows = [(f"p{(n * 5 + i * i) % 11}", n * 10 + i, f"c{(n + i) % 3}") for i in range(9)]
        rows += [("null", n, None), ("late", -n, f"l{n // 2}")]
        batches.append(rows)
        for p, v, c in sorted(rows, key=lambda r: r[1]):
            if c != last.get(p):
                want.append((n, p, v, "modified" if p in last else "added"))
                last[p] = c
    for n, rows in enumerate(batches):
        feed.step(hashed_versions(_versions(spark, rows)), n)
        if n in (0, 3):
            feed.step(hashed_versions(_versions(spark, rows)), n)
    got = feed.changes().select("batch", "path", "version", "change").collect()
    null_hash = hashed_versions(_versions(spark, [("null", 0, None)])).first().file_hash
    want += [(0, "null", 0, "added")] if null_hash is not None else []
    assert sorted(map(tuple, got)) == sorted(w for w in want if w[1] != "null" or null_hash is not None)
    assert feed.log().count() > 1


def test_feed_step_has_no_python_workers(spark):
    arrived = hashed_versions(_versions(spark, [("a", 1, "x")]))
    known = arrived.withColumn("seq", F.lit(0).cast("bigint"))
    plan = changed_versions(known, arrived)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert changed_versions(known, arrived).isEmpty()


def test_feed_ignores_a_saved_state_once_begun(spark):
    source, out, checkpoint = (new_dir(spark, n) for n in ("in", "out", "ck"))
    rows = _versions(spark, [("a", 1, "x"), ("b", 1, "y")])
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    saved = changes.hash_files(_table(spark, {"a": "x"}))
    run_feed(stream, out, checkpoint, saved)
    _versions(spark, [("a", 2, "x"), ("b", 2, "z")]).write.mode("append").parquet(source)
    run_feed(stream, out, checkpoint, changes.hash_files(_table(spark, {"b": "z"})))
    run_feed(stream, out, checkpoint)
    got = spark.read.schema(CHANGES).parquet(out).collect()
    assert sorted((r.path, r.version, r.change) for r in got) == [("b", 1, "added"), ("b", 2, "modified")]


def test_documents_take_hashes_includes_and_symbols_from_one_read(spark):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("binary")
    def counted(content):
        reads.add(1)
        return content

    # A path that comes twice with other includes, and one of no known language.
    rows = [(p, c) for p, c in FILES.items()] + [("src/a/x.h", '#include "../c/z.h"\nint h() {}\n')]
    table = spark.createDataFrame(
        [("r", p, bytearray(c.encode()), len(c), None) for p, c in rows],
        "repo string, path string, content binary, size bigint, mtime timestamp",
    )
    none = spark.createDataFrame([], "repo string, path string, file_hash string, module string")

    def docs(make, mode):
        options = JobOptions(include=("src/**",), exclude=("**/test/**",), mode=mode)
        run = make(table.withColumn("content", counted("content")), none, options)
        found = new_docs(run, options, prompts(run, options), _none(spark), _ts("2024-01-01"))
        return sorted(map(tuple, found.collect()))

    n_selected = sum("/test/" not in p for p, _ in rows)
    once = docs(prepare_once, "full")
    assert reads.value == n_selected
    assert once == docs(prepare, "full")
    assert docs(prepare_once, "incremental") == docs(prepare, "incremental") == once
