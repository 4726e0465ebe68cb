"""One query per operator over corpora derived from the given tables."""

from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repoatlas.functions import cpp_text, globs, paths, text
from repoatlas.operators import (
    changes,
    documents,
    graph,
    includes,
    modules,
    state,
    structures,
    symbols,
)
from repoatlas.operators.extractors import CPP, HTML, Registry, default_registry
from repoatlas.operators.grouping import ordered_items
from repoatlas.operators.summarize import summarize
from repoatlas.plans import update
from repoatlas.settings import DEFAULT_EXCLUDE, JobOptions
from repoatlas.sources import corpora, docs, rules, state_store
from repoatlas.sources.workspace import materialize, new_dir, stored
from repoatlas.streaming.feed import read_changes, run_feed

STAR = JobOptions(include=corpora.STAR_INCLUDE, exclude=DEFAULT_EXCLUDE, depth=corpora.STAR_DEPTH)
STAR_FULL = JobOptions(
    include=corpora.STAR_INCLUDE, exclude=DEFAULT_EXCLUDE, depth=corpora.STAR_DEPTH, mode="full"
)

# Patterns shown by the glob query, all cases of the matching rules.
GLOB_PATTERNS = (
    "src/**/*.h",
    "**/test/**",
    "src/**",
    "*.cpp",
    "src/??/d[0-4]/*",
    "src/[!e]*/d?/*.[hp]*",
    "test/*",
    "**/p1/**/*_1.cpp",
    "include/**/nation_[0-9].h",
)


def _path():
    return F.col("path")


def _run_ts():
    return F.lit(corpora.RUN_TS).cast("timestamp")


def _joined(column, sep=","):
    return F.array_join(column, sep)


def _both(spark, sf_dir) -> DataFrame:
    return corpora.documents_corpus(spark, sf_dir).unionByName(corpora.star_corpus(spark, sf_dir))


def _star(spark, sf_dir) -> DataFrame:
    files = corpora.star_corpus(spark, sf_dir)
    return files.where(globs.selected(_path(), corpora.STAR_INCLUDE, DEFAULT_EXCLUDE))


def _star_hashed(spark, sf_dir) -> DataFrame:
    return modules.assign_modules(
        changes.hash_files(_star(spark, sf_dir)), depth=corpora.STAR_DEPTH
    )


def _star_run(spark, sf_dir, options=STAR_FULL) -> update.Run:
    return update.prepare(
        corpora.star_corpus(spark, sf_dir), corpora.star_state(spark, sf_dir), options
    )


def _star_imports(spark, sf_dir) -> DataFrame:
    return includes.extract_includes(_star(spark, sf_dir))


def _star_scopes(spark, sf_dir) -> DataFrame:
    return symbols.scopes(_star(spark, sf_dir))


def _star_methods(spark, sf_dir) -> DataFrame:
    return symbols.methods_of(_star_scopes(spark, sf_dir))


def _saved_star_docs(spark, sf_dir) -> DataFrame:
    """The written documents, which overviews read."""
    return stored(spark, ("docs", sf_dir), lambda: _star_docs(spark, sf_dir))


def _star_docs(spark, sf_dir, options=STAR_FULL) -> DataFrame:
    run = update.prepare_once(
        corpora.star_corpus(spark, sf_dir), corpora.star_state(spark, sf_dir), options
    )
    # Written first: the stored answers below are derived from the prompts themselves.
    prompts = materialize(update.prompts(run, options, texts=False))
    return update.new_docs(run, options, prompts, corpora.star_completions(prompts), _run_ts())


def _prose_hashed(spark, sf_dir) -> DataFrame:
    return modules.assign_modules(changes.hash_files(corpora.documents_corpus(spark, sf_dir)))


# --- sources and sinks -------------------------------------------------------------


def scan_source_files(spark, sf_dir):
    return _both(spark, sf_dir).select("repo", "path", "size")


def read_text_valid_utf8(spark, sf_dir):
    files = corpora.documents_corpus(spark, sf_dir)
    broken = F.concat("content", F.unhex(F.lit("FF")), F.encode("repo", "UTF-8"))
    clean = text.valid_text(broken)
    return files.select(
        "repo", "path", F.length(clean).alias("n_chars"), F.sha2(clean, 256).alias("text_hash")
    )


def path_rules_effective(spark, sf_dir):
    repos = corpora.table(spark, sf_dir, "documents").select(F.col("source").alias("repo")).distinct()
    return rules.effective_rules(repos, corpora.documents_rules(spark, sf_dir))


def _save_prose(spark, sf_dir, base, run_id, day, files):
    ts = F.lit(day).cast("timestamp")
    state_store.save(
        spark, base, run_id, state.state_rows(files), state.state_modules(files, ts), ts
    )


def state_load(spark, sf_dir):
    """Two runs are saved; the load sees each repository's later one."""
    base = new_dir(spark, "state")
    _save_prose(
        spark, sf_dir, base, "first", "2024-01-01", corpora.documents_state(spark, sf_dir)
    )
    newer = _prose_hashed(spark, sf_dir).where(F.col("repo") != "src1")
    _save_prose(spark, sf_dir, base, "second", "2024-02-01", newer)
    return state_store.load_files(spark, base)


def state_save(spark, sf_dir):
    base = new_dir(spark, "state")
    run = _star_hashed(spark, sf_dir)
    state_store.save(
        spark, base, "only", state.state_rows(run), state.state_modules(run, _run_ts()), _run_ts()
    )
    return state_store.load_files(spark, base)


def module_docs_write(spark, sf_dir):
    folder = new_dir(spark, "docs")
    docs.write_docs(_star_docs(spark, sf_dir), folder)
    return docs.read_docs(spark, folder)


def module_docs_read(spark, sf_dir):
    folder = new_dir(spark, "text")
    docs.export_text(_saved_star_docs(spark, sf_dir), folder)
    return docs.read_exported(spark, folder)


def overview_write(spark, sf_dir):
    folder = new_dir(spark, "overviews")
    docs.write_overviews(documents.overviews(_saved_star_docs(spark, sf_dir), _run_ts()), folder)
    return docs.read_overviews(spark, folder)


# --- filters -----------------------------------------------------------------------


def glob_match(spark, sf_dir):
    hits = F.array(
        *[
            F.struct(F.lit(p).alias("pattern"), globs.glob_match(_path(), p).alias("matched"))
            for p in GLOB_PATTERNS
        ]
    )
    rows = _both(spark, sf_dir).select("repo", "path", F.explode(hits).alias("m"))
    return rows.select("repo", "path", "m.pattern", "m.matched")


def path_filter(spark, sf_dir):
    prose = corpora.documents_corpus(spark, sf_dir)
    default = JobOptions()
    kept = prose.where(globs.selected(_path(), default.include, default.exclude))
    return kept.unionByName(_star(spark, sf_dir)).select("repo", "path")


def glob_theta_join(spark, sf_dir):
    files = corpora.documents_corpus(spark, sf_dir)
    effective = rules.effective_rules(
        files.select("repo").distinct(), corpora.documents_rules(spark, sf_dir)
    )
    return rules.filter_by_rules(files, effective).select("repo", "path")


def changed_predicate(spark, sf_dir):
    rows = changes.with_saved_hash(
        _prose_hashed(spark, sf_dir), corpora.documents_state(spark, sf_dir)
    )
    return rows.where(changes.is_changed()).select("repo", "path", "old_hash", "file_hash")


def imports_local_only(spark, sf_dir):
    return includes.local_only(_star_imports(spark, sf_dir)).select("path", "ordinal", "name")


def edges_no_self(spark, sf_dir):
    resolved = _resolved(spark, sf_dir)
    keep = F.col("target_module").isNotNull() & (F.col("target_module") != F.col("module"))
    return resolved.where(keep).select("path", "name", "module", "target_module")


def extraction_skips(spark, sf_dir):
    return symbols.extraction_skips(_star(spark, sf_dir))


# --- scalar expressions --------------------------------------------------------------


def relative_path(spark, sf_dir):
    top = F.when(F.col("lang") == "es", F.lit("/database/")).otherwise(F.lit("/data/"))
    full = F.concat(top, "source", F.lit("/"), corpora.documents_path())
    return (
        corpora.table(spark, sf_dir, "documents")
        .select(full.alias("full_path"))
        .withColumn("path", paths.relative_path(F.col("full_path"), "/data"))
    )


def content_hash(spark, sf_dir):
    return changes.hash_files(_both(spark, sf_dir))


def module_name_directory(spark, sf_dir):
    return _both(spark, sf_dir).select(
        "repo",
        "path",
        *[paths.module_name(_path(), "directory", d).alias(f"depth{d}") for d in (1, 2, 3, 4)],
    )


def module_name_file(spark, sf_dir):
    return _both(spark, sf_dir).select(
        "repo", "path", paths.module_name(_path(), "file").alias("module")
    )


def module_name_parent(spark, sf_dir):
    return _both(spark, sf_dir).select(
        "repo", "path", paths.module_name(_path(), "custom").alias("module")
    )


def module_path(spark, sf_dir):
    return _both(spark, sf_dir).select(
        "repo",
        "path",
        paths.module_path(_path(), "directory", 2).alias("by_directory"),
        paths.module_path(_path(), "file").alias("by_file"),
    )


def language_of_file(spark, sf_dir):
    return _both(spark, sf_dir).select(
        "repo", "path", default_registry().language(_path()).alias("language")
    )


def doc_file_name(spark, sf_dir):
    module = paths.module_name(_path(), "file")
    return _both(spark, sf_dir).select(
        "repo", module.alias("module"), paths.doc_file_name(module).alias("doc_file")
    )


def doc_display_name(spark, sf_dir):
    doc_file = paths.doc_file_name(paths.module_name(_path(), "file"))
    return _both(spark, sf_dir).select(
        "repo", doc_file.alias("doc_file"), paths.doc_display_name(doc_file).alias("name")
    )


def short_hash(spark, sf_dir):
    combined = modules.combined_hashes(_prose_hashed(spark, sf_dir))
    return combined.select(
        "repo", "module", text.short_hash(F.col("combined_hash")).alias("short_hash")
    )


def metadata_footer(spark, sf_dir):
    digest = F.when(
        F.col("o_orderstatus") != "P", F.sha2(F.col("o_orderkey").cast("string"), 256)
    )
    return corpora.table(spark, sf_dir, "orders").select(
        "o_orderkey", text.metadata_footer(F.col("o_orderdate"), digest).alias("footer")
    )


def run_timestamp(spark, sf_dir):
    return corpora.table(spark, sf_dir, "events").select(
        "event_id", text.run_timestamp(F.col("ts")).alias("stamp")
    )


def include_classify(spark, sf_dir):
    name = F.col("p_name")
    shown = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("<"), name, F.lit(">"))).when(
        F.col("p_size") % 3 == 1, F.concat(F.lit('"'), name, F.lit('"'))
    )
    shown = F.coalesce(shown, name)
    return corpora.table(spark, sf_dir, "part").select(
        "p_partkey",
        cpp_text.include_name(shown).alias("name"),
        cpp_text.include_is_system(shown).alias("is_system"),
    )


def function_signature(spark, sf_dir):
    return symbols.symbol_rows(_star(spark, sf_dir)).where(F.col("record") != "class").select(
        "path", "line_start", "signature"
    )


def category_title(spark, sf_dir):
    shown = F.concat_ws("-", "p_name", "p_type", "p_brand")
    shown = F.when(F.col("p_type") == "ECONOMY", shown).otherwise(F.concat(shown, F.lit("/x")))
    return corpora.table(spark, sf_dir, "part").select(
        "p_partkey", text.category_title(shown).alias("category")
    )


def strip_fences(spark, sf_dir):
    body, fence, lang = F.col("text"), F.lit("```"), F.col("lang")
    wrapped = (
        F.when(lang == "en", F.concat(fence, F.lit("markdown\n"), body, F.lit("\n"), fence))
        .when(lang == "fr", F.concat(fence, F.lit("\n"), body, F.lit(" "), fence))
        .when(lang == "de", F.concat(fence, F.lit("markdown"), fence, body))
        .otherwise(F.concat(body, fence))
    )
    return corpora.table(spark, sf_dir, "documents").select(
        "doc_id", text.strip_fences(wrapped).alias("stripped")
    )


def _marked_docs(spark, sf_dir):
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("**Purpose**:  first "), "lang"),
        "text",
        F.concat(F.lit("**Consumes**: "), "source", F.lit(" **Consumes**: \t")),
        F.when(F.col("lang") == "en", F.concat(F.lit("**Purpose**: last "), "source")),
        F.when(F.col("lang") != "de", F.lit(" **Produces**: indented lines do not count")),
        F.when(F.col("lang") == "fr", F.lit("**Produces**: lignes ")),
    )
    return corpora.table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo"),
        F.concat(F.lit("doc_"), "doc_id", F.lit(".md")).alias("doc_file"),
        F.lit(0).alias("part"),
        lines.alias("content"),
    )


def doc_markers(spark, sf_dir):
    return documents.doc_markers(_marked_docs(spark, sf_dir))


def last_marker_wins(spark, sf_dir):
    return documents.last_marker_lines(_marked_docs(spark, sf_dir), text.PURPOSE)


def related_link_lines(spark, sf_dir):
    run = _star_run(spark, sf_dir)
    sides = graph.related(update.module_edges(run, STAR_FULL), run.modules)
    other = F.col("other")
    return sides.select(
        "module",
        "side",
        text.link_line(other, F.concat(F.lit("./"), paths.doc_file_name(other))).alias("line"),
    )


def base_name(spark, sf_dir):
    return _both(spark, sf_dir).select("repo", "path", paths.base_name(_path()).alias("name"))


def normalize_path(spark, sf_dir):
    local = includes.local_only(_star_imports(spark, sf_dir))
    return local.select(
        "path", "name", paths.normalize_import(_path(), F.col("name")).alias("normalized")
    )


# --- joins -------------------------------------------------------------------------


def changed_files(spark, sf_dir):
    return changes.changed_files(
        _star_hashed(spark, sf_dir), corpora.star_state(spark, sf_dir)
    ).select("repo", "path", "file_hash", "module")


def change_kinds(spark, sf_dir):
    return changes.change_kinds(
        _star_hashed(spark, sf_dir), corpora.star_state(spark, sf_dir)
    ).select("repo", "path", "change")


def _local_with_map(spark, sf_dir):
    run = _star_run(spark, sf_dir)
    return includes.local_only(update.run_imports(run, STAR_FULL)), run.file_map


def _resolved(spark, sf_dir):
    return graph.resolve_imports(*_local_with_map(spark, sf_dir))


def resolve_exact(spark, sf_dir):
    return graph.resolve_exact(*_local_with_map(spark, sf_dir)).select(
        "path", "name", "exact_module"
    )


def resolve_relative(spark, sf_dir):
    return graph.resolve_relative(*_local_with_map(spark, sf_dir)).select(
        "path", "name", "relative_module"
    )


def resolve_imports(spark, sf_dir):
    return _resolved(spark, sf_dir).select("path", "name", "target_module")


def dependents_in_run(spark, sf_dir):
    run = _star_run(spark, sf_dir, STAR)
    edges = graph.dependents_in_run(update.module_edges(run, STAR), run.modules)
    return edges.select("repo", "src_module", "dst_module")


def module_structures(spark, sf_dir):
    """Files of any kind count; those without a parser have no structure."""
    files = modules.assign_modules(corpora.star_corpus(spark, sf_dir), depth=2)
    found = structures.file_structures(_star(spark, sf_dir)).select(
        "repo",
        "path",
        F.size("imports").alias("imports"),
        F.size("classes").alias("classes"),
        F.size("functions").alias("functions"),
    )
    rows = files.select("repo", "path", "module").join(found, ["repo", "path"], "left")

    def total(name):
        return F.sum(F.coalesce(name, F.lit(0))).alias(f"n_{name}")

    return rows.groupBy("repo", "module").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count("imports").alias("n_parsed"),
        total("imports"),
        total("classes"),
        total("functions"),
    )


# --- aggregations --------------------------------------------------------------------


def module_groups(spark, sf_dir):
    grouped = modules.module_groups(_prose_hashed(spark, sf_dir))
    files = F.transform("files", lambda f: F.concat_ws("=", f["path"], f["file_hash"]))
    return grouped.select("repo", "module", "part", "module_path", _joined(files).alias("files"))


def update_dry_run(spark, sf_dir):
    return changes.update_preview(_star_run(spark, sf_dir, STAR).run_files)


def _prose_changed(spark, sf_dir):
    current = _prose_hashed(spark, sf_dir)
    return current, changes.changed_files(current, corpora.documents_state(spark, sf_dir))


def status_summary(spark, sf_dir):
    summary = changes.status_summary(*_prose_changed(spark, sf_dir))
    return summary.withColumn("first_paths", _joined("first_paths"))


def status_top10(spark, sf_dir):
    return changes.first_paths(_prose_changed(spark, sf_dir)[1])


def module_combined_hash(spark, sf_dir):
    rows = _prose_hashed(spark, sf_dir).unionByName(_star_hashed(spark, sf_dir))
    return modules.combined_hashes(rows)


def state_modules_rollup(spark, sf_dir):
    run = _star_run(spark, sf_dir, STAR)
    rows = state.state_modules(run.run_files, _run_ts())
    return rows.select(
        "repo",
        "module",
        "part",
        text.run_timestamp(F.col("generated_at")).alias("generated_at"),
        _joined("source_hashes").alias("source_hashes"),
    )


def _side(spark, sf_dir, side, name):
    run = _star_run(spark, sf_dir)
    rows = graph.related(update.module_edges(run, STAR_FULL), run.modules).where(
        F.col("side") == side
    )
    items = ordered_items(rows, ["repo", "module"], ["other"], F.col("other"))
    return items.select("repo", "module", _joined("items").alias(name))


def module_dependencies(spark, sf_dir):
    return _side(spark, sf_dir, "depends_on", "dependencies")


def module_dependents(spark, sf_dir):
    return _side(spark, sf_dir, "depended_by", "dependents")


def dependency_graph(spark, sf_dir):
    """Both directions per module of the run; modules without edges stay."""
    run = _star_run(spark, sf_dir)
    rows = graph.related(update.module_edges(run, STAR_FULL), run.modules)
    items = ordered_items(
        rows,
        ["repo", "module"],
        ["side", "other"],
        F.struct("side", "other"),
        F.octet_length("other"),
    )

    def side(name):
        picked = F.filter("items", lambda i: i["side"] == F.lit(name))
        return _joined(F.coalesce(F.transform(picked, lambda i: i["other"]), F.array()))

    return run.modules.join(items, ["repo", "module"], "left").select(
        "repo",
        "module",
        side("depends_on").alias("dependencies"),
        side("depended_by").alias("dependents"),
    )


def module_degrees(spark, sf_dir):
    run = _star_run(spark, sf_dir)
    return graph.degrees(update.module_edges(run, STAR_FULL), run.modules)


def include_summary(spark, sf_dir):
    return includes.include_summary(_star(spark, sf_dir)).drop("repo")


def _structures(spark, sf_dir):
    return structures.file_structures(_star(spark, sf_dir))


def visibility_partition(spark, sf_dir):
    def names(*levels):
        picked = structures.with_visibility(F.col("c.methods"), *levels)
        return _joined(F.transform(picked, lambda f: f["name"]))

    rows = _structures(spark, sf_dir).select("path", F.explode("classes").alias("c"))
    return rows.select(
        "path",
        "c.name",
        names("public").alias("public"),
        names("protected").alias("protected"),
        names("private", "unknown").alias("internal"),
    )


def internal_summary(spark, sf_dir):
    owners = F.concat(
        F.transform(
            "classes", lambda c: F.struct(c["name"].alias("owner"), c["methods"].alias("items"))
        ),
        F.array(F.struct(F.lit("").alias("owner"), F.col("functions").alias("items"))),
    )
    lines = F.transform(
        owners,
        lambda o: F.struct(o["owner"].alias("owner"), structures.internal_summary(o["items"]).alias("line")),
    )
    # Filtered as a list: a condition on rows would work the lines out once more.
    found = F.filter(lines, lambda o: o["line"].isNotNull())
    return _structures(spark, sf_dir).select("path", F.explode(found).alias("o")).select("path", "o.*")


def overview_categories(spark, sf_dir):
    found = documents.overview_categories(_saved_star_docs(spark, sf_dir))
    return found.select("repo", "category", "part", _joined("items").alias("names"))


def last_run(spark, sf_dir):
    """Order days as runs of a customer's repository."""
    runs = corpora.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("cust_"), "o_custkey").alias("repo"), F.col("o_orderdate").alias("last_run")
    )
    return state.last_run(runs).select(
        "repo", text.run_timestamp(F.col("last_run")).alias("last_run")
    )


# --- ordered logic -----------------------------------------------------------------


def member_visibility(spark, sf_dir):
    return _star_methods(spark, sf_dir).where("is_own").select(
        "path", "owner_name", "name", "visibility"
    )


def enclosing_scope(spark, sf_dir):
    return symbols.enclosing_scopes(_star_scopes(spark, sf_dir)).drop("repo")


def first_n_preview(spark, sf_dir):
    """First ten files of every module."""
    place = F.row_number().over(W.partitionBy("repo", "module").orderBy("path"))
    rows = _prose_hashed(spark, sf_dir).select("repo", "module", "path", place.alias("place"))
    return rows.where(F.col("place") <= 10)


def file_module_map(spark, sf_dir):
    return _star_run(spark, sf_dir, STAR).file_map


def file_map_union(spark, sf_dir):
    """The same over the prose corpus, grouped one level deeper than the saved state."""
    run = modules.assign_modules(_prose_changed(spark, sf_dir)[1].drop("module"), depth=3)
    return graph.file_module_map(run, corpora.documents_state(spark, sf_dir))


def state_upsert(spark, sf_dir):
    saved = corpora.star_state(spark, sf_dir)
    return state.upsert_files(saved, _star_run(spark, sf_dir, STAR).run_files)


# --- sorts and set operations ------------------------------------------------------


def related_sorted(spark, sf_dir):
    run = _star_run(spark, sf_dir)
    rows = graph.related(update.module_edges(run, STAR_FULL), run.modules)
    items = ordered_items(rows, ["repo", "module", "side"], ["other"], F.col("other"))
    return items.select("module", "side", _joined("items", " < ").alias("others"))


def docs_sorted(spark, sf_dir):
    place = F.row_number().over(W.partitionBy("repo").orderBy("doc_file")).cast("long")
    return _saved_star_docs(spark, sf_dir).select("repo", "doc_file", place.alias("place"))


def categories_sorted(spark, sf_dir):
    return (
        documents.overview_lines(_saved_star_docs(spark, sf_dir))
        .where(F.col("line").startswith("### "))
        .select(
            "repo",
            "category",
            "line",
            F.row_number().over(W.partitionBy("repo").orderBy("category")).cast("long").alias("place"),
        )
    )


def changed_except(spark, sf_dir):
    return changes.changed_except(
        _prose_hashed(spark, sf_dir), corpora.documents_state(spark, sf_dir)
    )


def edges_distinct(spark, sf_dir):
    return update.module_edges(_star_run(spark, sf_dir), STAR_FULL)


# --- extraction --------------------------------------------------------------------


def extract_includes(spark, sf_dir):
    return _star_imports(spark, sf_dir)


def extract_classes(spark, sf_dir):
    return symbols.classes_of(_star_scopes(spark, sf_dir)).drop("repo", "class_id")


def extract_methods(spark, sf_dir):
    return _star_methods(spark, sf_dir).where("is_own").select(
        "path", "owner_name", "name", "signature", "line_start", "line_end", "visibility"
    )


def methods_with_nested(spark, sf_dir):
    return _star_methods(spark, sf_dir).select(
        "path", "owner_name", "name", "line_start", "visibility", "is_own"
    )


def _functions(spark, sf_dir):
    return symbols.functions_of(_star_scopes(spark, sf_dir))


def extract_functions(spark, sf_dir):
    return _functions(spark, sf_dir).select("path", "name", "line_start")


def function_visibility(spark, sf_dir):
    return _functions(spark, sf_dir).select("path", "name", "visibility")


def function_records(spark, sf_dir):
    return _functions(spark, sf_dir).select(
        "path", "name", "signature", "line_start", "line_end", "visibility"
    )


def function_names(spark, sf_dir):
    rows = symbols.symbol_rows(_star(spark, sf_dir)).where(F.col("record") != "class")
    return rows.groupBy("path", "record").agg(
        _joined(
            F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda r: r["name"])
        ).alias("names")
    )


def symbol_line_ranges(spark, sf_dir):
    return symbols.symbol_rows(_star(spark, sf_dir)).select(
        "path", "record", "name", "line_start", "line_end"
    )


def file_structures(spark, sf_dir):
    def shown(items, *names):
        return _joined(
            F.transform(items, lambda i: F.concat_ws(" ", *[i[n].cast("string") for n in names])),
            "; ",
        )

    classes = F.transform(
        "classes",
        lambda c: F.concat(
            c["name"],
            F.lit(" ["),
            _joined(F.transform(c["methods"], lambda m: m["name"])),
            F.lit("]"),
        ),
    )
    return _structures(spark, sf_dir).select(
        "path",
        "language",
        shown("imports", "name", "is_system").alias("imports"),
        _joined(classes, "; ").alias("classes"),
        shown("functions", "name", "visibility").alias("functions"),
    )


# --- documents ---------------------------------------------------------------------


def structure_summary(spark, sf_dir):
    run = _star_run(spark, sf_dir)
    return documents.structure_summary(
        run.run_files, structures.file_structures(run.sources)
    ).withColumnRenamed("text", "summary")


def file_list_text(spark, sf_dir):
    return documents.file_list_text(_prose_hashed(spark, sf_dir)).withColumnRenamed(
        "text", "file_list"
    )


def module_prompts(spark, sf_dir):
    prompts = update.prompts(_star_run(spark, sf_dir), STAR_FULL)
    return prompts.select("repo", "module", "part", "module_path", "prompt", "prompt_hash")


def related_modules(spark, sf_dir):
    run = _star_run(spark, sf_dir)
    sections = documents.related_sections(update.module_edges(run, STAR_FULL), run.modules)
    return sections.withColumnRenamed("text", "section")


def module_docs(spark, sf_dir):
    return _star_docs(spark, sf_dir)


def module_docs_incremental(spark, sf_dir):
    """Only the modules of the changed files get a new document."""
    run = _star_run(spark, sf_dir)
    saved = modules.combined_hashes(run.run_files).select(
        "repo",
        "module",
        paths.doc_file_name(F.col("module")).alias("doc_file"),
        F.lit(0).alias("part"),
        F.concat(F.lit("saved "), "combined_hash").alias("content"),
    )
    return documents.merge_docs(saved, _star_docs(spark, sf_dir, STAR))


def overview(spark, sf_dir):
    return documents.overviews(_saved_star_docs(spark, sf_dir), _run_ts())


# --- surfaces ----------------------------------------------------------------------


def extractor_registry(spark, sf_dir):
    """Imports of two languages in one table; page paths have no suffix."""
    registry = Registry(CPP, HTML)
    cpp = registry.imports(_star(spark, sf_dir))
    html = registry.imports(corpora.pages_corpus(spark, sf_dir), default="html")
    return cpp.unionByName(html)


def _count_lines(batches):
    for batch in batches:
        lines = batch["prompt"].str.count("\n")
        title = batch["prompt"].str.extract(r"(?m)^## Module: (.*)$")[0]
        yield pd.DataFrame(
            {
                "repo": batch["repo"],
                "prompt_hash": batch["prompt_hash"],
                "text": title + " has a prompt of " + lines.astype(str) + " lines",
            }
        )


def summarizer_hook(spark, sf_dir):
    return summarize(update.prompts(_star_run(spark, sf_dir), STAR_FULL), _count_lines)


def stream_changed_files(spark, sf_dir):
    """Two batches: the files as they were, then as they are."""
    source, out = new_dir(spark, "versions"), new_dir(spark, "changes")
    checkpoint = new_dir(spark, "stream")
    schema = "repo string, path string, version bigint, content binary"
    for version, day in enumerate((corpora.SNAPSHOT_DAY, None)):
        files = corpora.star_corpus(spark, sf_dir, day)
        files.select("repo", "path", F.lit(version).cast("bigint").alias("version"), "content").write.mode(
            "append"
        ).parquet(source)
        run_feed(spark.readStream.schema(schema).parquet(source), out, checkpoint)
    return read_changes(spark, out)


NAMES = (
    "scan_source_files read_text_valid_utf8 path_rules_effective state_load state_save "
    "module_docs_write module_docs_read overview_write glob_match path_filter "
    "changed_predicate imports_local_only edges_no_self extraction_skips relative_path "
    "content_hash module_name_directory module_name_file module_name_parent module_path "
    "language_of_file doc_file_name doc_display_name short_hash metadata_footer "
    "run_timestamp include_classify function_signature category_title strip_fences "
    "doc_markers related_link_lines base_name normalize_path changed_files change_kinds "
    "resolve_exact resolve_relative resolve_imports dependents_in_run module_structures "
    "glob_theta_join module_groups update_dry_run status_summary module_combined_hash "
    "state_modules_rollup module_dependencies module_dependents dependency_graph "
    "include_summary visibility_partition internal_summary overview_categories last_run "
    "member_visibility enclosing_scope first_n_preview last_marker_wins file_module_map "
    "state_upsert related_sorted docs_sorted categories_sorted status_top10 "
    "file_map_union changed_except edges_distinct extract_includes extract_classes "
    "extract_methods methods_with_nested extract_functions function_visibility "
    "function_records function_names symbol_line_ranges file_structures "
    "structure_summary file_list_text module_prompts related_modules module_docs "
    "module_docs_incremental overview extractor_registry summarizer_hook "
    "stream_changed_files module_degrees"
).split()


def _configured(query, spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return query(spark, sf_dir)


QUERIES = {name: partial(_configured, globals()[name]) for name in NAMES}
