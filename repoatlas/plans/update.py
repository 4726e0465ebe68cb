"""One run: select, hash, diff, group, extract, link, document, save."""

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoatlas.operators import (
    changes,
    documents,
    graph,
    modules,
    state,
    structures,
)
from repoatlas.operators.extractors import CPP, Registry
from repoatlas.operators.summarize import answer_open, load_answers, unanswered
from repoatlas.plans.status import select_files
from repoatlas.settings import JobOptions
from repoatlas.sources import docs as doc_tables
from repoatlas.sources import facts_store, state_store
from repoatlas.sources.workspace import materialize, small_enough, written


@dataclass(frozen=True)
class Run:
    """The tables of a run."""

    current: DataFrame  # selected files: repo, path, file_hash, module, module_path
    run_files: DataFrame  # those this run works on
    sources: DataFrame  # their content, known languages only
    file_map: DataFrame  # all known files and their modules
    facts: DataFrame | None = None  # their structures, where they are stored already
    segments: DataFrame | None = None  # segments and heads of the sources, where stored

    @property
    def modules(self) -> DataFrame:
        return self.run_files.select("repo", "module").distinct()


def prepare(
    files: DataFrame,
    state_files: DataFrame,
    options: JobOptions,
    rules: DataFrame | None = None,
    hashed: DataFrame | None = None,
) -> Run:
    """The tables of a run; ``hashed`` where the selected files were read already."""
    selected = select_files(files, options, rules)
    hashed = changes.hash_files(selected) if hashed is None else hashed
    current = modules.assign_modules(hashed, options.strategy, options.depth)
    if options.mode == "full":
        run_files = current
    else:
        changed = changes.changed_files(current, state_files)
        # The narrow list of changed files steers every later stage: computed once.
        run_files = materialize(state.files_of_scope(current, changed, options.scope))
    known = selected.where(registry_of(options).language(F.col("path")).isNotNull())
    sources = known if options.mode == "full" else content_of(known, run_files)
    return Run(current, run_files, sources, graph.file_module_map(run_files, state_files))


def prepare_once(files: DataFrame, state_files: DataFrame, options: JobOptions) -> Run:
    """``prepare`` for jobs that need hashes, includes and symbols: what is read off the content
    is stored, so later steps do not read it again.

    In full mode one read serves all three; else the files that changed are found first.
    """
    registry = registry_of(options)
    shared = structures.row_local(registry)
    if len(shared) < len(list(registry)):
        return prepare(files, state_files, options)
    language = registry.language(F.col("path"))
    if options.mode != "full":
        run = prepare(files, state_files, options)
        segments = written(structures.fact_segments(run.sources, language, shared), "segments")
        return replace(run, segments=segments)
    selected = select_files(files, options)
    segments = written(structures.fact_segments(selected, language, shared, True), "segments")
    hashed = segments.where("head is not null").select("repo", "path", "head.file_hash")
    run = prepare(files, state_files, options, hashed=hashed)
    return replace(run, segments=segments.where(language.isNotNull()))


def content_of(files: DataFrame, chosen: DataFrame) -> DataFrame:
    """Files of a stored list: a short list goes to the content, only a long one moves it."""
    return files.join(small_enough(chosen.select("repo", "path")), ["repo", "path"], "left_semi")


def registry_of(options: JobOptions) -> Registry:
    return options.registry or Registry(CPP)


def with_facts(
    spark: SparkSession,
    base: str,
    run_id: str,
    files: DataFrame,
    state_files: DataFrame,
    options: JobOptions,
    rules: DataFrame | None = None,
) -> Run:
    """``prepare`` with the structures of the run's files out of the table of facts.

    What a content declares is stored under its hash and read off once, for all copies and
    later runs. The first run reads the content once, for hashes and facts together; later runs
    read it for the hashes, and again only one file of each hash that is new.
    """
    registry = registry_of(options)
    known = facts_store.load(spark, base)
    segments = hashed = None
    if state_files.isEmpty() and known.isEmpty():
        selected = select_files(files, options, rules)
        shared = structures.row_local(registry)
        language = registry.language(F.col("path"))
        segments = written(structures.fact_segments(selected, language, shared, True), "segments")
        hashed = segments.where("head is not null").select("repo", "path", "head.file_hash")
    run = prepare(files, state_files, options, rules, hashed)
    if options.mode == "full":
        run = replace(run, run_files=materialize(run.run_files))
    language = registry.language(F.col("path"))
    needed = run.run_files.select("repo", "path", "file_hash", language.alias("language"))
    needed = needed.where("language is not null")
    new = written(facts_store.firsts(needed, known), "new-facts")
    sources = content_of(run.sources, new)
    if segments is not None:
        segments = segments.join(new, ["repo", "path"], "left_semi")
    facts_store.add(
        spark, base, run_id, structures.registry_structures(sources, registry, segments)
    )
    return replace(run, facts=facts_store.of_files(needed, facts_store.load(spark, base)))


def run_imports(run: Run, options: JobOptions) -> DataFrame:
    """Includes of the run's files with the module of the importing file."""
    if run.facts is None and run.segments is None:
        imports = registry_of(options).imports(run.sources)
        return modules.assign_modules(imports, options.strategy, options.depth)
    names = F.col("head.imports") if run.facts is None else F.col("imports")
    read = run.segments if run.facts is None else run.facts
    # Modules are named once a file.
    read = modules.assign_modules(read.select("repo", "path", names.alias("names")), options.strategy, options.depth)
    imports = read.select("*", F.posexplode("names").alias("ordinal", "i"))
    return imports.select("repo", "path", "ordinal", "i.name", "i.is_system", "module", "module_path")


def module_edges(run: Run, options: JobOptions) -> DataFrame:
    """Edges between modules: few rows, read several times, so computed once."""
    return materialize(graph.module_edges(run_imports(run, options), run.file_map))


def prompts(run: Run, options: JobOptions, texts: bool = True) -> DataFrame:
    """Prompts of the run's modules; without ``texts`` their hashes, which documents go by."""
    found = run.facts
    if found is None:
        found = structures.registry_structures(run.sources, registry_of(options), run.segments)
    if not texts:
        return documents.prompt_hashes(run.run_files, found)
    return documents.module_prompts(run.run_files, found, options.part_bytes)


def new_docs(
    run: Run,
    options: JobOptions,
    prompt_table: DataFrame,
    completions: DataFrame,
    run_ts: Column,
) -> DataFrame:
    """Documents of the run's modules."""
    edges = module_edges(run, options)
    return documents.module_docs(
        prompt_table,
        completions,
        modules.combined_hashes(run.run_files, options.part_bytes),
        documents.related_sections(edges, run.modules, options.part_bytes),
        run_ts,
    )


def update(
    spark: SparkSession,
    base: str,
    files: DataFrame,
    completions: DataFrame,
    run_id: str,
    run_ts: Column,
    options: JobOptions,
    rules: DataFrame | None = None,
    summarizer=None,
) -> bool:
    """Run and save under ``base``; False if there was nothing to do.

    ``summarizer``, a function over Arrow batches as ``summarize`` takes it, answers the
    prompts that have no stored completion; its answers are saved bucket by bucket under
    ``base/completions`` and serve later runs, also those after one that died. Modules whose
    prompt failed get a deterministic document.

    Documents and overviews are written per run; the state is published last, so a run
    that dies leaves the previous one in force.
    """
    saved_files = state_store.load_files(spark, base)
    run = with_facts(spark, base, run_id, files, saved_files, options, rules)
    run_files = run.run_files
    if run_files.isEmpty():
        return False
    # Only a summariser reads the texts.
    prompt_table = written(prompts(run, options, summarizer is not None), "prompts")
    completions = completions.select("repo", "prompt_hash", "text")
    if summarizer is not None:
        answers = f"{base}/completions"
        saved = load_answers(spark, answers)
        missing = unanswered(unanswered(prompt_table, completions), saved)
        saved = answer_open(missing, summarizer, answers)
        completions = completions.unionByName(unanswered(saved, completions))
    # The merged table refers to the new documents twice.
    documents_new = written(
        new_docs(run, options, prompt_table, completions.dropDuplicates(["repo", "prompt_hash"]), run_ts),
        "documents",
    )
    saved_docs = load_docs(spark, base, run_files)
    all_docs = (
        documents_new if saved_docs is None else documents.merge_docs(saved_docs, documents_new)
    )
    doc_dir = f"{base}/docs/run_id={run_id}"
    doc_tables.write_docs(all_docs, doc_dir)
    doc_tables.write_overviews(
        documents.overviews(doc_tables.read_docs(spark, doc_dir), run_ts, options.part_bytes),
        f"{base}/overviews/run_id={run_id}",
    )
    state_store.save(
        spark,
        base,
        run_id,
        state.state_rows(run_files),
        state.state_modules(run_files, run_ts, options.part_bytes),
        run_ts,
    )
    return True


def load_docs(spark: SparkSession, base: str, run_files: DataFrame) -> DataFrame | None:
    """Published documents of the run's repositories, or None before the first run."""
    latest = state_store.latest_runs(spark, base)
    if latest.isEmpty():
        return None
    repos = latest.join(run_files.select("repo").distinct(), "repo", "left_semi")
    stored = spark.read.parquet(f"{base}/docs")
    return (
        stored.join(repos.select("repo", "run_id"), ["repo", "run_id"], "left_semi")
        .select("repo", "module", "doc_file", "part", "content")
    )
