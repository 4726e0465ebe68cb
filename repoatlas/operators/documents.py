"""Prompts, module documents and overviews."""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repoatlas.functions import paths, text
from repoatlas.operators.graph import related
from repoatlas.operators.grouping import ordered_items, ordered_text
from repoatlas.operators.structures import structure_text
from repoatlas.settings import PART_BYTES

_MODULE = ["repo", "module"]

PROMPT_HEAD = """Describe one module of a code base for readers who have never seen the code.
Answer in markdown. Start with the title "# Module: NAME", then give one line each for
**Purpose**: what the module does,
**Location**: its directory,
**Consumes**: what it takes in,
**Produces**: what it hands on.
Then cover its dependencies in both directions, key components, public interface,
usage examples, patterns that prevent misuse, invariants, and a list of its files.
Prefer architecture over retelling code, and be brief.

"""


# What stands between the parts of a prompt.
_TO_MODULE, _TO_PATH = "## Module: ", "\nDirectory: "
_TO_FILES, _TO_STRUCTURE, _PROMPT_END = "\n\n## Files:\n", "\n\n## Structure:\n", "\n"


def prompt_text(module: Column, module_path: Column, file_list: Column, structure: Column) -> Column:
    return F.concat(
        F.lit(PROMPT_HEAD + _TO_MODULE),
        module,
        F.lit(_TO_PATH),
        module_path,
        F.lit(_TO_FILES),
        file_list,
        F.lit(_TO_STRUCTURE),
        structure,
        F.lit(_PROMPT_END),
    )


def fallback_text(module: Column, module_path: Column, file_list: Column, n_files: Column) -> Column:
    """Deterministic document for modules without a completion."""
    return F.concat(
        F.lit("# Module: "),
        module,
        F.lit("\n\n**Purpose**: Holds "),
        n_files.cast("string"),
        F.lit(" file(s).\n\n**Location**: `"),
        module_path,
        F.lit("`\n\n## File List\n\n"),
        file_list,
    )


def file_list_text(run_files: DataFrame, budget: int = PART_BYTES) -> DataFrame:
    line = F.concat(F.lit("- "), paths.base_name(F.col("path")))
    return ordered_text(run_files, _MODULE, ["path"], line, "\n", budget=budget)


def structure_summary(
    run_files: DataFrame, structures: DataFrame, budget: int = PART_BYTES
) -> DataFrame:
    """Structure text per module."""
    rows = run_files.select("repo", "path", "module").join(
        structures.select("repo", "path", structure_text().alias("block")), ["repo", "path"]
    )
    return ordered_text(rows, _MODULE, ["path"], F.col("block"), "\n", budget)


def module_prompts(
    run_files: DataFrame, structures: DataFrame, budget: int = PART_BYTES
) -> DataFrame:
    """prompts(repo, module, part, module_path, n_files, prompt, prompt_hash, fallback).

    Files and structures are gathered in one grouping. A module has one prompt, whatever
    its size; beyond ``budget`` bytes its lists are ordered in parts and then joined.
    """
    rows = run_files.select("repo", "path", "module", "module_path").join(
        structures.select("repo", "path", structure_text().alias("block")), ["repo", "path"], "left"
    )
    lengths = (F.octet_length(c) for c in ("path", "module_path", "block"))
    size = sum((F.coalesce(n, F.lit(0)) for n in lengths), F.lit(0))
    items = ordered_items(
        rows,
        _MODULE,
        ["path"],
        F.struct(paths.base_name(F.col("path")).alias("name"), "module_path", "block"),
        size,
        budget,
    )
    listed = items.select(
        *_MODULE,
        "part",
        F.col("items")[0]["module_path"].alias("module_path"),
        F.size("items").alias("n_files"),
        F.array_join(
            F.transform("items", lambda i: F.concat(F.lit("- "), i["name"])), "\n"
        ).alias("file_list"),
        F.when(
            F.exists("items", lambda i: i["block"].isNotNull()),
            F.array_join(F.transform("items", lambda i: i["block"]), "\n"),
        ).alias("structure"),
    )
    # Where all modules have one part this grouping reuses the exchange before it.
    parts = F.sort_array(
        F.collect_list(F.struct("part", "module_path", "n_files", "file_list", "structure"))
    )
    listed = listed.groupBy(*_MODULE).agg(parts.alias("parts")).select(
        *_MODULE,
        F.lit(0).alias("part"),
        F.col("parts")[0]["module_path"].alias("module_path"),
        F.aggregate("parts", F.lit(0), lambda n, p: n + p["n_files"]).alias("n_files"),
        F.array_join(F.transform("parts", lambda p: p["file_list"]), "\n").alias("file_list"),
        F.array_join(F.transform("parts", lambda p: p["structure"]), "\n").alias("structure"),
    )
    module, path = F.col("module"), F.col("module_path")
    prompts = listed.select(
        *_MODULE,
        "part",
        "module_path",
        "n_files",
        prompt_text(module, path, F.col("file_list"), F.col("structure")).alias("prompt"),
        fallback_text(module, path, F.col("file_list"), F.col("n_files")).alias("fallback"),
    )
    return prompts.withColumn("prompt_hash", F.sha2("prompt", 256))


class _PromptDigest:
    """SHA-256 of one prompt whose lines arrive in order, and its list of files."""

    def __init__(self, repo, module, module_path):
        self.key, self.module_path, self.n_files = (repo, module), module_path, 0
        self.files, self.section, self.empty = bytearray(), 0, True
        head = PROMPT_HEAD + _TO_MODULE + (module or "") + _TO_PATH + (module_path or "") + _TO_FILES
        self.digest = hashlib.sha256(head.encode())

    def add(self, section: int, lines: list) -> None:
        if section != self.section:
            self.digest.update(_TO_STRUCTURE.encode())
            self.section, self.empty = section, True
        if section == 0:
            self.n_files += len(lines)
        lines = [line for line in lines if line is not None]
        if lines:
            data = ("" if self.empty else "\n").encode() + "\n".join(lines).encode()
            self.empty = False
            self.digest.update(data)
            if section == 0:
                self.files += data

    def row(self) -> tuple:
        self.add(1, [])
        self.digest.update(_PROMPT_END.encode())
        whole = self.key[1] is not None and self.module_path is not None
        digest = self.digest.hexdigest() if whole else None
        return *self.key, self.module_path, self.n_files, self.files.decode(), digest


def _digest_prompts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a module out of its sorted lines; keeps one digest and one list of files."""
    columns = {
        "repo": pa.string(), "module": pa.string(), "module_path": pa.string(),
        "n_files": pa.int32(), "file_list": pa.string(), "prompt_hash": pa.string(),
    }

    def out(digest):
        arrays = [pa.array([v], kind) for v, kind in zip(digest.row(), columns.values())]
        return pa.RecordBatch.from_arrays(arrays, list(columns))

    digest = None
    for batch in batches:
        repos, modules, paths, sections, lines = (
            batch.column(c).to_pylist() for c in ("repo", "module", "module_path", "section", "line")
        )
        at, n = 0, batch.num_rows
        while at < n:
            end, key = at + 1, (repos[at], modules[at])
            while end < n and sections[end] == sections[at] and (repos[end], modules[end]) == key:
                end += 1
            if digest is None or digest.key != key:
                if digest is not None:
                    yield out(digest)
                digest = _PromptDigest(*key, paths[at])
            digest.add(sections[at], lines[at:end])
            at = end
    if digest is not None:
        yield out(digest)


def prompt_hashes(run_files: DataFrame, structures: DataFrame) -> DataFrame:
    """``module_prompts`` without the texts.

    The lines of a prompt are sorted and stream through its digest, so a prompt of any length is
    in no task as a whole.
    """
    rows = run_files.select("repo", "path", "module", "module_path").join(
        structures.select("repo", "path", structure_text().alias("block")), ["repo", "path"], "left"
    )
    name = F.concat(F.lit("- "), paths.base_name(F.col("path")))
    # Names of all files stand before all structures.
    lines = rows.select(
        *_MODULE, "module_path", "path", F.posexplode(F.array(name, "block")).alias("section", "line")
    )
    digested = (
        lines.repartition(*_MODULE)
        .sortWithinPartitions(*_MODULE, "section", "path", "line")
        .select(*_MODULE, "module_path", "section", "line")
        .mapInArrow(
            _digest_prompts,
            "repo string, module string, module_path string, n_files int, file_list string, "
            "prompt_hash string",
        )
    )
    module, path = F.col("module"), F.col("module_path")
    return digested.select(
        *_MODULE,
        F.lit(0).alias("part"),
        "module_path",
        "n_files",
        fallback_text(module, path, F.col("file_list"), F.col("n_files")).alias("fallback"),
        "prompt_hash",
    )


def related_lines(edges: DataFrame, run_modules: DataFrame) -> DataFrame:
    """(repo, module, block, item, line): the related-modules section as sortable lines.

    Blocks: 0 heading, 1-3 dependencies, 4-6 dependents, 7-8 the line for "none".
    """
    sides = related(edges, run_modules).where(F.col("other").isNotNull())
    base = F.when(F.col("side") == "depends_on", F.lit(1)).otherwise(F.lit(4))
    links = sides.select(
        *_MODULE,
        (base + 1).alias("block"),
        F.col("other").alias("item"),
        text.link_line(
            F.col("other"), F.concat(F.lit("./"), paths.doc_file_name(F.col("other")))
        ).alias("line"),
    )

    def fixed(df, *rows):
        structs = [
            F.struct(block.alias("block"), F.lit(item).alias("item"), line.alias("line"))
            for block, item, line in rows
        ]
        return df.select(*_MODULE, F.explode(F.array(*structs)).alias("r")).select(
            *_MODULE, "r.*"
        )

    lit = F.lit
    present = sides.select(*_MODULE, "side").distinct()
    label = F.when(F.col("side") == "depends_on", lit("**Depends on**:")).otherwise(
        lit("**Depended by**:")
    )
    frames = fixed(present, (base, "", label), (base + 2, "", lit("")))
    modules = run_modules.select(*_MODULE).distinct()
    heading = fixed(
        modules,
        *[
            (lit(0), str(i), lit(line))
            for i, line in enumerate(("", "---", "", "## Related Modules", ""))
        ],
    )
    lonely = fixed(
        modules.join(present.select(*_MODULE).distinct(), _MODULE, "left_anti"),
        (lit(7), "", lit("*No direct module dependencies detected.*")),
        (lit(8), "", lit("")),
    )
    return heading.unionByName(frames).unionByName(links).unionByName(lonely)


def related_sections(edges: DataFrame, run_modules: DataFrame, budget: int = PART_BYTES) -> DataFrame:
    return ordered_text(
        related_lines(edges, run_modules),
        _MODULE,
        ["block", "item"],
        F.col("line"),
        "\n",
        budget=budget,
    )


def summaries(prompts: DataFrame, completions: DataFrame) -> DataFrame:
    """Completion of each prompt without its fences, or the fallback document."""
    found = completions.select("repo", "prompt_hash", F.col("text").alias("completion"))
    return prompts.join(found, ["repo", "prompt_hash"], "left").withColumn(
        "summary", F.coalesce(text.strip_fences(F.col("completion")), F.col("fallback"))
    )


def module_docs(
    prompts: DataFrame,
    completions: DataFrame,
    combined: DataFrame,
    related_parts: DataFrame,
    run_ts: Column,
) -> DataFrame:
    """module_docs(repo, module, doc_file, part, content): summary, footer, related.

    Nearly every document is one part. Parts of a long one follow each other: those of
    the summary, then those of the related section, which starts on the last of them.
    """
    n_parts = F.max("part").over(W.partitionBy(*_MODULE)) + 1
    body = (
        summaries(prompts, completions)
        .join(combined, _MODULE)
        .withColumn("n_parts", n_parts)
        .withColumn(
            "body",
            F.concat(
                "summary",
                F.when(
                    F.col("part") == F.col("n_parts") - 1,
                    text.metadata_footer(run_ts, F.col("combined_hash")),
                ).otherwise(F.lit("")),
            ),
        )
        .select(*_MODULE, "part", "n_parts", "body")
    )
    ends = body.where(F.col("part") == 0).select(*_MODULE, "n_parts")
    tail = related_parts.join(ends, _MODULE).select(
        *_MODULE,
        (F.col("part") + F.col("n_parts") - 1).alias("part"),
        F.col("text").alias("tail"),
    )
    return (
        body.join(tail, [*_MODULE, "part"], "full_outer")
        .select(
            *_MODULE,
            paths.doc_file_name(F.col("module")).alias("doc_file"),
            "part",
            F.concat(F.coalesce("body", F.lit("")), F.coalesce("tail", F.lit(""))).alias("content"),
        )
    )


def merge_docs(saved_docs: DataFrame, new_docs: DataFrame) -> DataFrame:
    """New documents replace those of their modules; other saved ones stay."""
    run_modules = new_docs.select(*_MODULE).distinct()
    return new_docs.unionByName(saved_docs.join(run_modules, _MODULE, "left_anti"))


def visible_docs(docs: DataFrame) -> DataFrame:
    """One document per file name: of modules that share a name the last one is kept."""
    owner = docs.groupBy("repo", "doc_file").agg(F.max("module").alias("module"))
    return docs.join(owner, ["repo", "doc_file", "module"], "left_semi")


def doc_name_clashes(docs: DataFrame) -> DataFrame:
    """File names that several modules share."""
    return (
        docs.select("repo", "doc_file", "module")
        .distinct()
        .groupBy("repo", "doc_file")
        .agg(F.count(F.lit(1)).alias("n_modules"))
        .where(F.col("n_modules") > 1)
    )


def doc_markers(docs: DataFrame) -> DataFrame:
    """Purpose, consumes and produces per document: the last such line of all its parts."""

    def last(marker, name):
        lines = F.filter(F.split("content", "\n"), lambda line: line.startswith(marker))
        value = F.when(F.size(lines) > 0, text.last_marker(F.col("content"), marker))
        return F.coalesce(
            F.max_by(value, F.when(value.isNotNull(), F.col("part"))), F.lit("")
        ).alias(name)

    return docs.groupBy("repo", "doc_file").agg(
        last(text.PURPOSE, "purpose"),
        last(text.CONSUMES, "consumes"),
        last(text.PRODUCES, "produces"),
    )


def last_marker_lines(docs: DataFrame, marker: str) -> DataFrame:
    """Relational form: one row per line, the one with the highest number wins."""
    lines = docs.select(
        "repo", "doc_file", F.posexplode(F.split("content", "\n")).alias("line_no", "line")
    ).where(F.col("line").startswith(marker))
    return lines.groupBy("repo", "doc_file").agg(
        F.max_by(
            text.strip(F.replace("line", F.lit(marker), F.lit(""))), F.col("line_no")
        ).alias("value")
    )


# The headings.
OVERVIEW_HEAD = (
    "# Code Map Overview",
    "",
    "How the modules of this code base fit together, drawn up from their own documents.",
    "",
    "## Module Dependency Graph",
    "",
)


def overview_lines(docs: DataFrame) -> DataFrame:
    """(repo, block, category, place, doc_file, line): an overview as sortable lines."""
    name = paths.doc_display_name(F.col("doc_file"))
    info = doc_markers(visible_docs(docs)).select(
        "repo",
        "doc_file",
        name.alias("name"),
        text.category_title(name).alias("category"),
        "purpose",
        "consumes",
        "produces",
    )
    flow = F.concat_ws(
        " | ",
        F.when(F.col("consumes") != "", F.concat(F.lit("consumes: "), F.col("consumes"))),
        F.when(F.col("produces") != "", F.concat(F.lit("produces: "), F.col("produces"))),
    )
    bullet = F.concat(
        F.lit("- `"),
        F.col("name"),
        F.lit("`"),
        F.when(flow != "", F.concat(F.lit(" → "), flow)).otherwise(F.lit("")),
    )
    link = F.concat(
        text.link_line(F.col("name"), F.concat(F.lit("modules/"), F.col("doc_file"))),
        F.lit(" – "),
        F.col("purpose"),
    )

    def row(block, category, place, doc_file, line):
        values = {
            "block": F.lit(block),
            "category": category,
            "place": F.lit(place),
            "doc_file": doc_file,
            "line": line,
        }
        return F.struct(*[v.alias(k) for k, v in values.items()])

    def exploded(df, *rows):
        return df.select("repo", F.explode(F.array(*rows)).alias("r")).select("repo", "r.*")

    none, category, doc = F.lit(""), F.col("category"), F.col("doc_file")
    per_doc = exploded(info, row(1, category, 2, doc, bullet), row(3, none, 0, doc, link))
    per_category = exploded(
        info.select("repo", "category").distinct(),
        row(1, category, 0, none, F.concat(F.lit("### "), category)),
        row(1, category, 1, none, none),
        row(1, category, 3, none, none),
    )
    per_repo = exploded(
        info.select("repo").distinct(),
        *[row(0, none, i, none, F.lit(line)) for i, line in enumerate(OVERVIEW_HEAD)],
        row(2, none, 0, none, F.lit("## Modules")),
        row(2, none, 1, none, none),
    )
    return per_repo.unionByName(per_category).unionByName(per_doc)


def overviews(docs: DataFrame, run_ts: Column, budget: int = PART_BYTES) -> DataFrame:
    """overviews(repo, part, content): one text per repository, in parts when long."""
    parts = ordered_text(
        overview_lines(docs),
        ["repo"],
        ["block", "category", "place", "doc_file"],
        F.col("line"),
        "\n",
        budget=budget,
    )
    last = F.col("part") == F.max("part").over(W.partitionBy("repo"))
    return parts.select(
        "repo",
        "part",
        F.concat(
            "text", F.when(last, text.metadata_footer(run_ts)).otherwise(F.lit(""))
        ).alias("content"),
    )


def overview_categories(docs: DataFrame, budget: int = PART_BYTES) -> DataFrame:
    """Documents per category, names in file order."""
    name = paths.doc_display_name(F.col("doc_file"))
    rows = visible_docs(docs).select(
        "repo", "doc_file", name.alias("name"), text.category_title(name).alias("category")
    ).distinct()
    return ordered_items(rows, ["repo", "category"], ["doc_file"], F.col("name"), budget=budget)
