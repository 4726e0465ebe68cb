"""Nested file structures and their text summaries."""

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoatlas.functions import paths, text
from repoatlas.operators.extractors import CPP, IMPORTS, Extractor, Registry
from repoatlas.operators.file_scan import packed_segments, structure_rows
from repoatlas.operators.symbols import RECORD

_FILE = ["repo", "path"]
_FIELDS = dict(field.split(":") for field in RECORD.removeprefix("struct<")[:-1].split(","))


def registry_structures(
    files: DataFrame, registry: Registry, segments: DataFrame | None = None
) -> DataFrame:
    """``file_structures`` of every registered language, with ``file_hash``.

    One read of the content serves all languages whose facts come from a row, or none where
    their ``segments`` were read before; other languages add reads of their own files.
    """
    language = registry.language(F.col("path"))
    shared = row_local(registry)
    frames = []
    if shared:
        read = fact_segments(files, language, shared) if segments is None else segments
        frames.append(structures_of(read, any(e.row_symbols for e in shared)))
    for e in registry:
        if e not in shared:
            frames.append(_from_tables(files.where(language == e.language), e))
    return reduce(DataFrame.unionByName, frames)


def row_local(registry: Registry) -> list[Extractor]:
    return [e for e in registry if e.row_local]


def file_structures(files: DataFrame, language: str = "cpp") -> DataFrame:
    """repo, path, language, imports, classes (with methods), functions; one row a file.

    Includes and symbols come from one read of the content. Lists are as long as one file
    declares.
    """
    own = replace(CPP, language=language)
    return structures_of(fact_segments(files, F.lit(language), [own]), False).drop("file_hash")


def fact_segments(
    files: DataFrame, language: Column, extractors: list[Extractor], every: bool = False
) -> DataFrame:
    """Packed segments of the files, headed by language, hash, imports and symbols of other
    languages: all that is read from the content, row by row.

    Files of other languages are left out, or with ``every`` kept with their hash alone.
    """
    content = F.coalesce(text.valid_text(F.col("content")), F.lit(""))
    imports, others = F.lit(None).cast(IMPORTS), F.lit(None).cast(f"array<{RECORD}>")
    for e in extractors:
        mine = F.col("language") == e.language
        if e.row_imports and not e.lexes:
            imports = F.when(mine, e.row_imports(content)).otherwise(imports)
        if e.row_symbols:
            others = F.when(mine, e.row_symbols(content)).otherwise(others)
    known = files.withColumn("language", language)
    if not every:
        known = known.where(F.col("language").isin(*(e.language for e in extractors)))
    head = F.struct(
        "language",
        text.content_hash(F.col("content")).alias("file_hash"),
        imports.alias("imports"),
        others.alias("symbols"),
    )
    code = F.coalesce(F.col("language").isin(*(e.language for e in extractors if e.lexes)), F.lit(False))
    rows = packed_segments(known, head, code)
    # Includes of the C family come out of the scan.
    lexed = F.col("head.language").isin(*(e.language for e in extractors if e.lexes))
    both = F.when(lexed, F.col("includes")).otherwise(F.col("head.imports"))
    return rows.withColumn("head", F.col("head").withField("imports", both)).drop("includes")


def structures_of(segments: DataFrame, others: bool = True) -> DataFrame:
    """``file_structures`` with the file's hash, out of ``fact_segments``."""
    return structure_rows(segments, others).select(
        *_FILE,
        "head.language",
        "head.file_hash",
        F.coalesce("head.imports", F.array().cast(IMPORTS)).alias("imports"),
        "classes",
        "functions",
    )


def _from_tables(files: DataFrame, extractor: Extractor) -> DataFrame:
    """Structures of an extractor that maps tables to tables."""
    heads = files.select(
        *_FILE,
        F.lit("file").alias("record"),
        F.struct(
            F.lit(extractor.language).alias("language"),
            text.content_hash(F.col("content")).alias("file_hash"),
        ).alias("head"),
    )
    if extractor.imports:
        found = extractor.imports(files)
    else:
        names = F.lit(None).cast(IMPORTS)
        if extractor.row_imports:
            names = extractor.row_imports(text.valid_text(F.col("content")))
        found = files.select(*_FILE, F.posexplode(names).alias("ordinal", "i")).select(
            *_FILE, "ordinal", "i.*"
        )
    in_order = F.array_sort(F.collect_list(F.struct("ordinal", "name", "is_system")))
    names = F.transform(
        in_order, lambda f: F.struct(f["name"].alias("name"), f["is_system"].alias("is_system"))
    )
    listed = found.groupBy(*_FILE).agg(names.alias("imports"))
    heads = heads.join(listed, _FILE, "left").select(
        *_FILE, "record", F.col("head").withField("imports", F.col("imports")).alias("head")
    )
    blank = {n: F.lit(None).cast(kind) for n, kind in _FIELDS.items() if n != "record"}
    heads = heads.withColumns(blank)
    if extractor.symbols is None:
        return _gathered(heads)
    rows = extractor.symbols(files)
    rows = rows.select(*_FILE, *(F.col(n).cast(kind).alias(n) for n, kind in _FIELDS.items()))
    return _gathered(heads.unionByName(rows, allowMissingColumns=True))


def _gathered(rows: DataFrame) -> DataFrame:
    """One row a file out of its records. Rows that arrive hashed by (repo, path) stay so."""

    def fields(*names):
        return F.struct(*[F.col(n) for n in names])

    function = fields("position", "name", "signature", "line_start", "line_end", "visibility")
    per_class = (
        rows.groupBy(*_FILE, "class_id")
        .agg(
            F.max(
                F.when(F.col("record") == "class", fields("kind", "name", "line_start", "line_end"))
            ).alias("c"),
            F.array_sort(F.collect_list(F.when(F.col("record") == "method", function))).alias(
                "methods"
            ),
            F.array_sort(F.collect_list(F.when(F.col("record") == "function", function))).alias(
                "functions"
            ),
            F.first(F.when(F.col("record") == "file", F.col("head")), ignorenulls=True).alias("head"),
        )
    )
    # All classes come before all structs.
    cls = F.when(
        F.col("c").isNotNull(),
        F.struct(
            F.col("c.kind").alias("kind"),
            F.col("class_id"),
            F.col("c.name").alias("name"),
            F.col("c.line_start").alias("line_start"),
            F.col("c.line_end").alias("line_end"),
            F.col("methods"),
        ),
    )
    return per_class.groupBy(*_FILE).agg(
        F.array_sort(F.collect_list(cls)).alias("classes"),
        F.flatten(F.collect_list("functions")).alias("functions"),
        F.first("head", ignorenulls=True).alias("head"),
    ).select(
        *_FILE,
        "head.language",
        "head.file_hash",
        F.coalesce("head.imports", F.array().cast(IMPORTS)).alias("imports"),
        "classes",
        "functions",
    )


def with_visibility(items: Column, *levels: str) -> Column:
    return F.filter(items, lambda f: f["visibility"].isin(*levels))


def internal_items(items: Column) -> Column:
    """Protected ones first, then private and unknown ones."""
    return F.concat(
        with_visibility(items, "protected"),
        F.filter(items, lambda f: ~f["visibility"].isin("public", "protected")),
    )


def internal_summary(items: Column, limit: int = 6) -> Column:
    """Count and first names of the non-public items, or null if there are none."""
    names = F.transform(internal_items(items), lambda f: f["name"])
    return F.when(
        F.size(names) > 0,
        F.concat(
            F.lit("    Internal ("),
            F.size(names).cast("string"),
            F.lit(" total): "),
            text.preview(names, limit, ", ..."),
        ),
    )


def _lines(*parts) -> Column:
    """Array of lines out of optional lines (null: none) and arrays of lines."""
    return F.flatten(F.array_compact(F.array(*parts)))


def _line(value, cond=None) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    one = F.array(value)
    return F.when(value.isNotNull() if cond is None else cond, one)


def _signatures(items: Column, indent: str) -> Column:
    return F.transform(
        with_visibility(items, "public"),
        lambda f: F.concat(F.lit(f"{indent}- "), f["signature"]),
    )


def _include_line(label: str, names: Column, limit: int) -> Column:
    return _line(
        F.concat(
            F.lit(f"  {label} ("),
            F.size(names).cast("string"),
            F.lit("): "),
            text.preview(names, limit, "..."),
        ),
        F.size(names) > 0,
    )


def _class_lines(c: Column) -> Column:
    public = _signatures(c["methods"], "      ")
    return _lines(
        _line(
            F.concat(
                F.lit("  **"),
                c["name"],
                F.lit("** (lines "),
                c["line_start"].cast("string"),
                F.lit("-"),
                c["line_end"].cast("string"),
                F.lit(")"),
            )
        ),
        _line("    Public API:", F.size(public) > 0),
        public,
        _line(internal_summary(c["methods"])),
    )


def structure_text() -> Column:
    """Summary of one ``file_structures`` row."""
    imports, classes, functions = F.col("imports"), F.col("classes"), F.col("functions")

    def names(system):
        return F.transform(
            F.filter(imports, lambda i: i["is_system"] == F.lit(system)), lambda i: i["name"]
        )

    public = _signatures(functions, "  ")
    internal = internal_summary(functions)
    return F.array_join(
        _lines(
            _line(F.concat(F.lit("\n### "), paths.base_name(F.col("path")))),
            _line("\nDependencies:", F.size(imports) > 0),
            _include_line("System", names(True), 8),
            _include_line("Local", names(False), 10),
            _line("\nClasses/Structs:", F.size(classes) > 0),
            F.flatten(F.transform(classes, _class_lines)),
            _line("\nPublic Functions:", F.size(public) > 0),
            public,
            _line("\nInternal Functions:", internal.isNotNull()),
            _line(internal),
        ),
        "\n",
    )
