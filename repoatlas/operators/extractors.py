"""Registry of languages: which suffixes a language has and how facts are extracted."""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoatlas.functions import cpp_text, paths, text
from repoatlas.operators.symbols import symbol_rows
from repoatlas.settings import CPP_SUFFIXES


@dataclass(frozen=True)
class Extractor:
    """How facts of a language are read.

    ``row_imports`` maps a text to an array of (name, is_system), ``row_symbols`` to an array of
    ``symbols.RECORD``; both are expressions, also pandas UDFs, so that one scan serves all
    languages. ``lexes``: symbols come from the scan for the C family. For facts that a row
    alone does not give, ``imports`` and ``symbols`` map source_files to imports and symbol
    rows; each reads the content of its language once more.
    """

    language: str
    suffixes: tuple
    imports: Callable[[DataFrame], DataFrame] | None = None
    symbols: Callable[[DataFrame], DataFrame] | None = None
    row_imports: Callable[[Column], Column] | None = None
    row_symbols: Callable[[Column], Column] | None = None
    lexes: bool = False

    @property
    def row_local(self) -> bool:
        """Whether one scan can read everything."""
        return (self.imports is None or self.row_imports is not None) and (
            self.symbols is None or self.row_symbols is not None or self.lexes
        )


def html_links(content_text: Column) -> Column:
    """Values of href attributes in text order; absolute URLs count as system."""
    return F.transform(
        F.regexp_extract_all(content_text, F.lit('href="([^"]*)"'), F.lit(1)),
        lambda n: F.struct(n.alias("name"), n.rlike(r"\A[a-z]+://").alias("is_system")),
    )


def cpp_includes(content_text: Column) -> Column:
    return cpp_text.include_names(cpp_text.include_texts(content_text))


CPP = Extractor("cpp", CPP_SUFFIXES, symbols=symbol_rows, row_imports=cpp_includes, lexes=True)
HTML = Extractor("html", (".html", ".htm"), row_imports=html_links)

IMPORTS = "array<struct<name:string,is_system:boolean>>"


class Registry:
    def __init__(self, *extractors: Extractor):
        self._by_language = {}
        for extractor in extractors:
            self.register(extractor)

    def register(self, extractor: Extractor) -> None:
        self._by_language[extractor.language] = extractor

    def __iter__(self):
        return iter(self._by_language.values())

    def language(self, path: Column) -> Column:
        """Language by the last suffix in lower case; the first registered one wins."""
        suffix = F.lower(paths.suffix(path))
        out = F.lit(None).cast("string")
        for extractor in reversed(self._by_language.values()):
            out = F.when(
                suffix.isin(*extractor.suffixes), F.lit(extractor.language)
            ).otherwise(out)
        return out

    def imports(self, files: DataFrame, default: str | None = None) -> DataFrame:
        """Imports of all registered languages; ``default`` is for unknown suffixes.

        Languages that read them from a row share one scan.
        """
        language = F.coalesce(self.language(F.col("path")), F.lit(default))
        content = text.valid_text(F.col("content"))
        found, outs = F.lit(None).cast(IMPORTS), []
        for e in self:
            if e.row_imports:
                found = F.when(language == e.language, e.row_imports(content)).otherwise(found)
            elif e.imports:
                own = e.imports(files.where(language == e.language))
                outs.append(own.withColumn("language", F.lit(e.language)))
        # Exploded where it is worked out: a column of lists would be filtered by their size first,
        # out of the content once more.
        shared = files.select(
            "repo", "path", language.alias("language"), F.posexplode(found).alias("ordinal", "i")
        )
        shared = shared.select("repo", "path", "ordinal", "i.name", "i.is_system", "language")
        return reduce(DataFrame.unionByName, outs, shared)

    def symbols(self, files: DataFrame, default: str | None = None) -> DataFrame:
        """Symbol rows of the languages that give them as tables."""
        language = F.coalesce(self.language(F.col("path")), F.lit(default))
        outs = [
            e.symbols(files.where(language == e.language)).withColumn("language", F.lit(e.language))
            for e in self
            if e.symbols
        ]
        return reduce(DataFrame.unionByName, outs)


def default_registry() -> Registry:
    return Registry(CPP, HTML)
