"""Path expressions: relative paths, modules, languages, document file names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT_MODULE = "root"

# A name's last suffix: a dot that neither starts nor ends the name.
_LAST_SUFFIX = r"(?<=[^/])(\.[^./]+)\z"


def relative_path(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(
        path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))
    )


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """Directory part, or null for a file at the root."""
    return F.when(
        path.contains("/"), F.substring(path, F.lit(1), F.length(path) - F.length(base_name(path)) - 1)
    )


def suffix(path: Column) -> Column:
    return F.regexp_extract(path, _LAST_SUFFIX, 1)


def without_suffix(path: Column) -> Column:
    return F.regexp_replace(path, _LAST_SUFFIX, "")


def module_name(path: Column, strategy: str = "directory", depth: int = 2) -> Column:
    if strategy == "file":
        return without_suffix(path)
    parent = F.coalesce(parent_dir(path), F.lit(ROOT_MODULE))
    if strategy != "directory":
        return parent
    parts = F.split(path, "/")
    return F.when(
        F.size(parts) > depth, F.array_join(F.slice(parts, 1, depth), "/")
    ).otherwise(parent)


def module_path(path: Column, strategy: str = "directory", depth: int = 2) -> Column:
    """Directory of the module, relative to the root; '.' is the root itself."""
    parent = F.coalesce(parent_dir(path), F.lit("."))
    if strategy != "directory":
        return parent
    parts = F.split(path, "/")
    return F.when(
        F.size(parts) > depth, F.array_join(F.slice(parts, 1, depth), "/")
    ).otherwise(parent)


def normalize_import(importing_path: Column, name: Column) -> Column:
    """Path that ``name`` denotes from the directory of ``importing_path``.

    Null for absolute names and for paths that climb above the root.
    """
    parent = parent_dir(importing_path)
    joined = F.concat_ws("/", parent, name)

    def step(stack, part):
        return (
            F.when(stack.isNull() | part.isin("", "."), stack)
            .when(part != "..", F.concat(stack, F.array(part)))
            .when(F.size(stack) == 0, F.lit(None))
            .otherwise(F.slice(stack, F.lit(1), F.size(stack) - 1))
        )

    folded = F.aggregate(
        F.split(joined, "/"), F.array().cast("array<string>"), step
    )
    # Steps up stand at the start of nearly every name: they take folders off the parent's end.
    up = F.coalesce(F.length(F.regexp_extract(name, r"\A(?:\.\./)++", 0)), F.lit(0))
    rest = F.when(name.startswith("../"), F.substring(name, up + 1, F.length(name))).otherwise(name)
    slashes = F.length(parent) - F.length(F.replace(parent, F.lit("/"), F.lit("")))
    left = F.coalesce(slashes + 1, F.lit(0)) - (up / 3).cast("int")
    above = F.when(left > 0, F.call_function("substring_index", parent, F.lit("/"), left))
    return (
        F.when(name.startswith("/"), F.lit(None))
        .when(
            ~F.concat_ws("/", parent, rest).rlike(r"(?:\A|/)\.{0,2}(?:/|\z)"),
            F.when(left >= 0, F.concat_ws("/", above, rest)),
        )
        .otherwise(F.array_join(folded, "/"))
    )


def doc_file_name(module: Column) -> Column:
    """File name of a module's document. Not injective: a/b and a_b share one."""
    return F.concat(F.translate(module, "/\\", "__"), F.lit(".md"))


def doc_display_name(doc_file: Column) -> Column:
    return F.translate(F.regexp_replace(doc_file, r"\.md\z", ""), "_", "/")
