"""Text, hash and date expressions used by hashing and by the documents."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoatlas import TOOL_NAME, __version__

# The characters that count as blank at the ends of a text.
_BLANK = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# The line labels of a module document.
PURPOSE, CONSUMES, PRODUCES = "**Purpose**:", "**Consumes**:", "**Produces**:"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{_BLANK}++|{_BLANK}++\z", "")


def valid_text(content: Column) -> Column:
    """Bytes as text; bad bytes become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def short_hash(digest: Column) -> Column:
    return F.substring(digest, 1, 7)


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def run_timestamp(ts: Column) -> Column:
    """ISO time with a Z; the fraction is left out when it is zero."""
    return F.concat(
        iso_seconds(ts),
        F.when(F.date_format(ts, "SSSSSS") == "000000", F.lit("")).otherwise(
            F.date_format(ts, ".SSSSSS")
        ),
        F.lit("Z"),
    )


def metadata_footer(generated_at: Column, digest: Column | None = None) -> Column:
    parts = [F.concat(F.lit("Generated: "), iso_seconds(generated_at))]
    if digest is not None:
        parts.append(
            F.when(digest != "", F.concat(F.lit("Source hash: "), short_hash(digest)))
        )
    parts.append(F.lit(f"{TOOL_NAME} v{__version__}"))
    return F.concat(F.lit("\n---\n*"), F.concat_ws(" | ", *parts), F.lit("*\n"))


def title_case(text: Column) -> Column:
    """Capital after every non-letter, lower case elsewhere."""
    return F.array_join(
        F.transform(
            F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), F.initcap
        ),
        "",
    )


def category_title(display_name: Column) -> Column:
    return F.when(
        display_name.contains("/"), title_case(F.substring_index(display_name, "/", 1))
    ).otherwise(F.lit("Core"))


def strip_fences(text: Column) -> Column:
    fence = "```"
    for opening in (fence + "markdown", fence):
        text = F.when(
            text.startswith(opening),
            strip(F.substring(text, F.lit(len(opening) + 1), F.length(text))),
        ).otherwise(text)
    return F.when(
        text.endswith(fence), strip(F.substring(text, F.lit(1), F.length(text) - len(fence)))
    ).otherwise(text)


def last_marker(content: Column, marker: str) -> Column:
    """Value of the last line that starts with the marker, or ''."""
    lines = F.filter(F.split(content, "\n"), lambda line: line.startswith(marker))
    return F.coalesce(
        strip(F.replace(F.try_element_at(lines, F.lit(-1)), F.lit(marker), F.lit(""))),
        F.lit(""),
    )


def link_line(label: Column, target: Column) -> Column:
    return F.concat(F.lit("- ["), label, F.lit("]("), target, F.lit(")"))


def preview(items: Column, limit: int, more: str) -> Column:
    """First items joined by commas, with a tail when some are left out."""
    return F.concat(
        F.array_join(F.slice(items, 1, limit), ", "),
        F.when(F.size(items) > limit, F.lit(more)).otherwise(F.lit("")),
    )
