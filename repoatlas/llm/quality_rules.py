"""Line-first cleaning: rules on each line, then on what a document loses by them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoatlas.llm.common import GAP, word_array

# A document goes if lines with more than this share of its word characters go.
MOST_LOST = 0.5
MIN_WORDS = 50
WINDOW = 3
# Bits for the place of a window in its text.
PLACE_BITS = 30
SYMBOLS = r"[#*$%&|<>]"
# Lines that are nothing but an item of navigation, and short lines of boilerplate.
NAVIGATION = (
    r"(?i)^\W*(home|menu|log ?in|sign (in|up)|next|previous|back( to top)?|skip to content|"
    r"read more|share( this)?|subscribe|contact( us)?|about( us)?)\W*$"
)
BOILERPLATE = (
    r"(?i)(all rights reserved|terms of (use|service)|privacy policy|accept (all )?cookies|"
    r"enable javascript|lorem ipsum|click here)"
)
NAVIGATION_CHARS, BOILERPLATE_CHARS, SHORT_CHARS = 60, 300, 80
ENDS = r"[.!?…:;,\"'”»)\]]\s*$"
LOWER, UPPER = "[a-zß-öø-ÿ]", "[A-ZÀ-ÖØ-Þ]"


def _count(text: Column, pattern: str) -> Column:
    """Characters that a negated character class leaves."""
    return F.char_length(F.regexp_replace(text, pattern, ""))


def line_fails(line: Column) -> Column:
    """Whether a line with a word goes: symbols, shouting, navigation or boilerplate.

    Cheap tests come first in each rule; few lines get past them.
    """
    words, chars = F.size(word_array(line)), F.char_length(line)
    marks = _count(line, "[^!]+")
    return (
        (line.rlike(SYMBOLS) & (3 * _count(line, "[^" + SYMBOLS[1:] + "+") > words))
        | (line.contains("!!") & (marks >= 3) & (2 * marks > words))
        | (~line.rlike(LOWER) & (_count(line, "[^" + UPPER[1:] + "+") >= 10))
        | ((chars <= SHORT_CHARS) & ~line.rlike(ENDS) & (words < 4))
        | ((chars <= NAVIGATION_CHARS) & line.rlike(NAVIGATION))
        | ((chars <= BOILERPLATE_CHARS) & line.rlike(BOILERPLATE))
    )


def _has_word(line: Column) -> Column:
    return line.rlike("[^" + GAP[1:-1])


def judged(docs: DataFrame) -> DataFrame:
    """The documents with a struct ``_rules``: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, clean_text. A column of that name is in the way: see
    ``judged_rows``.

    Row-local throughout: nothing is shuffled, so hot sources and copies change nothing.
    Null and empty texts have no words, fail the base rules and are not kept. Lines without
    a word stay as they are. Null doc_ids and repeated rows are judged row by row; all
    columns pass through.
    """
    return judged_rows(docs).select("_row.*", "_rules")


def judged_rows(docs: DataFrame) -> DataFrame:
    """``_row``, a struct of all columns, and ``_rules`` as ``judged`` gives them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"),
        word_array(text).alias("_words"),
        F.split(text, "\n").alias("_all_lines"),
        _count(text, "[^" + SYMBOLS[1:] + "+").cast("long").alias("_n_symbols"),
    )
    n = F.size("_words")

    def window(i):
        return [F.get("_words", i + k) for k in range(WINDOW)]

    # Windows whose hash occurs again, found by sorting numbers: 34 bits of the hash, then
    # the place. A superset of the repeated windows; the words decide below.
    marks = F.transform(
        F.slice("_words", F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))),
        lambda w, i: F.shiftleft(
            F.xxhash64(w, *window(i)[1:]).bitwiseAND(F.lit((1 << 34) - 1)), PLACE_BITS
        ).bitwiseOR(i.cast("long")),
    )
    rows = rows.select(
        "_row",
        "_all_lines",
        "_words",
        "_n_symbols",
        n.cast("long").alias("_n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("_word_chars"),
        F.filter("_all_lines", _has_word).alias("_lines"),
        marks.alias("_marks"),
    )
    rows = rows.withColumn("_marks", F.sort_array("_marks"))

    def code(mark):
        return F.shiftrightunsigned(mark, PLACE_BITS)

    again = F.filter(
        "_marks",
        lambda m, k: (code(m) == code(F.get("_marks", k - 1)))
        | (code(m) == code(F.get("_marks", k + 1))),
    )
    rows = rows.select(
        "*",
        F.transform(
            again, lambda m: m.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
        ).alias("_candidates"),
        F.filter("_lines", line_fails).alias("_failed"),
    ).drop("_marks")
    placed = F.transform(
        "_candidates", lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("s"), i.alias("i"))
    )
    rows = rows.withColumn("_placed", F.sort_array(placed)).drop("_words", "_candidates")
    repeated = F.transform(
        "_placed",
        lambda e, k: F.when(
            (e.s == F.get("_placed", k - 1).s) | (e.s == F.get("_placed", k + 1).s), e.i
        ),
    )
    rows = rows.withColumn("_starts", F.sort_array(F.array_compact(repeated))).drop("_placed")
    new_words = F.transform(
        "_starts",
        lambda p, k: F.least(F.lit(WINDOW), p - F.coalesce(F.get("_starts", k - 1), p - WINDOW)),
    )
    covered = F.aggregate(new_words, F.lit(0), lambda a, x: a + x).cast("long")
    lost_words = word_array(F.array_join("_failed", " "))
    lost = F.when(F.size("_failed") > 0, F.char_length(F.array_join(lost_words, ""))).otherwise(0)
    rows = rows.select("*", covered.alias("_repeat_words"), lost.alias("_lost"))
    # The partition number keeps the optimizer from moving a filter on the verdict below the
    # projections, which would put each of them into the next one's lambda functions.
    here = F.spark_partition_id() >= 0
    base_failed = (F.col("_n_words") < MIN_WORDS) | (
        100 * F.col("_repeat_words") > 50 * F.col("_n_words")
    )
    clean = F.when(
        F.size("_failed") > 0,
        F.array_join(F.filter("_all_lines", lambda x: ~_has_word(x) | ~line_fails(x)), "\n"),
    ).otherwise(F.array_join("_all_lines", "\n"))
    return rows.select(
        "_row",
        F.struct(
            F.col("_n_words").alias("n_words"),
            F.col("_word_chars").alias("word_chars"),
            F.col("_n_symbols").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.col("_repeat_words").alias("n_repeat_words"),
            base_failed.alias("base_failed"),
            (here & ~base_failed & (F.col("_lost") <= MOST_LOST * F.col("_word_chars"))).alias("kept"),
            clean.alias("clean_text"),
        ).alias("_rules"),
    )


def clean_documents(docs: DataFrame) -> DataFrame:
    """The kept documents without the lines that fail; ``n_chars``, where there is one, follows."""
    kept = judged_rows(docs).where("_rules.kept")
    text = F.col("_rules.clean_text")
    given = {c: F.col(f"_row.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        given["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType)
    return kept.select(*(v.alias(c) for c, v in given.items()))
