"""Small tables with the cases every operator has to bear."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside.
CLASH = (
    "size long, key double, fp long, token string, _row string, label int, chunk_no int, s string,"
    " _score double, _mix_key double, _mix_s string, take long, cut boolean, row string, slot long"
)


def rows():
    prose = " ".join(f"word{n % 97} and{n % 13} so on." for n in range(60))
    return [
        (1, prose, "en", "b", 1),
        (2, prose, "en", "b", 1),
        (2, prose, "en", "b", 1),
        (3, None, "en", "b", None),
        (4, "", None, None, 0),
        (None, "lonely row\x0bwith\x0cgaps", "en", None, 5),
        (5, " \t\n ", "de", "a", 4),
        (6, "short", "de", "a", 5),
        (7, "two words", "de", "é", 9),
        (8, "x" * 70_000 + " end", "de", "a", 1),
        (9, " ".join(f"w{n}" for n in range(30_000)), "fr", "c", 1),
        (10, "same same same same " * 40, "fr", "c", 1),
        (11, "ABC!! " * 80 + "\nHome\nAll rights reserved.\n" + prose, "fr", "c", 1),
        (12, prose + " changed", "fr", "c", 1),
        (13, "don't <|endoftext|>  two\n\n lines\x1c\x85 ́é 日本 1234 \U0001f642", "fr", "d", 1),
    ]


def documents(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


def clashing(spark):
    from pyspark.sql import functions as F

    frame = documents(spark)
    for field in CLASH.split(", "):
        name, kind = field.split()
        frame = frame.withColumn(name, F.lit(None if kind == "string" else 1).cast(kind))
    return frame


def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)
