"""Mixing sources to target weights by Efraimidis-Spirakis keys and word budgets."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoatlas.llm.common import GAP, bounded_broadcast, id_text, word_array, written

# Buckets of a histogram of keys, and how many times the bucket that holds the boundary is
# divided before the keys in it are sorted.
BUCKETS = 1024
LEVELS = 2


@dataclass(frozen=True)
class Mix:
    """Weights by position of a source in code-point order, repeating; null comes last."""

    weights: tuple = (3, 1, 2)
    share: float = 1.5  # of all sizes
    most: float = 2.0  # times a source's size
    seed: str = "mix"


def n_words(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def quality_weight(text: Column) -> Column:
    """Share of a text's characters that are not of ``#*$%&|<>``; one for null and empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.char_length(F.translate(text, "#*$%&|<>", ""))
    return (plain + 1) / (F.char_length(text) + 1)


def sampling_key(doc_id: Column, weight: Column, seed: str) -> Column:
    """An exponential key, -ln(u) / weight; u follows from the id, so reruns agree.

    Documents in ascending order of keys are a sample without replacement by weight.
    """
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_text(doc_id))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """source, source_size, target from (source, source_size): one row a source.

    The targets are min(most * size, level * weight). The level is the largest that any
    number of sources at their limit gives, which is what resharing the excess ends in.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("n", F.row_number().over(order) - 1)
    weight = F.element_at(
        F.array(*(F.lit(float(w)) for w in mix.weights)),
        (F.col("n") % len(mix.weights) + 1).cast("int"),
    )
    limit = F.col("source_size") * F.lit(mix.most)
    ranked = ranked.withColumn("w", weight).withColumn("limit", limit)
    by_ratio = Window.orderBy(F.col("limit") / F.col("w"), "n")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    full = F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    budget = F.sum("source_size").over(everything) * F.lit(mix.share)
    ranked = ranked.withColumn("level", (budget - full) / F.sum("w").over(after))
    target = F.least("limit", F.max("level").over(everything) * F.col("w"))
    return ranked.select("source", "source_size", target.alias("target"))


def boundaries(keyed: DataFrame, mix: Mix) -> DataFrame:
    """A row for each source: how often it is taken whole, and where its last pass ends.

    Columns: s (source), source_size, target, epochs, last_key (null: no last pass) and
    room, which each row at last_key gets at most. The words before a key come from
    histograms that all tasks build; only the keys of the finest bucket that holds the
    boundary are ordered, so a hot source is never sorted in one task.
    """
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, mix).withColumn("words", F.floor(F.col("target") + 0.5))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size")))
    plan = plan.withColumn("epochs", F.coalesce(whole, F.lit(0)).cast("long")).select(
        F.col("source").alias("s"),
        "source_size",
        "target",
        "epochs",
        (F.col("words") - F.col("epochs") * F.col("source_size")).cast("long").alias("rest"),
        F.lit(0).cast("long").alias("bucket"),
    )
    plan = bounded_broadcast(plan, "mix-plan")
    for level in range(1, LEVELS + 1):
        at = _boundary(_inside(keyed, plan, level - 1), _bucket(level))
        plan = plan.drop("bucket").join(at, F.col("s").eqNullSafe(F.col("b")), "left")
        plan = plan.withColumn("rest", F.coalesce("left", F.lit(0))).select(
            "s", "source_size", "target", "epochs", "rest", F.col("at").alias("bucket")
        )
        plan = bounded_broadcast(plan, "mix-plan")
    at = _boundary(_inside(keyed, plan, LEVELS), F.col("key"))
    plan = plan.join(at, F.col("s").eqNullSafe(F.col("b")), "left").select(
        "s",
        "source_size",
        "target",
        "epochs",
        F.col("at").alias("last_key"),
        F.floor(F.col("left") / F.col("rows")).cast("long").alias("room"),
    )
    return bounded_broadcast(plan, "mix-plan")


def _bucket(level: int) -> Column:
    """The key's place among BUCKETS ** level buckets, in ascending order of keys."""
    finest = float(BUCKETS**LEVELS)
    code = F.least(F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * finest), F.lit(int(finest) - 1))
    return F.floor(code / F.lit(BUCKETS ** (LEVELS - level))).cast("long")


def _inside(keyed: DataFrame, plan: DataFrame, level: int) -> DataFrame:
    """Rows of the bucket that holds their source's boundary."""
    same = F.col("source").eqNullSafe(F.col("s"))
    rows = keyed.join(plan.where("rest > 0").select("s", "rest", "bucket"), same)
    return rows.where(_bucket(level) == F.col("bucket")) if level else rows


def _boundary(inside: DataFrame, step: Column) -> DataFrame:
    """b (source), at: the step within which the words wanted are reached, left: the words
    still wanted there, rows: how many rows it has."""
    sums = inside.groupBy("s", step.alias("at")).agg(
        F.sum("size").alias("n"), F.count("*").alias("rows"), F.first("rest").alias("rest")
    )
    upto = F.sum("n").over(Window.partitionBy("s").orderBy("at"))
    return (
        sums.withColumn("upto", upto)
        .where("upto >= rest and upto - n < rest")
        .select(F.col("s").alias("b"), "at", F.expr("rest - (upto - n)").alias("left"), "rows")
    )


def _last_part(key: Column, size: Column) -> Column:
    """Words of the last, fractional pass."""
    return (
        F.when(key < F.col("last_key"), size)
        .when(key == F.col("last_key"), F.least(size, F.col("room")))
        .otherwise(0)
        .cast("long")
    )


def _keyed(docs: DataFrame, mix: Mix, size: Column, weight: Column) -> DataFrame:
    return docs.select(
        "doc_id",
        "source",
        size.cast("long").alias("size"),
        sampling_key(F.col("doc_id"), weight, mix.seed).alias("key"),
    )


def mix_plan(docs: DataFrame, mix: Mix, size: Column, weight: Column) -> DataFrame:
    """What the mix takes of each row: doc_id, size, source_size, target, taken.

    ``size`` and ``weight`` are expressions over the documents; weights lie in (0, 1].
    Complete passes over a source come first; the rest of its target is filled in order
    of the keys, and the row at the boundary gives only the words that are still wanted
    (rows that tie there share them). A null source is a source; null texts have no words
    and give none; a source without words has target zero. Null doc_ids and repeated rows
    share a key and are treated alike. Other columns are not read.
    """
    keyed = written(_keyed(docs, mix, size, weight), "mix-keys")
    plan = boundaries(keyed, mix)
    joined = keyed.join(plan, F.col("source").eqNullSafe(F.col("s")))
    part = _last_part(F.col("key"), F.col("size"))
    return joined.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + part).alias("taken"),
        "epochs",
        part.alias("last_part"),
    )


def mix_documents(docs: DataFrame, mix: Mix, size: Column, weight: Column) -> DataFrame:
    """The mixed rows: each document once for each pass that takes it, all columns kept.

    The row at the boundary of the last pass is cut to its first words that are wanted,
    and ``n_chars``, where there is one, follows. Text is never shuffled: the plan of the
    sources is all that the rows meet.
    """
    plan = boundaries(written(_keyed(docs, mix, size, weight), "mix-keys"), mix)
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("source"),
        size.cast("long").alias("size"),
        sampling_key(F.col("doc_id"), weight, mix.seed).alias("key"),
    )
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
    rows = rows.withColumn("part", _last_part(F.col("key"), F.col("size")))
    takes = F.concat(
        F.array_repeat(F.col("size"), F.col("epochs").cast("int")),
        F.when(F.col("part") > 0, F.array("part")).otherwise(F.expr("array()").cast("array<bigint>")),
    )
    rows = rows.select("row", "size", F.explode(takes).alias("take"))
    cut, text = F.col("take") < F.col("size"), F.col("row.text")
    rows = rows.select("row", cut.alias("cut"), F.when(cut, first_words(text, F.col("take"))).otherwise(text).alias("text"))
    given = {c: F.col(f"row.`{c}`") for c in docs.columns}
    if "n_chars" in docs.columns:
        chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        given["n_chars"] = F.when(F.col("cut"), chars).otherwise(given["n_chars"])
    return rows.select(*(v.alias(c) for c, v in (given | {"text": F.col("text")}).items()))


def first_words(text: Column, count: Column) -> Column:
    """The text up to its count-th word, with the gaps between as they are."""
    ws = GAP[:-1]
    trimmed = F.regexp_replace(text, f"^{GAP}", "")
    pieces = F.split(trimmed, f"(?<={ws})(?!{ws})")
    return F.regexp_replace(F.array_join(F.slice(pieces, 1, count.cast("int")), ""), f"{GAP}$", "")
