"""Classes, methods and free functions of C and C++ files.

Segments are cut inside each row (no shuffle, whole texts), the few that matter for
symbols are kept, and only those are hashed by (repo, path) once. The unit of work is one file.
``file_scan`` does that with a value a file; ``file_segments``, ``scopes_of`` and ``records_of``
are the same with a row a segment, in expressions and windows keyed by (repo, path, ...), for
those who look at segments. Tests hold both equal.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repoatlas.functions import cpp_text as C
from repoatlas.functions import text
from repoatlas.operators.file_scan import SEGMENT_ROOM, packed_segments, scoped_rows, symbol_records

_FILE = ("repo", "path")
_CLASSES = ("class", "struct")
_HIDDEN_SPACES = ("unnamed_namespace",)
# Mentions of classes that one segment may hold: more than a string has room for. Places in a
# file are ints, so ids stay within a long.
_SEGMENT_ROOM = SEGMENT_ROOM


# A symbol row without its file.
RECORD = (
    "struct<record:string,class_id:bigint,position:bigint,kind:string,name:string,"
    "signature:string,line_start:int,line_end:int,visibility:string>"
)


def _in_file(*keys, order="pos"):
    return W.partitionBy("file_key", *_FILE, *keys).orderBy(
        *([order] if isinstance(order, str) else order)
    )


def _by_file(segments: DataFrame) -> DataFrame:
    """Segments hashed by (repo, path), with a number that sorts compare before the texts."""
    return segments.repartition(*_FILE).withColumn("file_key", F.xxhash64(*_FILE))


def _opens_class():
    return F.col("kind").isin(*_CLASSES)


def _stays():
    """Whether symbols are made of the row, or it ends a scope that counts."""
    scopes = (*_CLASSES, *_HIDDEN_SPACES)
    return (
        F.col("kind").isin(*scopes, "function", "bodyless")
        | F.col("closes").isin(*scopes)
        | F.col("label").isNotNull()
        | (F.size("mentions") > 0)
        | F.col("head").isNotNull()
    )


def _is_function():
    return F.col("kind").isin("function", "bodyless")


def _is_free():
    return _is_function() & F.col("name").isNotNull() & (F.col("class_depth") == 0)


def _is_method():
    return (
        _is_function()
        & F.col("name").isNotNull()
        & (F.col("class_depth") > 0)
        & (F.col("owner.name") != "")
        & (F.col("pos") > F.col("hidden_until"))
    )


def _free_visibility():
    return F.when(F.col("is_static") | F.col("in_unnamed_ns"), F.lit("private")).otherwise(
        F.lit("public")
    )


def _class_id(pos, nth=None):
    """Order-preserving id; the body of a segment comes after its bodyless mentions."""
    nth = F.lit(_SEGMENT_ROOM - 1) if nth is None else nth.cast("long")
    return pos.cast("long") * _SEGMENT_ROOM + nth


def file_segments(files: DataFrame, head: Column | None = None, is_code: Column | None = None) -> DataFrame:
    """Segments that matter, with the parts read off their headers.

    ``head`` is a value of each file over its columns and ``marked``, its marked text; it comes
    along on the first segment, which is then always kept: facts of files and symbols out of one
    read of the content. Files where ``is_code`` is false are one segment without symbols.
    """
    marked = files.withColumn("marked", C.marked(F.coalesce(text.valid_text(F.col("content")), F.lit(""))))
    segments = C.segments_of(F.col("marked"))
    if is_code is not None:
        segments = F.when(is_code, segments).otherwise(F.array(F.lit("")))
    empty = F.lit(None).cast("boolean")
    cut = marked.select(
        *_FILE, segments.alias("segments"), (empty if head is None else head).alias("file_head")
    )
    # All of the list: a bare column would be filtered by its size first, cut out of the content
    # once more.
    every = F.slice("segments", F.lit(1), F.size("segments"))
    rows = cut.select(
        *_FILE,
        F.size("segments").alias("end_pos"),
        C.last_code_line(F.element_at("segments", -1)).alias("end_line"),
        "file_head",
        F.posexplode(every).alias("pos", "segment"),
    ).withColumn("head", F.when(F.col("pos") == 0, F.col("file_head"))).drop("file_head")
    rows = rows.where(C.segment_matters(F.col("segment")) | F.col("head").isNotNull())
    segment = F.col("segment")
    # Only headers are read beyond their last character.
    is_header = C.opens_or_ends(segment) | C.has_class_word(segment)
    rows = rows.withColumn("segment", F.when(is_header, C.shallow(segment)).otherwise(segment))
    rows = rows.select(
        *_FILE,
        "pos",
        "end_pos",
        "end_line",
        "head",
        C.delimiter(segment).alias("delim"),
        C.header(segment, C.delimiter(segment)).alias("header"),
        F.when(C.opens_or_ends(segment), C.lead(segment)).alias("lead"),
        C.last_line(segment).alias("line_last"),
        F.when(C.is_label(segment), C.access_label(segment)).alias("label"),
    )
    # Costly patterns run once each, and only on headers that can match.
    head, delim = F.col("header"), F.col("delim")
    opens, class_word = delim == "{", C.has_class_word(head)
    rows = rows.withColumns(
        {
            "line_first": C.first_code_line(F.col("lead")),
            "plain": C.plain_header(head, F.col("lead")),
            "class_match": F.when(opens & class_word, C.class_match(head)),
        }
    )
    plain = F.col("plain")
    is_class = F.coalesce(F.col("class_match") != "", F.lit(False))
    bodyless = (delim == ";") & C.ends_bodyless(plain)
    rows = rows.withColumns(
        {
            "block": F.when(opens & ~is_class, C.block_kind(plain, head)),
            "parts": F.when((opens & ~is_class) | bodyless, C.function_parts(plain)),
        }
    )
    parts = F.col("parts")
    is_function = F.coalesce(F.size(parts) == 4, F.lit(False))
    # What several results are read off is a column of its own: worked out once.
    rows = rows.withColumns(
        {
            "prefix": F.when(is_function, C.function_prefix(parts)),
            "full_name": F.when(is_function, C.full_name(parts)),
        }
    )
    rows = rows.withColumn("result_type", C.result_type(F.col("prefix")))
    name = C.function_name(F.col("full_name"))
    signature = C.signature(parts, F.col("result_type"))
    is_static = C.is_static(F.col("prefix"))
    none = F.array().cast(
        "array<struct<kind:string,name:string,line_start:int,line_end:int>>"
    )
    return rows.select(
        *_FILE,
        "pos",
        "end_pos",
        "end_line",
        F.col("head"),
        "delim",
        F.when(is_class, C.class_keyword(F.col("class_match")))
        .when(F.col("block").isNotNull(), F.col("block"))
        .when(is_function, F.when(opens, F.lit("function")).otherwise(F.lit("bodyless")))
        .when(opens, F.lit("other"))
        .alias("kind"),
        F.when(F.col("label") != "", F.col("label")).alias("label"),
        F.when(is_class, C.class_name(F.col("class_match"))).when(is_function, name).alias("name"),
        F.when(is_function, signature).alias("signature"),
        F.when(is_function, is_static).alias("is_static"),
        F.when(is_function, C.is_plain_member(head)).alias("plain_member"),
        F.when(is_class, C.class_line(F.col("class_match")))
        .otherwise(F.col("line_first"))
        .alias("line_start"),
        "line_last",
        F.when(class_word, C.class_mentions(head, opens)).otherwise(none).alias("mentions"),
    )


def _with_levels(segments: DataFrame) -> DataFrame:
    """Nesting level of every segment: that of the scope it opens, closes or sits in."""
    step = (
        F.when(F.col("delim") == "{", 1).when(F.col("delim") == "}", -1).otherwise(0)
    )
    depth = F.sum(step).over(_in_file().rowsBetween(W.unboundedPreceding, W.currentRow))
    return segments.withColumn("depth", depth).withColumn(
        "level", F.when(F.col("delim") == "{", F.col("depth") - 1).otherwise(F.col("depth"))
    )


def _with_scopes(segments: DataFrame) -> DataFrame:
    """Segments with paired braces and, for functions, the kind of the scope around.

    An opening brace gets its closing position and line; one that is never closed ends
    with the file.
    """
    rows = _with_levels(_by_file(segments))
    # Opens and closes alternate within one level, so the partner is the next row.
    opens = F.col("delim") == "{"
    pair = _in_file("is_brace", "level")
    rows = (
        rows.withColumn("is_brace", F.col("delim").isin("{", "}"))
        .withColumn("next", F.lead(F.struct("delim", "pos", "line_last")).over(pair))
        .withColumn("prior", F.lag(F.struct("delim", "kind")).over(pair))
    )
    closed = F.col("next.delim") == "}"
    rows = rows.withColumns(
        {
            "close_pos": F.when(
                opens, F.when(closed, F.col("next.pos")).otherwise(F.col("end_pos"))
            ),
            "line_end": F.when(
                opens, F.when(closed, F.col("next.line_last")).otherwise(F.col("end_line"))
            ).otherwise(F.col("line_last")),
            "closes": F.when(
                (F.col("delim") == "}") & (F.col("prior.delim") == "{"), F.col("prior.kind")
            ),
        }
    ).drop("next", "prior", "end_pos", "end_line", "is_brace", "line_last", "depth")
    # The end of a plain block has done its part.
    rows = rows.where((F.col("delim") != "}") | _stays())
    # Parent: the last scope opened one level up. A function is looked up from there
    # (role 1) and stays at its own level only as a possible parent (role 0).
    both = rows.withColumn(
        "role",
        F.explode(
            F.when(F.col("kind") == "function", F.array(F.lit(0), F.lit(1)))
            .when(F.col("kind") == "bodyless", F.array(F.lit(1)))
            .otherwise(F.array(F.lit(0)))
        ),
    ).withColumn("seat", F.col("level") - F.col("role"))
    as_parent = F.when((F.col("role") == 0) & opens, F.struct("close_pos", "kind"))
    parent = F.last(as_parent, ignorenulls=True).over(
        _in_file("seat").rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        both.withColumn("parent", parent)
        .where((F.col("role") == 1) | ~F.coalesce(_is_function(), F.lit(False)))
        .withColumn(
            "parent_kind",
            F.when(
                (F.col("role") == 1) & (F.col("parent.close_pos") >= F.col("pos")),
                F.col("parent.kind"),
            ),
        )
        .drop("role", "seat", "parent")
    )


def scopes(files: DataFrame) -> DataFrame:
    """The rows that symbols are made of, what encloses them, and the owners of methods."""
    return scoped_rows(packed_segments(files))


def scopes_of(segments: DataFrame) -> DataFrame:
    """The same of segments as rows, without owners.

    ``class_depth`` counts the open classes, named or not; ``in_unnamed_ns`` tells an
    unnamed namespace on the way up. Plain blocks and their ends are gone.
    """
    rows = _with_scopes(segments)
    # A function cannot open directly inside a function or a plain block.
    nested = F.coalesce(F.col("parent_kind").isin("function", "other"), F.lit(False))
    rows = rows.withColumn(
        "kind", F.when(~(_is_function() & nested), F.col("kind"))
        .when(F.col("kind").isNotNull(), F.lit("other"))
    )
    rows = rows.where(_stays())
    before = _in_file().rowsBetween(W.unboundedPreceding, -1)

    def open_now(kinds):
        return F.coalesce(
            F.sum(
                F.when(F.col("kind").isin(*kinds), 1)
                .when(F.col("closes").isin(*kinds), -1)
                .otherwise(0)
            ).over(before),
            F.lit(0),
        )

    return rows.withColumn("class_depth", open_now(_CLASSES)).withColumn(
        "in_unnamed_ns", open_now(_HIDDEN_SPACES) > 0
    )


def classes_of(scoped: DataFrame) -> DataFrame:
    """classes(repo, path, class_id, kind, name, line_start, line_end).

    Named specifiers without a body are listed too. ``class_id`` is unique per file and
    follows the order of the text.
    """
    found = F.concat(
        F.transform(
            "mentions",
            lambda m, i: F.struct(
                _class_id(F.col("pos"), i).alias("class_id"),
                m["kind"].alias("kind"),
                m["name"].alias("name"),
                m["line_start"].alias("line_start"),
                m["line_end"].alias("line_end"),
            ),
        ),
        F.when(
            _opens_class() & (F.col("name") != ""),
            F.array(
                F.struct(
                    _class_id(F.col("pos")).alias("class_id"),
                    "kind",
                    "name",
                    "line_start",
                    "line_end",
                )
            ),
        ).otherwise(F.array()),
    )
    return scoped.select(*_FILE, F.explode(found).alias("c")).select(*_FILE, "c.*")


def _seated(scoped: DataFrame) -> DataFrame:
    """Scope rows seen from every class around them.

    A class opening sits at its own class depth, a label at that of the innermost class,
    a function at every depth from 1 to its own (0 outside classes). Running values per
    depth give the owner and the owner's access label in force. ``hidden_until`` is where
    the last direct member function of the owner ends.
    """
    depth = F.col("class_depth").cast("int")
    seats = (
        F.when(_opens_class(), F.array(depth + 1))
        .when(_is_function() & (depth > 0), F.sequence(F.lit(1), depth))
        .otherwise(F.array(depth))
    )
    rows = scoped.where(
        _opens_class() | _is_function() | F.col("label").isNotNull() | (F.size("mentions") > 0)
        | F.col("head").isNotNull()
    ).select("*", F.posexplode(seats).alias("nth_seat", "seat"))
    so_far = _in_file("seat").rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = _in_file("seat").rowsBetween(W.unboundedPreceding, -1)
    owner = F.last(
        F.when(_opens_class(), F.struct("pos", "level", "name")), ignorenulls=True
    ).over(so_far)
    default = F.when(F.col("kind") == "class", F.lit("private")).when(
        F.col("kind") == "struct", F.lit("public")
    )
    visibility = F.last(F.coalesce(F.col("label"), default), ignorenulls=True).over(so_far)
    direct = (
        (F.col("kind") == "function")
        & F.col("plain_member")
        & (F.col("level") == F.col("owner.level") + 1)
    )
    hidden_until = F.last(
        F.when(_opens_class(), F.lit(-1)).when(direct, F.col("close_pos")), ignorenulls=True
    ).over(earlier)
    return (
        rows.withColumn("owner", owner)
        .withColumn("visibility", visibility)
        .withColumn("hidden_until", hidden_until)
    )


def methods_of(scoped: DataFrame) -> DataFrame:
    """Methods per class, nested ones also on every outer class.

    A function inside a direct member function of the class is left out. ``is_own``
    tells the innermost class.
    """
    rows = scoped.select(
        *_FILE, "pos", "name", "signature", "line_start", "line_end", F.explode("owners").alias("o")
    )
    return rows.select(
        *_FILE,
        _class_id(F.col("o.pos")).alias("owner_class_id"),
        F.col("o.name").alias("owner_name"),
        F.col("pos").cast("long").alias("position"),
        "name",
        "signature",
        "line_start",
        "line_end",
        "o.visibility",
        "o.is_own",
    )


def functions_of(scoped: DataFrame) -> DataFrame:
    """Function definitions outside every class; static or hidden ones are private."""
    return scoped.where(_is_free()).select(
        *_FILE,
        F.lit(None).cast("long").alias("owner_class_id"),
        F.col("pos").cast("long").alias("position"),
        "name",
        "signature",
        "line_start",
        "line_end",
        _free_visibility().alias("visibility"),
    )


def symbol_rows(files: DataFrame) -> DataFrame:
    """Everything a file declares, as one table with a ``record`` column.

    ``record`` is class, method or function; for a method ``class_id`` is its owner.
    """
    return symbol_records(packed_segments(files))


def records_of(segments: DataFrame) -> DataFrame:
    """``symbol_rows`` of segments as rows, in expressions and windows; files whose segments
    carry a ``head`` have a record ``file`` with it.

    One pass over the scope rows: records are put into an array and exploded.
    """
    rows = _seated(scopes_of(segments)).where(
        _opens_class() | _is_function() | (F.size("mentions") > 0) | F.col("head").isNotNull()
    )
    no_head = F.lit(None).cast(segments.schema["head"].dataType)

    def record(kind_of, class_id, position, kind, name, start, end, sign=None, vis=None):
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(kind_of).alias("record"),
            class_id.cast("long").alias("class_id"),
            position.cast("long").alias("position"),
            kind.alias("kind"),
            name.alias("name"),
            (none if sign is None else sign).alias("signature"),
            start.alias("line_start"),
            end.alias("line_end"),
            (none if vis is None else vis).alias("visibility"),
            no_head.alias("head"),
        )

    pos, col, none = F.col("pos"), F.col, F.lit(None).cast("string")
    mentions = F.when(
        col("nth_seat") == 0,
        F.transform(
            "mentions",
            lambda m, i: record(
                "class", _class_id(pos, i), _class_id(pos, i), m["kind"], m["name"],
                m["line_start"], m["line_end"],
            ),
        ),
    )
    body = F.when(
        _opens_class() & (col("name") != ""),
        F.array(
            record(
                "class", _class_id(pos), _class_id(pos), col("kind"), col("name"),
                col("line_start"), col("line_end"),
            )
        ),
    )
    method = F.when(
        _is_method(),
        F.array(
            record(
                "method", _class_id(col("owner.pos")), pos, none, col("name"),
                col("line_start"), col("line_end"), col("signature"), col("visibility"),
            )
        ),
    )
    function = F.when(
        _is_free(),
        F.array(
            record(
                "function", F.lit(None), pos, none, col("name"), col("line_start"),
                col("line_end"), col("signature"), _free_visibility(),
            )
        ),
    )
    blank = record("file", F.lit(None), pos, none, none, F.lit(None).cast("int"), F.lit(None).cast("int"))
    file = F.when(
        (col("nth_seat") == 0) & col("head").isNotNull(),
        F.array(blank.withField("head", col("head"))),
    )
    found = F.flatten(F.array_compact(F.array(mentions, body, method, function, file)))
    return rows.select(*_FILE, F.explode(found).alias("r")).select(*_FILE, "r.*")


def unbalanced_files(files: DataFrame) -> DataFrame:
    """Files whose braces do not pair up."""
    step = F.when(F.col("delim") == "{", 1).when(F.col("delim") == "}", -1).otherwise(0)
    depth = F.sum(step).over(_in_file().rowsBetween(W.unboundedPreceding, W.currentRow))
    return (
        _by_file(file_segments(files))
        .withColumn("depth", depth)
        .groupBy(*_FILE)
        .agg(F.min("depth").alias("lowest"), F.sum(step).alias("left_open"))
        .where((F.col("lowest") < 0) | (F.col("left_open") != 0))
        .select(*_FILE, F.lit("unbalanced").alias("reason"))
    )


def extraction_skips(files: DataFrame) -> DataFrame:
    """Files without usable facts: unreadable ones, and unbalanced ones, which keep
    what could be paired."""
    unreadable = files.where(F.col("content").isNull()).select(
        *_FILE, F.lit("unreadable").alias("reason")
    )
    return unreadable.unionByName(unbalanced_files(files.where(F.col("content").isNotNull())))


def enclosing_scopes(scoped: DataFrame) -> DataFrame:
    """What surrounds each function: nearest scope kind, class, unnamed namespace."""
    return scoped.where(F.col("kind").isin("function", "bodyless") & F.col("name").isNotNull()).select(
        *_FILE,
        "name",
        "line_start",
        F.coalesce("parent_kind", F.lit("file")).alias("parent_kind"),
        (F.col("class_depth") > 0).alias("in_class"),
        "in_unnamed_ns",
    )
