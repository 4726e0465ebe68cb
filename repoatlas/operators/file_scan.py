"""What files of the C family declare, file by file inside tasks.

A first pass cuts the text of each row and keeps the segments that matter as one value a file: no
shuffle, and nothing but that value goes on. Those are hashed by (repo, path) once, as rows of one
path are one file, and a second pass pairs braces and finds scopes, classes and owners along each
file. The order of the steps is that of ``symbols.scopes_of`` and ``symbols.records_of``.
"""

import marshal
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoatlas.functions import cpp_scan, text

IMPORTS = "array<struct<name:string,is_system:boolean>>"
_MENTIONS = "array<struct<kind:string,name:string,line_start:int,line_end:int>>"
_OWNERS = "array<struct<pos:int,name:string,visibility:string,is_own:boolean>>"
SCOPED = (
    "repo string, path string, pos int, kind string, name string, signature string, "
    "is_static boolean, line_start int, line_end int, parent_kind string, class_depth int, "
    f"in_unnamed_ns boolean, mentions {_MENTIONS}, owners {_OWNERS}"
)
_SCOPED_NAMES = [field.split(" ")[0] for field in SCOPED.split(", ")]
_RECORDS = (
    "record string, class_id bigint, position bigint, kind string, name string, "
    "signature string, line_start int, line_end int, visibility string"
)
_FUNCTION = (
    "struct<position:bigint,name:string,signature:string,line_start:int,line_end:int,visibility:string>"
)
_CLASSES = (
    "array<struct<kind:string,class_id:bigint,name:string,line_start:int,line_end:int,"
    f"methods:array<{_FUNCTION}>>>"
)
_CLASS, _SPACE = ("class", "struct"), "unnamed_namespace"
_CALLABLE = ("function", "bodyless")
# Mentions of classes that one segment may hold.
SEGMENT_ROOM = 1 << 31
# Files whose texts are in Python at once.
_SLICE = 256

_STR, _INT, _LONG, _BOOL = pa.string(), pa.int32(), pa.int64(), pa.bool_()


def _list_of(rows: list[list[tuple]], fields: dict) -> pa.Array:
    """A list of structs a row, out of lists of tuples."""
    offsets = pa.array([0, *accumulate(map(len, rows))], _INT)
    return pa.ListArray.from_arrays(offsets, _structs([x for row in rows for x in row], fields))


def _structs(items: list[tuple], fields: dict) -> pa.Array:
    columns = list(zip(*items)) if items else [()] * len(fields)
    arrays = [pa.array(c, kind) for c, kind in zip(columns, fields.values())]
    return pa.StructArray.from_arrays(arrays, names=list(fields))


def packed_segments(
    files: DataFrame, head: Column | None = None, is_code: Column | None = None
) -> DataFrame:
    """repo, path, head, end_pos, end_line, segments, includes: a row a file.

    ``head`` is a value of each file over its columns; without one, files that declare nothing
    are left out. Files where ``is_code`` is false have neither segments nor includes.
    """
    has_head = head is not None
    rows = files.select(
        "repo",
        "path",
        (head if has_head else F.lit(None).cast("boolean")).alias("head"),
        F.coalesce(text.valid_text(F.col("content")), F.lit("")).alias("text"),
        (F.lit(True) if is_code is None else is_code).alias("is_code"),
    )
    kind = rows.schema["head"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _SLICE):
                yield _cut(batch.slice(start, _SLICE), has_head)

    schema = f"repo string, path string, head {kind}, end_pos int, end_line int, segments binary, includes {IMPORTS}"
    return rows.mapInArrow(cut, schema)


def _cut(batch: pa.RecordBatch, has_head: bool) -> pa.RecordBatch:
    ends, lines, packed, includes, kept = [], [], [], [], []
    for i, (content, is_code) in enumerate(
        zip(batch.column("text").to_pylist(), batch.column("is_code").to_pylist())
    ):
        rows, n, line, names = [], 1, None, []
        if is_code:
            content = cpp_scan.plain(content)
            rows, n, line = cpp_scan.file_rows(content)
            if has_head:
                names = cpp_scan.include_names(content)
        if rows or has_head:
            kept.append(i)
            ends.append(n)
            lines.append(line)
            packed.append(marshal.dumps(rows))
            includes.append(names)
    if len(kept) < batch.num_rows:
        batch = batch.take(pa.array(kept, _INT))
    arrays = [
        *(batch.column(c) for c in ("repo", "path", "head")),
        pa.array(ends, _INT),
        pa.array(lines, _INT),
        pa.array(packed, pa.binary()),
        _list_of(includes, {"name": _STR, "is_system": _BOOL}),
    ]
    return pa.RecordBatch.from_arrays(
        arrays, ["repo", "path", "head", "end_pos", "end_line", "segments", "includes"]
    )


def _whole_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows, cut between files."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch if rest is None else pa.concat_batches([rest, batch])
        repos, paths = batch.column("repo"), batch.column("path")
        at = batch.num_rows - 1
        while at and repos[at].equals(repos[at - 1]) and paths[at].equals(paths[at - 1]):
            at -= 1
        if at:
            yield batch.slice(0, at)
        rest = batch.slice(at)
    if rest is not None:
        yield rest


def _files(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(first row, repo, path, rows of ``cpp_scan`` with what the text ends with) of each file."""
    columns = ("repo", "path", "end_pos", "end_line", "segments")
    columns = [batch.column(c).to_pylist() for c in columns]
    repos, paths, _, _, _ = columns
    i, n = 0, batch.num_rows
    while i < n:
        j = i + 1
        while j < n and paths[j] == paths[i] and repos[j] == repos[i]:
            j += 1
        texts = [(marshal.loads(columns[4][k]), columns[2][k], columns[3][k]) for k in range(i, j)]
        yield i, repos[i], paths[i], texts
        i = j


def declared(texts: list[tuple]) -> list[tuple]:
    """What the texts of a path declare, in order.

    ``texts``: rows of ``cpp_scan.file_rows``, number of segments, last line of code. Rows: pos,
    kind, name, signature, is_static, line_start, line_end, parent_kind, class_depth,
    in_unnamed_ns, mentions, owners.
    """
    if len(texts) == 1:
        rows, end_pos, end_line = texts[0]
        ends = None
    else:
        # Texts under one path run into each other, place by place.
        merged = [(row, n, line) for rows, n, line in texts for row in rows]
        merged.sort(key=lambda r: r[0][0])
        rows, ends = [r[0] for r in merged], [r[1:] for r in merged]
    # Levels; opening and closing braces alternate within one.
    depth, levels, last = 0, [], {}
    closed_by, closes = {}, {}
    for i, row in enumerate(rows):
        delim = row[1]
        if delim == "{":
            level = depth
            depth += 1
        else:
            if delim == "}":
                depth -= 1
            level = depth
        levels.append(level)
        if delim == "{":
            last[level] = i
        elif delim == "}":
            before = last.get(level)
            if before is not None:
                closed_by[before] = row
                closes[i] = rows[before][2]
            last[level] = None
    out, opened, seats = [], {}, {}
    class_depth = spaces = 0
    for i, row in enumerate(rows):
        pos, delim, kind, label, name, signature, is_static, plain_member, start, line_last, mentions = row
        level = levels[i]
        parent_kind = None
        if kind in _CALLABLE:
            parent = opened.get(level - 1)
            if parent and parent[0] >= pos:
                parent_kind = parent[1]
        if delim == "{":
            end = closed_by.get(i)
            if end is not None:
                close_pos, line_end = end[0], end[9]
            else:
                close_pos, line_end = (end_pos, end_line) if ends is None else ends[i]
            opened[level] = (close_pos, kind)
        else:
            close_pos, line_end = None, line_last
        # A function cannot open directly inside a function or a plain block.
        if parent_kind == "function" or parent_kind == "other":
            kind = "other"
        if delim == "}":
            if mentions:
                out.append((pos, None, None, None, None, None, line_end, None, class_depth, spaces > 0, mentions, ()))
            ended = closes.get(i)
            if ended in _CLASS:
                class_depth -= 1
            elif ended == _SPACE:
                spaces -= 1
            continue
        if label is not None:
            seats.setdefault(class_depth, [None, None, None])[1] = label
        if kind in _CLASS:
            # The owner, the label in force, and where its last direct member function ends.
            seats[class_depth + 1] = [
                (pos, level, name), "private" if kind == "class" else "public", -1
            ]
            out.append((pos, kind, name, None, None, start, line_end, None, class_depth, spaces > 0, mentions, ()))
            class_depth += 1
        elif kind in _CALLABLE:
            owners = []
            for seat in range(1, class_depth + 1):
                state = seats.get(seat)
                owner = state and state[0]
                if not owner:
                    continue
                if name is not None and owner[2] != "" and state[2] is not None and pos > state[2]:
                    owners.append((owner[0], owner[2], state[1], seat == class_depth))
                if kind == "function" and plain_member and level == owner[1] + 1:
                    state[2] = close_pos
            out.append(
                (pos, kind, name, signature, is_static, start, line_end, parent_kind, class_depth, spaces > 0, mentions, owners)
            )
        else:
            if mentions:
                out.append((pos, kind, name, None, None, start, line_end, None, class_depth, spaces > 0, mentions, ()))
            if kind == _SPACE:
                spaces += 1
    return out


def by_file(packed: DataFrame) -> DataFrame:
    return packed.repartition("repo", "path").sortWithinPartitions("repo", "path")


def scoped_rows(packed: DataFrame) -> DataFrame:
    """``SCOPED``: rows that symbols are made of, with what encloses them."""

    def found(batches):
        for batch in _whole_files(batches):
            repos, paths, rows = [], [], []
            for _, repo, path, texts in _files(batch):
                mine = declared(texts)
                rows += mine
                repos += [repo] * len(mine)
                paths += [path] * len(mine)
            kinds = (_INT, _STR, _STR, _STR, _BOOL, _INT, _INT, _STR, _INT, _BOOL)
            columns = list(zip(*rows)) if rows else [()] * 12
            arrays = [pa.array(repos, _STR), pa.array(paths, _STR)]
            arrays += [pa.array(c, kind) for c, kind in zip(columns, kinds)]
            arrays.append(_list_of(columns[10], {"kind": _STR, "name": _STR, "line_start": _INT, "line_end": _INT}))
            arrays.append(_list_of(columns[11], {"pos": _INT, "name": _STR, "visibility": _STR, "is_own": _BOOL}))
            yield pa.RecordBatch.from_arrays(arrays, _SCOPED_NAMES)

    return by_file(packed.select("repo", "path", "end_pos", "end_line", "segments")).mapInArrow(found, SCOPED)


def _class_id(pos: int, nth: int = SEGMENT_ROOM - 1) -> int:
    return pos * SEGMENT_ROOM + nth


def records(texts: list[tuple]) -> list[tuple]:
    """``symbols.RECORD`` of the texts of a path."""
    out = []
    for pos, kind, name, signature, is_static, start, end, _, depth, hidden, mentions, owners in declared(texts):
        for i, m in enumerate(mentions):
            at = _class_id(pos, i)
            out.append(("class", at, at, m[0], m[1], None, m[2], m[3], None))
        if kind in _CLASS:
            if name != "":
                at = _class_id(pos)
                out.append(("class", at, at, kind, name, None, start, end, None))
        elif kind in _CALLABLE and name is not None:
            for owner, _, visibility, _ in owners:
                out.append(("method", _class_id(owner), pos, None, name, signature, start, end, visibility))
            if depth == 0:
                visibility = "private" if is_static or hidden else "public"
                out.append(("function", None, pos, None, name, signature, start, end, visibility))
    return out


_RECORD_KINDS = {
    "record": _STR, "class_id": _LONG, "position": _LONG, "kind": _STR, "name": _STR,
    "signature": _STR, "line_start": _INT, "line_end": _INT, "visibility": _STR,
}
_FUNCTION_KINDS = {
    n: _RECORD_KINDS[n] for n in ("position", "name", "signature", "line_start", "line_end", "visibility")
}


def symbol_records(packed: DataFrame) -> DataFrame:
    """repo, path and ``symbols.RECORD``, flat."""

    def found(batches):
        for batch in _whole_files(batches):
            repos, paths, rows = [], [], []
            for _, repo, path, texts in _files(batch):
                mine = records(texts)
                rows += mine
                repos += [repo] * len(mine)
                paths += [path] * len(mine)
            columns = list(zip(*rows)) if rows else [()] * len(_RECORD_KINDS)
            arrays = [pa.array(repos, _STR), pa.array(paths, _STR)]
            arrays += [pa.array(c, kind) for c, kind in zip(columns, _RECORD_KINDS.values())]
            yield pa.RecordBatch.from_arrays(arrays, ["repo", "path", *_RECORD_KINDS])

    return by_file(packed.select("repo", "path", "end_pos", "end_line", "segments")).mapInArrow(
        found, f"repo string, path string, {_RECORDS}"
    )


def _in_order(values):
    """A sort key that puts nulls first, as structs are compared."""
    return tuple((v is not None, v) for v in values)


def gathered(rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Classes with their methods, all classes before all structs, and functions of a file."""
    classes, methods, functions = {}, {}, {}
    for record, class_id, position, kind, name, signature, start, end, visibility in rows:
        if record == "class":
            c = (kind, name, start, end)
            before = classes.get(class_id)
            classes[class_id] = c if before is None else max(before, c, key=_in_order)
        else:
            group = methods if record == "method" else functions if record == "function" else None
            if group is not None:
                group.setdefault(class_id, []).append((position, name, signature, start, end, visibility))
    for group in (*methods.values(), *functions.values()):
        group.sort(key=_in_order)
    listed = [(c[0], at, c[1], c[2], c[3], methods.get(at, ())) for at, c in classes.items()]
    listed.sort(key=lambda c: _in_order(c[:5]))
    return listed, [f for group in functions.values() for f in group]


def structure_rows(packed: DataFrame, others: bool) -> DataFrame:
    """repo, path, head, classes, functions: a row a path.

    ``others``: heads may hold symbols of other languages.
    """

    def found(batches):
        for batch in _whole_files(batches):
            firsts, classes, functions = [], [], []
            heads = batch.column("head")
            for i, _, _, texts in _files(batch):
                rows = records(texts)
                if others:
                    for k in range(i, i + len(texts)):
                        symbols = heads[k].as_py()["symbols"] or ()
                        rows += [tuple(s[n] for n in _RECORD_KINDS) for s in symbols]
                mine, free = gathered(rows)
                firsts.append(i)
                classes.append(mine)
                functions.append(free)
            flat = [c for mine in classes for c in mine]
            columns = list(zip(*flat)) if flat else [()] * 6
            kinds = (_STR, _LONG, _STR, _INT, _INT)
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
            arrays.append(_list_of(columns[5], _FUNCTION_KINDS))
            names = ["kind", "class_id", "name", "line_start", "line_end", "methods"]
            listed = pa.ListArray.from_arrays(
                pa.array([0, *accumulate(map(len, classes))], _INT), pa.StructArray.from_arrays(arrays, names)
            )
            first = batch.select(["repo", "path", "head"]).take(pa.array(firsts, _INT))
            yield pa.RecordBatch.from_arrays(
                [*first.columns, listed, _list_of(functions, _FUNCTION_KINDS)],
                ["repo", "path", "head", "classes", "functions"],
            )

    kind = packed.schema["head"].dataType.simpleString()
    schema = (
        f"repo string, path string, head {kind}, classes {_CLASSES}, "
        f"functions array<{_FUNCTION}>"
    )
    return by_file(packed).mapInArrow(found, schema)
