"""What several of the operators share: words, tokenizers, Arrow maps, shared tables."""

import re
import sys
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoatlas.sources.workspace import written

# Between words, as a pattern of the JVM.
GAP = r"[\x20\x09-\x0D]+"

# Entries in each of the two generations of a per-worker memo of pre-tokens.
MEMO_ENTRIES = 450_000


def word_array(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def id_text(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def fold_of(doc_id: Column, parts: int) -> Column:
    """Remainder of the CRC-32 of the id as text (null: the empty text)."""
    return F.crc32(id_text(doc_id).cast("binary")) % F.lit(parts)


def ascii_words(text: str) -> list[bytes]:
    """UTF-8 words with A-Z lower-cased. Bytes split at exactly x20 and x09-x0D."""
    return utf8(text).lower().split()


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def bounded_broadcast(df: DataFrame, label: str, most: int = 100_000) -> DataFrame:
    """A small table, written once; sent to all tasks only if its counted rows allow it."""
    table = written(df, label)
    return F.broadcast(table) if table.count() <= most else table


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with a function from column lists of a batch to column lists.

    ``function`` gets an iterator over dicts of lists and yields dicts of lists. Spark
    bounds each batch by rows and by bytes (spark.sql.execution.arrow.maxBytesPerBatch).
    """
    types = df.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(types)
        columns = (batch.to_pydict() for batch in batches)
        for out in function(columns):
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[field.name], field.type) for field in arrow], schema=arrow
            )

    return df.mapInArrow(run, types)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """One tokenizer per worker; strings of special tokens in a text are ordinary text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = True
    return loaded


_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARK = r"!-&(-/:-@\[-`{-~"  # of ASCII, without the apostrophe, which may start a pre-token
# Pre-tokens of texts that hold nothing but such letters, digits, marks, single spaces and
# line feeds. Letters, digits and marks never share a pre-token.
_PLAIN = re.compile(rf" ?[{_LETTER}]+| ?[0-9]+| ?[{_MARK}]+|\n")
_NOT_PLAIN = re.compile(rf"[^{_LETTER}{_MARK}0-9 \n]|[ \n][ \n]|[ \n]\Z")
_FOLDED = re.compile(rf"[{_LETTER}]+|[0-9]|[{_MARK}]+")
_NOT_FOLDED = re.compile(rf"[^{_LETTER}{_MARK}0-9 \n]")
# For other texts: white space with what follows up to the next. Cut only where a
# character that is no white space meets a space or line feed; no pre-token goes across.
_SEGMENT = re.compile(r"[ \n]*\S+|[ \n]+\Z")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable ones stay, the
    others follow from 256 on."""
    stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(stay)]
    return {b: chr(b) for b in stay} | {b: chr(256 + n) for n, b in enumerate(rest)}


class TextEncoder:
    """Ids of whole texts through the tokenizers library, each distinct piece once.

    Pieces are pre-tokens of the tokenizer, or runs of them. Texts with white space other
    than spaces and line feeds go to the library whole. ``folds``: the tokenizer drops
    white space and case.
    """

    def __init__(self, path: str, folds: bool, width: int = 4):
        self.encode = tokenizer(path)
        self.model = self.encode.model
        self.folds = folds
        self.code = {2: "H", 4: "I"}[width]
        self.letters = _byte_letters()
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, ids) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _word(self, word: str) -> bytes:
        spelt = word.encode().decode("latin-1").translate(self.letters)
        return self._ids([t.id for t in self.model.tokenize(spelt)])

    def _any(self, text: str) -> bytes:
        return self._ids(self.encode.encode(text, add_special_tokens=False).ids)

    def _all(self, pieces: list[str], make) -> bytes:
        new, old = self.new, self.old
        found = list(map(new.get, pieces))
        if None in found:
            for n, ids in enumerate(found):
                if ids is None:
                    piece = pieces[n]
                    ids = new.get(piece) or old.get(piece)
                    if ids is None:
                        ids = make(piece)
                    if len(piece) < 40:
                        new[piece] = ids
                    found[n] = ids
            if len(new) > MEMO_ENTRIES:
                self.old, self.new = new, {}
        return b"".join(found)

    def __call__(self, text: str) -> bytes:
        """The ids' bytes, little-endian unsigned."""
        if self.folds:
            if not _NOT_FOLDED.search(text):
                return self._all(_FOLDED.findall(text.lower()), self._word)
        elif not _NOT_PLAIN.search(text):
            return self._all(_PLAIN.findall(text), self._word)
        segments = _SEGMENT.findall(text)
        if sum(map(len, segments)) != len(text):
            return self._any(text)
        # One name space for both kinds of pieces: a segment is encoded as it would be
        # as a pre-token, or it is none.
        return self._all(segments, self._any)


@lru_cache(maxsize=4)
def text_encoder(path: str, folds: bool, width: int = 4) -> TextEncoder:
    """One per worker process: the memo serves all tasks that it runs."""
    return TextEncoder(path, folds, width)


def open_store(folder: str):
    """File system and path of a shared folder, for tasks that read or write files there."""
    from pyarrow import fs

    if re.match(r"[a-zA-Z][\w+.-]*:", folder):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def task_file(folder: str, suffix: str):
    """File system, path and partition number for the file of this task attempt.

    Each attempt has its own name. Only files named in the rows of the attempt that
    succeeded are read back, so a lost executor leaves at worst an unused file.
    """
    from pyspark import TaskContext

    task = TaskContext.get()
    store, path = open_store(folder)
    store.create_dir(path)
    name = f"{path.rstrip('/')}/part-{task.partitionId():06d}-{task.taskAttemptId()}{suffix}"
    return store, name, task.partitionId()


def one_task_each(table: DataFrame) -> DataFrame:
    """A written table of files (one row each), spread one row to a task."""
    return table.repartition(max(1, min(table.count(), 100_000)))
