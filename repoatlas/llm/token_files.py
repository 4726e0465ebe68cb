"""Token ids in binary files: a shared zstandard dictionary, a frame per document, an index.

A file holds the frames of its documents one after another, then the index (ids of the
documents, a null mark each, frame offsets, token counts), then a JSON footer with the
hash of the dictionary, the footer's length and the mark. A reader fetches the footer,
the index and one frame to get one document.
"""

import json
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repoatlas.llm.common import (
    arrow_map,
    one_task_each,
    open_store,
    task_file,
    text_encoder,
    written,
)
from repoatlas.sources.workspace import new_dir

MARK = b"TOKZDCT1"
# Rows that the dictionary is trained on, about, by hash of the id, and its bytes.
DICTIONARY_ROWS = 1_000
DICTIONARY_BYTES = 64 * 1024
# Of a text in that sample, so many first ids are given to the trainer.
DICTIONARY_IDS = 4_096
LEVEL = 3


def encoded(text, encoder, end_id: int, width: int) -> bytes:
    return encoder(text or "") + end_id.to_bytes(width, "little")


def train_dictionary(docs: DataFrame, path: str, folds: bool, end_id: int, width: int) -> bytes:
    """A dictionary from id arrays of a bounded sample; empty if there is too little to train."""
    import zstandard

    total = docs.count()
    sample = docs.select("doc_id", "text")
    if total > DICTIONARY_ROWS:
        # Hashes are even over the signed 64 bits. The limit only bounds equal ids.
        bound = int(DICTIONARY_ROWS / total * 2**64) - 2**63
        sample = sample.where(F.xxhash64("doc_id") < bound).limit(4 * DICTIONARY_ROWS)

    def ids(batches):
        encoder = text_encoder(path, folds, width)
        for batch in batches:
            rows = [encoded(t, encoder, end_id, width) for t in batch["text"]]
            yield {"ids": [r[: DICTIONARY_IDS * width] for r in rows]}

    rows = [bytes(r.ids) for r in arrow_map(sample.select("text"), ids, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, rows).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def write_token_files(
    docs: DataFrame, path: str, folds: bool, end_id: int, width: int = 2
) -> DataFrame:
    """Writes the ids of all documents in ascending doc_id order; returns the table of files.

    Columns: path, shard, dictionary (hash), n_docs, n_tokens. The dictionary lies beside
    the files under its hash. Null text counts as empty; null ids come first; rows with
    equal ids lie next to each other in order of a hash of the text. Other columns are
    not read. ``width``: bytes of an id.
    """
    import hashlib

    spark = docs.sparkSession
    folder = new_dir(spark, "tokens")
    trained = train_dictionary(docs, path, folds, end_id, width)
    name = hashlib.sha256(trained).hexdigest()
    store, place = open_store(folder)
    store.create_dir(place)
    with store.open_output_stream(f"{place}/{name}.dict") as out:
        out.write(trained)
    shared = spark.sparkContext.broadcast(trained)
    ordered = (
        docs.select("doc_id", "text")
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    )

    def write(batches):
        import zstandard

        encoder = text_encoder(path, folds, width)
        compress = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=_dictionary(shared.value), write_content_size=True
        ).compress
        ids, offsets, counts, out, at = [], [0], [], None, 0
        for batch in batches:
            if out is None and batch["doc_id"]:
                store, file, shard = task_file(folder, ".tok")
                out = store.open_output_stream(file)
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                raw = encoded(text, encoder, end_id, width)
                at += out.write(compress(raw))
                ids.append(doc_id)
                offsets.append(at)
                counts.append(len(raw) // width)
        if out is None:
            return
        out.write(np.array([i or 0 for i in ids], "<i8").tobytes())
        out.write(np.array([i is None for i in ids], "u1").tobytes())
        out.write(np.array(offsets, "<u8").tobytes())
        out.write(np.array(counts, "<u8").tobytes())
        footer = {"dictionary": name, "n_docs": len(ids), "width": width, "index": at}
        footer = json.dumps(footer).encode()
        out.write(footer + len(footer).to_bytes(4, "little") + MARK)
        out.close()
        yield {
            "path": [file],
            "shard": [shard],
            "dictionary": [name],
            "n_docs": [len(ids)],
            "n_tokens": [sum(counts)],
        }

    files = arrow_map(
        ordered, write, "path string, shard int, dictionary string, n_docs long, n_tokens long"
    )
    return written(files, "token-files").withColumn("folder", F.lit(folder))


class TokenFile:
    """One file, opened for reading."""

    def __init__(self, folder: str, path: str):
        import hashlib

        import zstandard

        store, place = open_store(folder)
        self.file = store.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MARK:
            raise ValueError(f"{path} is no token file")
        length = int.from_bytes(tail[:4], "little")
        footer = json.loads(self.file.read_at(length, size - 12 - length))
        with store.open_input_stream(f"{place}/{footer['dictionary']}.dict") as source:
            trained = source.read()
        if hashlib.sha256(trained).hexdigest() != footer["dictionary"]:
            raise ValueError(f"the dictionary of {path} is not the one it was written with")
        n, at = footer["n_docs"], footer["index"]
        index = self.file.read_at(25 * n + 8, at)
        self.width = footer["width"]
        self.ids = np.frombuffer(index, "<i8", n)
        self.null = np.frombuffer(index, "u1", n, 8 * n)
        self.offsets = np.frombuffer(index, "<u8", n + 1, 9 * n)
        self.counts = np.frombuffer(index, "<u8", n, 17 * n + 8)
        self.decompress = zstandard.ZstdDecompressor(dict_data=_dictionary(trained)).decompress

    def __len__(self):
        return len(self.ids)

    def doc_id(self, n: int):
        return None if self.null[n] else int(self.ids[n])

    def document(self, n: int) -> np.ndarray:
        """Ids of the n-th document; reads its frame only."""
        at, end = int(self.offsets[n]), int(self.offsets[n + 1])
        raw = self.decompress(self.file.read_at(end - at, at))
        ids = np.frombuffer(raw, f"<u{self.width}")
        if len(ids) != self.counts[n]:
            raise ValueError("a frame does not hold the ids that the index gives")
        return ids


def read_token_files(files: DataFrame) -> DataFrame:
    """Reads every document back: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before; the files' totals (one row a file)
    are summed in order of the files.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    based = written(based.select("folder", "path", "base"), "token-bases")

    def read(batches):
        for batch in batches:
            for folder, path, base in zip(batch["folder"], batch["path"], batch["base"]):
                source = TokenFile(folder, path)
                for low in range(0, len(source), 4096):
                    rows = range(low, min(low + 4096, len(source)))
                    counts = [int(source.counts[n]) for n in rows]
                    yield {
                        "doc_id": [source.doc_id(n) for n in rows],
                        "start": [base + s for s in np.cumsum([0, *counts[:-1]]).tolist()],
                        "n_tokens": counts,
                        "ids_crc32": [
                            zlib.crc32(source.document(n).astype("<u4").tobytes()) for n in rows
                        ],
                    }
                    base += sum(counts)

    return arrow_map(
        one_task_each(based), read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
