"""Raw source trees as ``source_files``.

``spark.read.format("binaryFile")`` leaves out hidden files, names that start with an
underscore and empty files. The stages below keep them: a listing, one job for each depth of
the tree, whose rows are the entries of its folders; and a read of the listed files, in tasks
cut by their bytes.
"""

import os

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoatlas.functions import paths, text
from repoatlas.sources.workspace import new_dir

# Bytes of files that a task reads, about.
SPLIT_BYTES = 128 << 20
# Entries, and bytes of contents, that a task holds at once; one file may be larger.
ENTRIES = 10_000
BATCH_BYTES = 16 << 20

_ENTRY = "full binary, is_folder boolean, size bigint, mtime_us bigint"
_ENTRY_ARROW = pa.schema(
    [("full", pa.binary()), ("is_folder", pa.bool_()), ("size", pa.int64()), ("mtime_us", pa.int64())]
)
_FILE = "name binary, content binary, size bigint, mtime_us bigint"
_FILE_ARROW = pa.schema(
    [("name", pa.binary()), ("content", pa.binary()), ("size", pa.int64()), ("mtime_us", pa.int64())]
)


def _local_entries(folder: bytes):
    """Links to files count as files, links to folders as nothing."""
    with os.scandir(folder) as entries:
        for entry in entries:
            if entry.is_dir(follow_symlinks=False):
                yield entry.path, True, None, None
            elif entry.is_file():
                stat = entry.stat()
                yield entry.path, False, stat.st_size, stat.st_mtime_ns // 1_000


def _store_entries(store, folder: bytes):
    for info in store.get_file_info(arrow_fs.FileSelector(folder.decode())):
        if info.type == arrow_fs.FileType.Directory:
            yield info.path.encode(), True, None, None
        elif info.type == arrow_fs.FileType.File:
            mtime = None if info.mtime_ns is None else info.mtime_ns // 1_000
            yield info.path.encode(), False, info.size, mtime


def _lister(store):
    def run(batches):
        for batch in batches:
            for folder in batch.column("full").to_pylist():
                entries = _store_entries(store, folder) if store else _local_entries(folder)
                held = []
                for entry in entries:
                    held.append(entry)
                    if len(held) == ENTRIES:
                        yield _batch(held, _ENTRY_ARROW)
                        held = []
                if held:
                    yield _batch(held, _ENTRY_ARROW)

    return run


def _batch(rows, schema):
    columns = [pa.array(values, field.type) for values, field in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _reader(store, root: bytes):
    prefix = len(root.rstrip(b"/")) + 1

    def run(batches):
        for batch in batches:
            held, n_bytes = [], 0
            for full, mtime in zip(batch.column("full").to_pylist(), batch.column("mtime_us").to_pylist()):
                with store.open_input_stream(full.decode()) if store else open(full, "rb") as file:
                    content = file.read()
                held.append((full[prefix:], content, len(content), mtime))
                n_bytes += len(content)
                if n_bytes >= BATCH_BYTES:
                    yield _batch(held, _FILE_ARROW)
                    held, n_bytes = [], 0
            if held:
                yield _batch(held, _FILE_ARROW)

    return run


def _store_of(root: str, store):
    """(file system or None for mounted folders, root within it)."""
    if store is None and "://" in root:
        store, root = arrow_fs.FileSystem.from_uri(root)
        if isinstance(store, arrow_fs.LocalFileSystem):
            store = None
    return store, os.fsencode(root)


def _listing(spark: SparkSession, root: bytes, store) -> DataFrame:
    """The entries below a folder as a stored table. Each folder is opened once, by a task."""
    table = new_dir(spark, "listing")
    most = 4 * spark.sparkContext.defaultParallelism
    folders, n, depth = spark.createDataFrame([(bytearray(root),)], "full binary"), 1, 0
    while n:
        level = f"{table}/depth={depth}"
        spread = folders.repartition(min(n, most), "full")
        spread.mapInArrow(_lister(store), _ENTRY).write.parquet(level)
        folders = spark.read.schema(_ENTRY).parquet(level).where("is_folder").select("full")
        n, depth = folders.count(), depth + 1
    return spark.read.schema(_ENTRY).parquet(table).drop("depth")


def list_tree(spark: SparkSession, root: str, repo: str, store=None) -> DataFrame:
    """(repo, path, size, mtime) of every regular file, without opening any."""
    store, base = _store_of(root, store)
    name = F.expr(f"substring(full, {len(base.rstrip(b'/')) + 2})")
    return _listing(spark, base, store).where("not is_folder").select(
        F.lit(repo).alias("repo"),
        text.valid_text(name).alias("path"),
        "size",
        F.timestamp_micros("mtime_us").alias("mtime"),
    )


def read_tree(
    spark: SparkSession, root: str, repo: str, split_bytes: int = SPLIT_BYTES, store=None
) -> DataFrame:
    """Every regular file under a folder, hidden and empty ones too.

    ``root`` is a folder that all executors can open, or the URI of one in an object store;
    ``store``, a pyarrow file system, stands for the latter where it needs credentials of its
    own. The folder is listed when this is called. Files are dealt to as many tasks as their
    bytes ask for, by a hash of their names; bytes of a name that are no UTF-8 are replaced.
    A file that is gone when it is read ends the job.
    """
    store, base = _store_of(root, store)
    files = _listing(spark, base, store).where("not is_folder")
    total = files.agg(F.sum(F.col("size") + 4096)).first()[0] or 0
    dealt = files.select("full", "mtime_us").repartition(max(1, -(-total // split_bytes)), "full")
    return dealt.mapInArrow(_reader(store, base), _FILE).select(
        F.lit(repo).alias("repo"),
        text.valid_text(F.col("name")).alias("path"),
        "content",
        "size",
        F.timestamp_micros("mtime_us").alias("mtime"),
    )


def read_binary_tree(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """The same through ``binaryFile``, for object stores; skips hidden and empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = F.regexp_replace("path", r"\A[a-z]+:/*(?=/)", "")
    return files.select(
        F.lit(repo).alias("repo"),
        paths.relative_path(plain, root).alias("path"),
        "content",
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
    )
