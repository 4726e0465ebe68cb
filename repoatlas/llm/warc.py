"""WARC archives: records written from chunk rows and read back as chunk rows.

No task holds a whole payload outside the row it came in: payloads pass as rows
(record, chunk number, bytes), files are written and read piece by piece, and digests
grow with the chunks.
"""

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoatlas.llm.common import (
    arrow_map,
    bounded_broadcast,
    one_task_each,
    open_store,
    task_file,
    written,
)
from repoatlas.sources.workspace import new_dir

# Shorter payloads are stored each time; longer ones once.
REVISIT_BYTES = 100
CHUNK = 1 << 20
FILE_BYTES = 1 << 30
DATE = "2020-01-01T00:00:00Z"
# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_table(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (binary), payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload. Of equal payloads of at least REVISIT_BYTES bytes the
    row with the smallest page_id is the response. Rows that share that page_id are all
    responses; a null page_id is never the smallest unless there is no other. Only
    digests that occur more than once are joined back.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).select(
        "page_id",
        "url",
        "payload",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
    )
    first = (
        rows.where(F.col("payload_bytes") >= REVISIT_BYTES)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where(F.col("n") > 1)
        .select(F.col("payload_digest").alias("first_digest"), "first_id")
    )
    first = bounded_broadcast(first, "warc-first")
    # Payloads without a partner in any case keep a key of their own: no hot null key.
    key = F.when(F.col("payload_bytes") >= REVISIT_BYTES, F.col("payload_digest")).otherwise(
        F.concat(F.lit("-"), F.xxhash64("page_id").cast("string"))
    )
    joined = rows.join(first, key == F.col("first_digest"), "left")
    repeats = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        *rows.columns,
        F.when(repeats, "revisit").otherwise("response").alias("record_type"),
        F.when(repeats, F.col("first_id")).alias("refers_to"),
    )


def chunk_table(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each chunk of a payload, in order; revisits have one empty chunk."""
    stored = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    last = F.greatest(F.ceil(stored / chunk) - 1, F.lit(0)).cast("int")
    parts = records.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))

    def part() -> Column:
        return F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk))

    return parts.withColumn(
        "chunk", F.when(F.col("record_type") == "response", part()).otherwise(F.lit(b""))
    ).drop("payload")


def _name(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(name: str):
    value = name.strip("<>").rpartition(":")[2]
    return None if value == "null" else int(value)


def _head(page_id, url, size, digest, kind, refers_to) -> bytes:
    lines = [
        VERSION,
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Payload-Length: {size}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {''.join(url.split())}")
    http = b""
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    else:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {size}\r\n\r\n"
        http = http.encode()
        lines.append("Content-Type: application/http;msgtype=response")
    lines.append(f"Content-Length: {len(http) + (size if kind == 'response' else 0)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + http


def write_archives(chunks: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the chunk rows as they come; returns the table of archives (folder, path, records)."""
    folder = new_dir(chunks.sparkSession, "warc")
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def write(batches):
        out, path, records, number = None, None, 0, 0
        for batch in batches:
            rows = zip(*(batch[c] for c in (*columns, "chunk_no", "chunk")))
            for *head, chunk_no, chunk in rows:
                if chunk_no == 0:
                    if out is not None:
                        out.write(b"\r\n\r\n")
                    if out is not None and out.tell() > file_bytes:
                        out.close()
                        out = None
                        yield {"path": [path], "records": [records]}
                    if out is None:
                        store, path, _ = task_file(folder, f"-{number}.warc")
                        out = store.open_output_stream(path)
                        records, number = 0, number + 1
                    out.write(_head(*head))
                    records += 1
                out.write(chunk)
        if out is not None:
            out.write(b"\r\n\r\n")
            out.close()
            yield {"path": [path], "records": [records]}

    files = arrow_map(
        chunks.select(*columns, "chunk_no", "chunk"), write, "path string, records long"
    )
    return written(files, "warc-files").withColumn("folder", F.lit(folder))


def _records(source):
    """(header fields, length of the block) of each record; the caller reads the block."""
    while line := source.readline():
        if line.strip() != VERSION.encode():
            raise ValueError("not at the start of a record")
        fields = {}
        while (line := source.readline()).strip():
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            fields[name.lower()] = value.strip()
        yield fields
        if source.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")


def read_archives(files: DataFrame, chunk: int = CHUNK, with_chunks: bool = True) -> DataFrame:
    """Chunk rows of every record of the archives.

    Each row carries the bytes and the digest of the payload up to its end, so the row
    marked ``last`` has those of the full payload. Revisits have one empty chunk and
    carry what their record says of the payload. ``with_chunks=False`` gives only the
    last row of each record, without its bytes.
    """

    def read(batches):
        import io

        for batch in batches:
            for folder, path in zip(batch["folder"], batch["path"]):
                store, _ = open_store(folder)
                with store.open_input_stream(path) as raw:
                    source = io.BufferedReader(raw, 1 << 16)
                    rows, held = [], 0
                    for row in _payload_rows(source, chunk):
                        if with_chunks or row[-1]:
                            row = row if with_chunks else (*row[:-2], None, True)
                            rows.append(row)
                            held += len(row[-2] or b"")
                        if held > 8 * CHUNK or len(rows) >= 4096:
                            yield _columns(rows)
                            rows, held = [], 0
                    yield _columns(rows)

    out = arrow_map(one_task_each(files), read, ", ".join(f"{c} {t}" for c, t in ROW))
    return out if with_chunks else out.drop("chunk")


ROW = (
    ("page_id", "long"),
    ("url", "string"),
    ("record_type", "string"),
    ("refers_to", "long"),
    ("chunk_no", "int"),
    ("payload_bytes", "long"),
    ("payload_digest", "string"),
    ("chunk", "binary"),
    ("last", "boolean"),
)


def _columns(rows):
    return {name: [r[n] for r in rows] for n, (name, _) in enumerate(ROW)}


def _payload_rows(source, chunk: int):
    for fields in _records(source):
        page, url = _page(fields["warc-record-id"]), fields.get("warc-target-uri")
        kind, left = fields["warc-type"], int(fields["content-length"])
        if kind == "revisit":
            size = int(fields["payload-length"])
            digest = fields["warc-payload-digest"].partition(":")[2]
            yield page, url, kind, _page(fields["warc-refers-to"]), 0, size, digest, b"", True
            source.read(left)
            continue
        while (line := source.readline()).strip():
            left -= len(line)
        left -= len(line)
        growing, done, number = hashlib.sha256(), 0, 0
        while True:
            part = source.read(min(left, chunk))
            left -= len(part)
            done += len(part)
            growing.update(part)
            if left and not part:
                raise ValueError("the archive ends within a record")
            yield page, url, kind, None, number, done, growing.hexdigest(), part, not left
            number += 1
            if not left:
                break
