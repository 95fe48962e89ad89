"""Web archives (WARC 1.1, one gzip member per record) written from and read into tables.

Both ways a payload is a run of rows (record identifier, chunk number, bytes), so a task
holds one chunk of it and never the whole record. Reading carries the digest and length of
the payload along from chunk to chunk; the last row of a record has those of the whole.

Task attempts write files of their own names under the given folder, and a manifest that
Spark commits lists the files of the attempts that counted. What a lost task left behind
is in no manifest and is never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.texts import arrow_schema

# Bytes of a payload in one row, and bytes of an archive after which the next one begins.
CHUNK = 1 << 20
ARCHIVE = 256 << 20

CHUNK_SCHEMA = (
    "file string, record_id string, record_type string, target_uri string, refers_to string, "
    "stated_digest string, chunk_no bigint, data binary, payload_bytes bigint, "
    "payload_digest string, last boolean"
)

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_OK = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def _files(folder: str):
    """File system and path of a folder name with or without a scheme."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def payload_records(
    pages: DataFrame,
    *,
    least_bytes: int = 0,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
) -> DataFrame:
    """Which row is a response and which one revisits an earlier equal payload.

    Returns `key`, `url`, `payload` (binary), `payload_bytes`, `sha1`, `record_type` and
    `refers_to`. Of rows whose payloads are equal and have `least_bytes` or more, the one
    with the smallest key is the response. Rows that repeat that key with that payload are
    responses too. A null payload is an empty one. A null key revisits if any equal
    payload has a key, and else is a response. Equal payloads meet by their digest alone;
    the payloads of a digest that very many rows share are dealt over several tasks by
    the skew handling of the join.
    """
    rows = pages.select(
        F.col(key).alias("key"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).select("*", F.octet_length("payload").cast("bigint").alias("n"), F.sha1("payload").alias("sha1"))
    first = rows.groupBy("sha1").agg(F.min("key").alias("first"))
    again = (
        F.col("first").isNotNull()
        & ~F.col("key").eqNullSafe(F.col("first"))
        & (F.col("n") >= least_bytes)
    )
    return rows.join(first, "sha1").select(
        "key",
        "url",
        "payload",
        F.col("n").alias("payload_bytes"),
        "sha1",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def record_head(row: dict, date: str) -> bytes:
    """Header of a record with the HTTP header that opens its block."""
    import base64
    from urllib.parse import quote

    http = HTTP_OK.format(row["payload_bytes"]).encode()
    digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
    revisit = row["record_type"] == "revisit"
    lines = [
        VERSION,
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <urn:record:{'' if row['key'] is None else row['key']}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else row['payload_bytes'])}",
    ]
    if row["url"] is not None:
        # Printable ASCII stays; what could end a header line is escaped.
        safe = "".join(map(chr, range(33, 127)))
        lines.append(f"WARC-Target-URI: {quote(row['url'], safe=safe)}")
    if revisit:
        lines.append(f"WARC-Refers-To: <urn:record:{row['refers_to']}>")
        lines.append(f"WARC-Profile: {PROFILE}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_warc(records: DataFrame, folder: str) -> None:
    """Write the rows of `payload_records` as archives with a manifest under `folder`.

    An empty table gives an empty manifest. Rows are written as often as they occur.
    """
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    whole = F.col("record_type") != "revisit"
    steps = F.when(whole, F.ceil(F.col("payload_bytes") / CHUNK)).otherwise(0)
    chunks = records.select(
        "*", F.explode(F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0)))).alias("chunk_no")
    ).select(
        "key",
        "url",
        "payload_bytes",
        "sha1",
        "record_type",
        "refers_to",
        "chunk_no",
        F.when(
            whole, F.expr(f"substring(payload, CAST(chunk_no * {CHUNK} + 1 AS INT), {CHUNK})")
        ).alias("data"),
    )

    def write(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        number, out, done = 0, None, []
        written = records_in = 0
        packer = None

        def finish_record() -> None:
            nonlocal packer, written
            if packer is not None:
                end = packer.compress(b"\r\n\r\n") + packer.flush()
                written += out.write(end) or len(end)
                packer = None

        def finish_file() -> None:
            nonlocal out, written, records_in, number
            finish_record()
            if out is not None:
                out.close()
                done.append((name, records_in, written))
                out, written, records_in, number = None, 0, 0, number + 1

        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk_no"] == 0:
                    finish_record()
                    if written >= ARCHIVE:
                        finish_file()
                    if out is None:
                        name = f"{task.partitionId():05d}-{task.taskAttemptId()}-{number}.warc.gz"
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                    records_in += 1
                    data = packer.compress(record_head(row, date) + (row["data"] or b""))
                else:
                    data = packer.compress(row["data"])
                out.write(data)
                written += len(data)
        finish_file()
        columns = list(zip(*done, strict=True)) or [[], [], []]
        types = [pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=t) for c, t in zip(columns, types, strict=True)],
            names=["file", "records", "bytes"],
        )

    chunks.mapInArrow(write, "file string, records bigint, bytes bigint").write.parquet(
        f"{folder}/manifest"
    )


class _Reader:
    """Bytes of a file of gzip members, a bounded piece at a time."""

    def __init__(self, stream):
        import zlib

        self.stream, self.new = stream, lambda: zlib.decompressobj(31)
        self.member, self.raw, self.held = self.new(), b"", b""

    def fill(self) -> bool:
        """Hold some more bytes; False at the end of the file."""
        while True:
            if not self.raw:
                self.raw = self.stream.read(CHUNK)
                if not self.raw:
                    return False
            data = self.member.decompress(self.raw, CHUNK)
            self.raw = self.member.unconsumed_tail
            if self.member.eof:
                self.raw = self.member.unused_data
                self.member = self.new()
            if data:
                self.held += data
                return True

    def head(self) -> bytes | None:
        """Up to the next empty line, without it; None at the end of the file."""
        while (end := self.held.find(b"\r\n\r\n")) == -1:
            if not self.fill():
                return None
        found, self.held = self.held[:end], self.held[end + 4 :]
        return found

    def some(self, most: int) -> bytes:
        """At least one byte, at most `most`."""
        if not self.held and not self.fill():
            raise EOFError("the archive ends within a record")
        found, self.held = self.held[:most], self.held[most:]
        return found


def _named(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in lines.decode().split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def file_chunks(stream, file: str) -> Iterator[dict]:
    """The chunk rows of one archive."""
    import base64
    import hashlib

    reader = _Reader(stream)
    while (head := reader.head()) is not None:
        named = _named(head)
        http = reader.head()
        named_http = _named(http)
        left = int(named["content-length"]) - len(http) - 4
        row = {
            "file": file,
            "record_id": named["warc-record-id"].strip("<>"),
            "record_type": named["warc-type"],
            "target_uri": named.get("warc-target-uri"),
            "refers_to": (named.get("warc-refers-to") or "").strip("<>") or None,
            "stated_digest": named["warc-payload-digest"].removeprefix("sha1:"),
        }
        if row["record_type"] == "revisit":
            # The block ends with the HTTP header, which tells the length it had.
            length = int(named_http["content-length"])
            yield row | {
                "chunk_no": 0,
                "data": b"",
                "payload_bytes": length,
                "payload_digest": row["stated_digest"],
                "last": True,
            }
        else:
            digest, size, number = hashlib.sha1(), 0, 0
            while left or not number:
                data = reader.some(min(left, CHUNK)) if left else b""
                digest.update(data)
                left, size = left - len(data), size + len(data)
                yield row | {
                    "chunk_no": number,
                    "data": data,
                    "payload_bytes": size,
                    "payload_digest": base64.b32encode(digest.digest()).decode(),
                    "last": not left,
                }
                number += 1
        rest = 4
        while rest:
            rest -= len(reader.some(rest))


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk rows of the archives that the manifest under `folder` lists.

    One row per record and chunk: `data` has the bytes of the chunk, `payload_bytes` and
    `payload_digest` (bare base32 SHA-1) cover the payload up to its end, and `last` marks
    the last one. A revisit is one row without data that states length and digest of the
    payload it repeats. Each file is a task's work; no manifest row, no rows.
    """
    manifest = spark.read.schema("file string, records bigint, bytes bigint").parquet(
        f"{folder}/manifest"
    )
    files = manifest.count()
    schema = arrow_schema(CHUNK_SCHEMA)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        source, root = _files(folder)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with source.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    rows, size = [], 0
                    for row in file_chunks(stream, file):
                        rows.append(row)
                        size += 512 + len(row["data"])
                        if size >= 8 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return manifest.select("file").repartition(max(files, 1)).mapInArrow(read, CHUNK_SCHEMA)
