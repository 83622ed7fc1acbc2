"""WARC archives written from and read into tables of payload chunks.

A payload is rows (record, chunk number, bytes): chunks are cut in the scan, so a
payload is one value only where the table's reader makes it. They are ordered by record
and number in each archive's task, and pass through one compressor and one running digest. Reading gives such rows back, each with
the digest of the payload so far.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspan.llm.common import stored, text_of
from longspan.session import checkpoint_dir

CHUNK_BYTES = 1 << 20
ARCHIVE_BYTES = 32 << 20
# Fixed values of the WARC 1.1 and HTTP formats.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

MANIFEST = "path string, records long, bytes long"
CHUNKS = (
    "path string, record_id string, page_id long, url string, record_type string, refers_to long, chunk int, "
    "chunk_bytes long, payload_bytes long, payload_digest string, last boolean, payload binary"
)


def chunk_table(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
    least_revisit_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per record and chunk of payload, with the record's head fields.

    Of rows with equal payloads (SHA-1 and length) of ``least_revisit_bytes`` or
    more, the one with the smallest id, then url (nulls last), is a response; the
    others revisit it and carry no payload. A null payload is empty, an empty payload
    is one chunk of no bytes, repeated rows are records of their own: of rows equal in
    everything one is the response.

    Which record leads is found from ids, urls, digests and lengths alone. Payloads
    are cut in the scan, and only chunks move, by their record's key; the column
    ``row`` is that key, null where nothing refers to the record. A payload that
    very many pages share spreads over its pages.
    """
    payload = text_of(payload_column).cast("binary")
    rows = pages.select(
        F.col(id_column).cast("long").alias("page_id"),
        F.regexp_replace(F.col(url_column).cast("string"), r"[\r\n]", "%0A").alias("url"),
        F.octet_length(payload).cast("long").alias("length"), F.sha1(payload).alias("sha1"), payload.alias("payload"))
    small = F.col("length") < least_revisit_bytes

    def key(prefix: str = "") -> Column:
        """Names a record by what it is, so that it is the same in every run of a task."""
        named = F.struct(F.col(f"{prefix}page_id").alias("page"), F.col(f"{prefix}url").alias("url"))
        return F.md5(F.concat(F.to_json(named), "sha1", F.col("length").cast("string")).cast("binary"))

    heads = rows.where(~small).groupBy("sha1", "length", "page_id", "url").agg(F.count(F.lit(1)).alias("copies"))
    least = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    firsts = stored(
        rows.where(~small).groupBy("sha1", "length").agg(F.min(least).alias("first"))
        .select("sha1", "length", F.col("first.page_id").alias("first_page"), key("first.").alias("first_row")))
    others = heads.join(firsts, ["sha1", "length"]).withColumn(
        "copies", F.col("copies") - F.when(key() == F.col("first_row"), 1).otherwise(0)).where("copies > 0")
    none = F.lit(None).cast("string")
    head = ["page_id", "url", "sha1", "length"]
    revisits = others.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        none.alias("row"), *head, F.lit(False).alias("own"), F.lit(0).alias("chunk"), F.lit(True).alias("last"),
        F.col("first_page").alias("refers_to"), "first_row", F.lit(None).cast("binary").alias("piece"))

    chunks = F.greatest(F.ceil(F.col("length") / chunk_bytes), F.lit(1)).cast("int")

    def cut(records: DataFrame, row: Column) -> DataFrame:
        numbered = records.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
        piece = F.substring(F.col("payload"), F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes))
        return numbered.select(
            row.alias("row"), *head, F.lit(True).alias("own"), "chunk", (F.col("chunk") == chunks - 1).alias("last"),
            F.lit(None).cast("long").alias("refers_to"), none.alias("first_row"), piece.alias("piece"))

    leaders = firsts.select(F.col("first_row").alias("row"))
    responses = cut(rows.where(~small), key()).repartition("row").join(leaders, "row", "left_semi").sortWithinPartitions("row", "chunk")
    written = responses.unionByName(revisits)
    return written.unionByName(cut(rows.where(small), none)) if least_revisit_bytes > 0 else written


def _record_id(row: str | None, sha1: str) -> str:
    """A record without a key is referred to by none."""
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{row}:{sha1}'.encode()).hexdigest()) if row else uuid.uuid4()}>"


def _uri(path: str) -> str:
    """Spark's file:/x as the file:///x that other readers expect."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def _head(row: dict, date: str) -> bytes:
    fields = [
        ("WARC-Type", "response" if row["own"] else "revisit"),
        ("WARC-Record-ID", _record_id(row["row"], row["sha1"])),
        ("WARC-Date", date),
        ("WARC-Target-URI", row["url"]),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["sha1"])).decode()),
        ("WARC-Profile", None if row["own"] else PROFILE),
        ("WARC-Refers-To", None if row["own"] else _record_id(row["first_row"], row["sha1"])),
        ("X-Refers-To-Page", row["refers_to"]),
        ("X-Page-ID", row["page_id"]),
        ("X-Payload-Length", row["length"]),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(HTTP_HEAD) + (row["length"] if row["own"] else 0)),
    ]
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields if v is not None)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + HTTP_HEAD


def _archive_writer(folder: str, date: str, level: int, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        out, member, name, records, before = None, None, "", 0, (None, 0)

        def finished() -> pa.RecordBatch:
            size = out.tell()
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [records], "bytes": [size]})

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                # Rows equal in everything sent the same chunks; their record is written once.
                if row["row"] is not None and (row["row"], row["chunk"]) == before:
                    continue
                before = (row["row"], row["chunk"])
                if row["chunk"] == 0:  # every record is a gzip member
                    if out and out.tell() >= archive_bytes:
                        yield finished()
                        out, records = None, 0
                    if out is None:
                        # A name of its own for each attempt; only those of finished tasks reach the manifest.
                        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                        out = files.open_output_stream(f"{base}/{name}", compression=None)
                    member = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(member.compress(_head(row, date)))
                    records += 1
                out.write(member.compress(row["piece"] or b""))
                if row["last"]:
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
        if out:
            yield finished()
    return write


def write_archives(
    chunks: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES,
    date: str = "2024-01-01T00:00:00Z", level: int = 6,
) -> DataFrame:
    """Write the records as .warc.gz files into ``folder``; returns the manifest of finished files.

    ``chunks`` must have each record's chunks one after the other, as
    ``chunk_table`` cuts them; they are written where they are, without another
    shuffle. A file past ``archive_bytes`` is followed by a new one. A retried task
    writes new files under new names and only finished ones are listed, so lost
    executors leave no half archive in the result. ``date`` is
    every record's WARC-Date. No records, no files.
    """
    return stored(chunks.mapInArrow(_archive_writer(_uri(folder), date, level, archive_bytes), MANIFEST))


def _records(stream, chunk_bytes: int) -> Iterator[dict]:
    """Chunk rows of one archive, read forwards."""
    while first := stream.readline():
        if first.strip() != VERSION:
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        head = {}
        while line := stream.readline().rstrip(b"\r\n"):
            key, _, value = line.decode("utf-8").partition(":")
            head[key.lower()] = value.strip()
        left = int(head["content-length"])
        while left:
            line = stream.readline()
            left -= len(line)
            if line == b"\r\n":
                break
        own = head["warc-type"] == "response"
        said = head["warc-payload-digest"].removeprefix("sha1:")
        row = {
            "record_id": head["warc-record-id"], "url": head.get("warc-target-uri"), "record_type": head["warc-type"],
            "page_id": int(head["x-page-id"]) if "x-page-id" in head else None,
            "refers_to": int(head["x-refers-to-page"]) if "x-refers-to-page" in head else None,
        }
        digest, done, chunk = hashlib.sha1(), 0, 0
        while True:
            piece = stream.read(min(chunk_bytes, left)) if left else b""
            if left and not piece:
                raise ValueError(f"{row['record_id']} ends early")
            left -= len(piece)
            done += len(piece)
            digest.update(piece)
            so_far = base64.b32encode(digest.digest()).decode()
            if own and not left and so_far != said:
                raise ValueError(f"{row['record_id']} does not have its digest")
            yield row | {
                "chunk": chunk, "chunk_bytes": len(piece), "last": not left, "payload": piece,
                "payload_bytes": done if own else int(head["x-payload-length"]),
                "payload_digest": so_far if own else said,
            }
            chunk += 1
            if not left:
                break
        stream.read(4)


def _archive_reader(schema: pa.Schema, chunk_bytes: int, payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, name = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with files.open_input_stream(name, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for row in _records(stream, chunk_bytes):
                        row["path"] = path
                        if payload:
                            held += row["chunk_bytes"]
                        else:
                            row["payload"] = None
                        rows.append(row)
                        if len(rows) >= 4096 or held >= 4 * chunk_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)
    return read


_ARROW = pa.schema([
    ("path", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk", pa.int32()), ("chunk_bytes", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("last", pa.bool_()), ("payload", pa.binary()),
])


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, payload: bool = True) -> DataFrame:
    """Chunk rows of all archives of a manifest (column path), one task per few archives.

    Each row carries the bytes and the SHA-1 (base32) of the payload up to and
    with its chunk; at a record's last row they are those of the whole payload,
    checked against the record's head. A revisit is one row without payload,
    with the figures of its head. ``payload=False`` leaves the bytes out.
    """
    spread = manifest.select("path").repartition(max(1, manifest.count()))
    return spread.mapInArrow(_archive_reader(_ARROW, chunk_bytes, payload), CHUNKS)


def archive_folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame, folder: str | None = None, least_revisit_bytes: int = 0) -> DataFrame:
    """Write all pages, read the archives, one row per page."""
    chunks = chunk_table(pages, least_revisit_bytes=least_revisit_bytes)
    manifest = write_archives(chunks, folder or archive_folder(pages.sparkSession))
    return read_archives(manifest, payload=False).where("last").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
