"""WARC archives: a writer with revisit records and a reader that splits the files by byte ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redpencil.llm.common import stored

SPLIT_BYTES = 8 << 20   # byte range of one reading task
READ_BYTES = 256 << 10  # bytes fetched at a time
MAGIC = b"\x1f\x8b\x08"
# Fixed values of the format: version line, media types and revisit profile
VERSION = b"WARC/1.1"
RESPONSE_TYPE = "application/http; msgtype=response"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

READ_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("at", T.LongType()), T.StructField("bytes", T.LongType()),
    T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()),
    T.StructField("uri", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("key", T.StringType()), T.StructField("refers_key", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("digest_ok", T.BooleanType()), T.StructField("payload", T.BinaryType())])


def _store(folder: str):
    """The file system of a folder's address and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """Add refers_to: the smallest id among equal payloads, for all rows but that one.

    Equal payloads meet by SHA-1, counted before the shuffle; only digests with several rows are
    joined back. Payloads below ``min_bytes`` never refer.
    """
    hashed = pages.withColumn("__sha1", F.sha1(F.col(payload_col)))
    big = F.octet_length(payload_col) >= min_bytes
    first = (hashed.where(big).groupBy("__sha1").agg(F.min(id_col).alias("__first"), F.count("*").alias("__n"))
             .where("__n > 1").select("__sha1", "__first"))
    met = hashed.join(stored(first, "payloads"), "__sha1", "left")
    other = big & F.col("__first").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("__first"))
    return met.withColumn("refers_to", F.when(other, F.col("__first"))).drop("__sha1", "__first")


def _record(key, uri: str | None, payload: bytes, refers, date: str) -> bytes:
    digest = base32_sha1(payload)
    name = lambda k: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{k}')}>"
    revisit = refers is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": name(key), "WARC-Date": date,
            "WARC-Target-URI": " ".join((uri or "").split()), "Content-Type": RESPONSE_TYPE,
            "WARC-Payload-Digest": f"sha1:{digest}", "X-Row-Key": "" if key is None else str(key)}
    if revisit:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": name(refers), "X-Refers-To-Key": str(refers)}
    head |= {"Content-Length": str(len(block))}
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items())
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
                   min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write one record for each row, one gzip member for each record; returns the files written.

    Each task writes a file of its own name and reports it only when closed. The list of files is
    stored, so a task that was lost or ran twice leaves at most a file that nobody reads. Files go
    straight to the shared file system in ``folder``.

    Defined cases: a null payload is empty; null urls are empty; of rows that repeat the smallest
    id of a payload all are responses; a row without id revisits a row with one; an empty table
    writes no file.
    """
    bytes_of = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    narrow = pages.select(F.col(id_col).alias("key"), F.col(uri_col).cast("string").alias("uri"), bytes_of.alias("payload"))
    rows = with_revisits(narrow, "key", "payload", min_revisit_bytes).withColumns(
        {"key": F.col("key").cast("string"), "refers_to": F.col("refers_to").cast("string")})

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(folder)
        path, out, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for frame in frames:
            for key, uri, payload, refers in zip(frame["key"], frame["uri"], frame["payload"], frame["refers_to"], strict=True):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(path, compression=None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(_record(key, uri, bytes(payload), refers, date)) + packer.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "bytes": [size], "records": [n]})

    columns = rows.select("key", "uri", "payload", "refers_to")
    return stored(columns.mapInPandas(write, "path string, bytes long, records long"), "archives")


class _Window:
    """Bytes of a file around a position, fetched in blocks as the reader moves on."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.base, self.data = file, size, 0, b""

    def fetch(self, at: int, n: int) -> bytes:
        """Up to n bytes from ``at``; fewer only at the end of the file."""
        if not (self.base <= at and at + n <= self.base + len(self.data)):
            self.file.seek(at)
            self.base, self.data = at, self.file.read(max(n, READ_BYTES))
        return self.data[at - self.base:at - self.base + n]


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The record that starts at ``at`` and the end of its member; None if none does.

    The first bytes are decoded first: unless they spell the version line, the magic was chance.
    """
    unpack, got, here = zlib.decompressobj(31), [], at
    try:
        first = unpack.decompress(window.fetch(at, 512), 64)
        if not first.startswith(b"WARC/1."):
            return None
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            block = window.fetch(here, 64 << 10)
            if not block:
                return None
            got.append(unpack.decompress(block))
            here += len(block)
        return b"".join(got), here - len(unpack.unused_data)
    except zlib.error:
        return None


def _parse(record: bytes) -> dict | None:
    """The fields of a record; None if its header does not name a type and a length."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]  # foreign headers may hold any bytes
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    if "warc-type" not in fields or not fields.get("content-length", "").isdecimal():
        return None
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    claimed = fields.get("warc-payload-digest", "").partition(":")[2]
    found = claimed if revisit else base32_sha1(payload)
    sizes = (v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length")
    length = next((int(v) for v in sizes if v.isdigit()), None)
    return {"record_type": fields["warc-type"], "record_id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"),
            "date": fields.get("warc-date"), "key": fields.get("x-row-key") or None, "refers_key": fields.get("x-refers-to-key"),
            "payload_bytes": length if revisit else len(payload), "payload_digest": found, "digest_ok": found == claimed,
            "payload": None if revisit else payload}


def records_in(file, size: int, start: int, end: int) -> Iterator[tuple[int, int, dict]]:
    """(offset, bytes, fields) of the records whose members start in [start, end)."""
    window, at = _Window(file, size), start
    while at < min(end, size):
        block = window.fetch(at, READ_BYTES)
        found = block.find(MAGIC)
        if found < 0:
            at += max(1, len(block) - len(MAGIC) + 1)
            continue
        at += found
        if at >= end:
            return
        member = _member(window, at)
        fields = None if member is None else _parse(member[0])
        if fields is None:
            at += 1
            continue
        yield at, member[1] - at, fields
        at = member[1]


def read_archives(spark: SparkSession, files: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES,
                  with_payload: bool = True) -> DataFrame:
    """Read the records of gzip archives, several tasks to a file.

    ``files`` has path and bytes. A task scans its byte range for the gzip magic, accepts a place
    only if the header decoded there is a record's, and owns the records that start inside its
    range, to their end beyond it. So every record is read once, whatever ``split_bytes`` is. A
    damaged member, or one whose header names no type or length, is passed over and the scan goes
    on behind its first byte. Records of other writers carry no row key: key and refers_key are null.

    A payload that itself holds a whole stored (not deflated) archive member could be taken for a
    record where a range starts inside it; the writer above always deflates.
    """
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)),
                                                                F.lit(split_bytes).cast("long"))).alias("start"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _store(folder)
        names = [f.name for f in READ_SCHEMA]
        for frame in frames:
            for path, size, start in zip(frame["path"], frame["bytes"], frame["start"], strict=True):
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    for at, length, fields in records_in(file, size, start, start + split_bytes):
                        if not with_payload:
                            fields["payload"] = None
                        rows.append({"path": path, "at": at, "bytes": length, **fields})
                        held += len(fields["payload"] or b"") + 500
                        if held > 16 << 20:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})

    tasks = max(1, ranges.count())
    # ranges are few and carry no payload; one partition each lets every core read
    return ranges.repartition(min(tasks, 10_000), "path", "start").mapInPandas(read, READ_SCHEMA)
