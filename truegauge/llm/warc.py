"""WARC archives: writing pages with revisits, and a splittable reader.

Every record is a gzip member of its own. The reader deals out byte ranges: a task looks
for the gzip magic in its range, takes a candidate as a record only if it decodes to a
WARC header, owns the records that start inside its range and reads the last one to its
end beyond it. Payloads are UTF-8, in which the magic cannot occur, so a compressed block
that stores its input unchanged holds no false record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truegauge.llm.shared import stored
from truegauge.session import scratch_dir

#: Equal payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: Bytes of a range, of an archive file, and of one read.
RANGE_BYTES, ARCHIVE_BYTES, READ_BYTES = 16 << 20, 1 << 30, 1 << 20
MAGIC = b"\x1f\x8b\x08"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Pages carry no fetch time.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def urn(key) -> str:
    return f"<urn:page:{'' if key is None else key}>"


def key_of(name: str | None) -> str | None:
    """The page's key; the id itself where another writer made it."""
    if not (name or "").startswith("<urn:page:"):
        return name or None
    return name.removeprefix("<urn:page:").removesuffix(">") or None


def content(headers: dict[str, str], block: bytes) -> bytes | None:
    """The payload of a record: what follows HTTP headers, else the block; None for revisits."""
    if headers["warc-type"] == "revisit":
        return None
    return block.partition(b"\r\n\r\n")[2] if _is_http(headers, block) else block


def _is_http(headers: dict[str, str], block: bytes) -> bool:
    named = headers.get("content-type")
    return named.lower().startswith("application/http") if named else block.startswith(b"HTTP/")


def declared_sha1(headers: dict[str, str]) -> str | None:
    """The payload's SHA-1 in hex as the header has it, in base 32 or 16; None without one."""
    kind, _, value = headers.get("warc-payload-digest", "").partition(":")
    if kind.strip().lower() != "sha1":
        return None
    return base64.b32decode(value.strip().upper()).hex() if len(value.strip()) == 32 else value.strip().lower()


def record(key, url: str | None, payload: bytes, refers_to, revisit: bool) -> bytes:
    """One compressed record; control characters of the address are percent-encoded."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = HTTP if revisit else HTTP + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(key)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if revisit:
        lines += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "replace")
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def mark_revisits(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key``, url and html with ``revisit`` and ``refers_to``.

    Of payloads that are equal and at least ``REVISIT_BYTES`` long the one with the
    largest key stays a response, the others revisit it. Rows that repeat the largest
    key are all responses. A null key is no largest key unless all are null.
    """
    page = pages.select(F.col(key).alias("key"), F.col("url").cast("string").alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    page = page.withColumn("digest", F.when(F.octet_length("html") >= REVISIT_BYTES, F.sha1("html")))
    last = page.where("digest is not null").groupBy("digest").agg(F.max("key").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = page.join(last.drop("n"), "digest", "left")
    revisit = F.col("last").isNotNull() & ~F.col("key").eqNullSafe(F.col("last"))
    return joined.select("key", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("last")).alias("refers_to"))


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Archives of ``mark_revisits`` rows in ``folder``; returns their ``path`` and ``bytes``.

    Every attempt of a task writes files of its own, and only those of the attempt that
    counts are listed, so that lost executors and repeated tasks leave no record twice.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, path, done = None, "", 0
        for batch in batches:
            for key, url, html, revisit, refers_to in zip(*(batch.column(i) for i in range(5))):
                member = record(key.as_py(), url.as_py(), html.as_py().encode("utf-8", "replace"), refers_to.as_py(), revisit.as_py())
                if out is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    out, path, done = fs.open_output_stream(f"{root}/{name}", compression=None), f"{folder}/{name}", 0
                out.write(member)
                done += len(member)
                if done >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [done]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [done]})

    return stored(marked.select("key", "url", "html", "revisit", "refers_to").mapInArrow(write, "path string, bytes long"), "archives")


class Archive:
    """Reads of one open archive, and its records by byte position."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size = file, size

    def read(self, at: int, count: int) -> bytes:
        return bytes(self.file.read_at(min(count, self.size - at), at)) if at < self.size else b""

    def find(self, at: int, end: int) -> int:
        """Where the next magic starts in [at, end), else -1."""
        while at < end:
            found = self.read(at, min(READ_BYTES, end - at) + len(MAGIC) - 1).find(MAGIC)
            if found >= 0:
                return at + found
            at += READ_BYTES
        return -1

    def member(self, at: int) -> tuple[dict[str, str], bytes, int] | None:
        """Headers, block and end of the record at ``at``; None if there is none.

        What starts as a WARC header is read to its end, however long it is.
        """
        unpack, plain, position, headers, searched = zlib.decompressobj(31), bytearray(), at, None, 0
        while not unpack.eof:
            chunk = self.read(position, READ_BYTES // 16)
            if not chunk:
                if not plain.startswith(b"WARC/1."):
                    return None
                raise ValueError(f"record at byte {at} is cut off")
            position += len(chunk)
            try:
                plain += unpack.decompress(chunk)
            except zlib.error:
                if not plain.startswith(b"WARC/1."):
                    return None
                raise
            if headers is None:
                if not plain.startswith(b"WARC/1."[: len(plain)]):
                    return None
                stop = plain.find(b"\r\n\r\n", searched)
                if stop < 0:
                    searched = max(0, len(plain) - 3)
                    continue
                fields = (line.partition(":") for line in plain[:stop].decode("utf-8", "replace").split("\r\n")[1:])
                headers = {name.strip().lower(): value.strip() for name, _, value in fields}
                if not headers.get("content-length", "").isdigit() or "warc-type" not in headers:
                    return None
        if headers is None:
            return None
        block = bytes(plain[stop + 4 : stop + 4 + int(headers["content-length"])])
        return headers, block, position - len(unpack.unused_data)

    def records(self, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
        """All records that start in [start, end)."""
        at = self.find(start, end)
        while at >= 0:
            found = self.member(at)
            if found:
                yield found[:2]
            at = self.find(found[2] if found else at + 1, end)


def read_archives(archives: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = False) -> DataFrame:
    """The records of the listed archives (``path``, ``bytes``), range by range.

    Rows: key and refers_to as text (null if absent), url, record_type, payload_bytes,
    payload_digest (hex) and, if asked for, the payload (null for revisits). Length and
    digest are those of the payload; a revisit has what its headers declare, else null. A
    response whose payload does not have its declared SHA-1 is an error.
    """
    fields = [T.StructField(n, T.StringType()) for n in ("key", "refers_to", "url", "record_type", "payload_digest")]
    schema = T.StructType([*fields, T.StructField("payload_bytes", T.LongType()), *[T.StructField("payload", T.BinaryType())] * with_payload])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                fs, place = pa.fs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                held = 0
                with fs.open_input_file(place) as file:
                    for headers, block in Archive(file, size).records(start, min(start + range_bytes, size)):
                        kind = headers["warc-type"]
                        payload, declared = content(headers, block), declared_sha1(headers)
                        if payload is not None:
                            digest = hashlib.sha1(payload).hexdigest()
                            if kind == "response" and declared not in (None, digest):
                                raise ValueError(f"{path}: payload of {headers.get('warc-record-id')} is damaged")
                            declared = digest
                        length = headers.get("x-payload-length", "")
                        length = len(payload) if payload is not None else int(length) if length.isdigit() else None
                        row = (key_of(headers.get("warc-record-id")), key_of(headers.get("warc-refers-to")), headers.get("warc-target-uri"), kind, declared, length)
                        rows.append((*row, payload) if with_payload else row)
                        held += len(payload or b"") if with_payload else 0
                        if len(rows) >= 4096 or held > READ_BYTES * 8:
                            yield _batch(rows, schema)
                            rows, held = [], 0
                yield _batch(rows, schema)

    ranges = archives.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    return ranges.repartition(max(1, ranges.count()), "path", "start").mapInArrow(read, schema)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(f.name, pa.string())) for f, c in zip(schema, columns)], schema.fieldNames())


def round_trip(pages: DataFrame, key: str = "page_id", html: str = "html", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pages written as archives to the shared folder and read back.

    A null html is an empty payload. Repeated rows give repeated records; a null key comes
    back as null; a null url is left out of the record. An empty table gives none.
    """
    folder = scratch_dir(pages.sparkSession, "warc")
    found = read_archives(write_archives(mark_revisits(pages, key, html), folder), range_bytes)
    kind = pages.schema[key].dataType
    return found.select(F.col("key").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
