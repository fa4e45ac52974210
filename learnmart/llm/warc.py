"""WARC archives: a record per page, one gzip member per record, and a sequential verifying reader."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnmart.llm.common import col, cut, folder_for, ship, table

LEAST_REVISIT_BYTES = 0
ARCHIVE_BYTES = 256 * 1024 * 1024  # an archive is closed beyond this size
READ_BYTES = 1 << 16
MOST_HEADER_BYTES = 1 << 20
DATE = "1970-01-01T00:00:00Z"

# Names of the archive format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE, REVISIT = "response", "revisit"

_ID = "urn:page:"
_UNSAFE = re.compile(r"[\x00-\x20\x7f-\U0010ffff]")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(text: str) -> str:
    """``text`` with blanks, controls and non-ASCII characters percent-encoded: one header line."""
    return _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as one gzip member.

    A response holds the HTTP head and the payload; a revisit the head alone,
    whose Content-Length and digest are those of the full payload.
    """
    digest = sha1_base32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", REVISIT if revisit else RESPONSE),
        ("WARC-Record-ID", f"<{_ID}{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url if url is not None else "about:blank")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{_ID}{refers_to}>")]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a plain path or file:/path is local."""
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def write_archives(batches: Iterator[pa.RecordBatch], folder: str, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    """Archives of one task, and a row (path, records, bytes) for each.

    Names carry the attempt, and only archives listed by the attempt that ended
    count: a lost or repeated task leaves files that nobody reads.
    """
    context = TaskContext.get()
    system, root = _open(folder)
    system.create_dir(root, recursive=True)
    out, path, records, size, number = None, "", 0, 0, 0
    done: list[tuple[str, int, int]] = []
    for batch in batches:
        for page_id, url, html, refers_to, revisit in zip(*(batch.column(i) for i in range(5))):
            if out is None:
                name = f"{context.partitionId():06d}-{number:04d}-{context.taskAttemptId()}.warc.gz"
                path = f"{folder}/{name}"
                out, records, size, number = system.open_output_stream(f"{root}/{name}", compression=None), 0, 0, number + 1
            data = record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py(), revisit.as_py())
            out.write(data)
            records, size = records + 1, size + len(data)
            if size >= archive_bytes:
                out.close()
                done.append((path, records, size))
                out = None
    if out is not None:
        out.close()
        done.append((path, records, size))
    paths, counts, sizes = zip(*done) if done else ((), (), ())
    yield pa.RecordBatch.from_arrays(
        [pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])


@dataclass
class Record:
    headers: dict[str, str]  # names in lower case
    block: bytes


class DamagedArchive(ValueError):
    """An archive that breaks the format or a digest."""


class Members:
    """The members of a gzip stream, one after the other, inflated as they are asked for."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.rest, self.ended = stream, b"", False

    def _more(self) -> bytes:
        if not self.rest and not self.ended:
            self.rest = self.stream.read(READ_BYTES)
            self.ended = not self.rest
        data, self.rest = self.rest, b""
        return data

    def __iter__(self) -> Iterator[Iterator[bytes]]:
        while True:
            self.rest = self._more()
            if not self.rest:
                return
            member = self._inflate()
            yield member
            for _ in member:  # what the caller left
                raise DamagedArchive("a member holds more than its record")

    def _inflate(self) -> Iterator[bytes]:
        packed = zlib.decompressobj(31)
        while not packed.eof:
            data = packed.unconsumed_tail or self._more()
            if not data:
                raise DamagedArchive("the archive ends within a member")
            try:
                part = packed.decompress(data, READ_BYTES)
            except zlib.error as e:
                raise DamagedArchive(str(e)) from e
            if part:
                yield part
        self.rest = packed.unused_data + self.rest


def _read_record(parts: Iterator[bytes]) -> Record:
    """One record from the parts of its member, framed by its content length."""
    held = bytearray()
    while (end := held.find(b"\r\n\r\n")) < 0:
        part = next(parts, None)
        if part is None or len(held) > MOST_HEADER_BYTES:
            raise DamagedArchive("a record without an end of its head")
        held += part
    first, *lines = bytes(held[:end]).decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise DamagedArchive("a member that does not begin with a record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    length = int(headers["content-length"])
    del held[:end + 4]
    while len(held) < length + 4:
        part = next(parts, None)
        if part is None:
            raise DamagedArchive("a record shorter than its content length")
        held += part
    if bytes(held[length:]) != b"\r\n\r\n":
        raise DamagedArchive("a record longer than its content length")
    del held[length:]
    return Record(headers, bytes(held))


def read_records(stream: BinaryIO) -> Iterator[Record]:
    """The records of an archive in order, block digests verified; one record is held at a time."""
    for member in Members(stream):
        found = _read_record(member)
        if (digest := found.headers.get("warc-block-digest")) and digest != f"sha1:{sha1_base32(found.block)}":
            raise DamagedArchive("a block that does not match its digest")
        yield found


def page_of(found: Record) -> tuple:
    """page_id, url, html, payload_bytes, payload_digest, record_type and refers_to of a record, digest verified."""
    headers = found.headers
    number = lambda name: int(x) if (x := headers.get(name, "").strip("<>").removeprefix(_ID)) else None
    head, _, body = found.block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == RESPONSE and (len(body) != length or sha1_base32(body) != digest):
        raise DamagedArchive("a payload that does not match its length or digest")
    html = body.decode() if headers["warc-type"] == RESPONSE else None
    return (number("warc-record-id"), headers["warc-target-uri"], html, length, digest, headers["warc-type"], number("warc-refers-to"))


PAGE = "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read_archives(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in PAGE.split(", ")]
    kinds = dict(zip(names, [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]))
    picked = [names.index(c) for c in columns]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[names[i]]) for i in picked], columns)

    for given in batches:
        for path in given.column("path").to_pylist():
            system, name = _open(path)
            rows, size = [], 0
            with system.open_input_stream(name, compression=None) as stream:
                for found in read_records(stream):
                    rows.append(page_of(found))
                    size += len(found.block) if "html" in columns else 100
                    if size >= 1 << 24:
                        yield batch(rows)
                        rows, size = [], 0
            yield batch(rows)


def read_archives(paths: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The pages in the archives named by ``paths`` (path): one row per record, a task per archive.

    Every record is framed by its content length and held against its digests;
    a damaged archive fails the job.  ``html`` of a revisit is null: its payload
    is that of the page it refers to.
    """
    ship(paths.sparkSession)
    kinds = dict(part.split() for part in PAGE.split(", "))
    columns = columns or list(kinds)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns)
    return paths.select("path").mapInArrow(lambda it: _read_archives(it, columns), schema)


def mark_revisits(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) with ``refers_to`` and ``revisit``.

    Of equal payloads of ``least_bytes`` or more the smallest page_id is the
    response and the others revisit it.  A null page_id comes after all others;
    rows that share the smallest id are responses all.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col("html"), F.lit("")), 256))
    marked = pages.withColumn("digest", digest)
    first = marked.groupBy(F.col("digest").alias("same")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    # only payloads that occur again matter, and only their keys move against the pages
    again = first.filter("n > 1").drop("n")
    joined = marked.join(again, marked.digest == again.same, "left")
    long_enough = F.octet_length(F.coalesce(F.col("html"), F.lit(""))) >= least_bytes
    revisit = F.col("first_id").isNotNull() & long_enough & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("revisit"))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html",
          least_bytes: int = LEAST_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` to archives in ``folder`` and return the written list of them (path, records, bytes).

    ``folder`` must be open to all executors by pyarrow's file systems.  A null
    html is an empty payload, a null url ``about:blank``; other columns are not
    written.  Repeated rows are records of their own, no rows give no archive.
    """
    ship(pages.sparkSession)
    rows = mark_revisits(pages.select(col(id_col).cast("long").alias("page_id"), col(url).alias("url"), col(html).alias("html")),
                         least_bytes)
    listed = rows.mapInArrow(lambda it: write_archives(it, folder, archive_bytes), "path string, records long, bytes long")
    return cut(listed, "warc_list")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives and read back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives = write(pages, folder_for(spark, "warc"))
    tasks = max(1, archives.count())
    return read_archives(archives.repartition(tasks), ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


QUERIES = {"op7_warc": op7_warc}

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {5 * k + 1}, 5))::BIGINT >> {s}) & 31)::INT, 1)"
    for k in range(8) for s in (15, 10, 5, 0)
)

SQL = {
    "op7_warc": f"""
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
            FROM pages)
        SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM p
    """,
}
