"""WARC records in ZIP archives: a writer, and a reader that never extracts.

An archive is a ZIP file with two stored members, `archive/data.warc.gz` (one
gzip member per record) and `indexes/index.cdx` (offset, length, record type
and digest per record).  The reader takes the end-of-central-directory record
(and its ZIP64 forms) from the file's tail, parses the central directory,
finds where each stored member's bytes begin, and then reads single records by
range.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialize

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: A task starts a new archive when one has so many bytes.
ARCHIVE_BYTES = 64 << 20
#: Index lines and records are read by ranges of about so many bytes.
RANGE = 4 << 20
#: The repeated payloads are broadcast up to so many rows (of 50 bytes), joined by exchange beyond.
BROADCAST_ROWS = 400_000
# Fixed values of the ZIP format.
EOCD, EOCD64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, sha: str, refers: int | None) -> bytes:
    """One WARC record, uncompressed; a revisit if it refers to another. A revisit has no block and names the payload's length in a header of its own."""
    revisit = refers is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers)}"]
    block = b"" if revisit else payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    if len(rest) < n + 4 or rest[n : n + 4] != b"\r\n\r\n":
        raise ValueError("a record's block ends early")
    return fields, rest[:n]


class ArchiveWriter:
    """Streams records into one archive; only the index is held in memory."""

    def __init__(self, out, zip64: bool = True):
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=zip64)
        self.at, self.lines = 0, []

    def add(self, raw: bytes, kind: str, sha: str) -> None:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        data = z.compress(raw) + z.flush()
        self.member.write(data)
        self.lines.append(f"{self.at} {len(data)} {kind} {sha}\n")
        self.at += len(data)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.lines))
        self.zip.close()


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    local: int  # where its local header begins


class ArchiveReader:
    """Members of a ZIP file by its central directory; file needs read(), seek() and size."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.members = {m.name: m for m in self._directory()}

    def range(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        out = self.file.read(n)
        if len(out) != n:
            raise ValueError("the archive ends early")
        return out

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.size - (22 + MAX16))
        tail = self.range(tail_at, self.size - tail_at)
        at = tail.rfind(EOCD, 0, len(tail) - 18)
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(EOCD, 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
        if MAX16 == entries or MAX32 in (length, offset):
            locator = self.range(tail_at + at - 20, 20)
            if locator[:4] == LOCATOR64:
                end = self.range(struct.unpack_from("<Q", locator, 8)[0], 56)
                if end[:4] != EOCD64:
                    raise ValueError("no ZIP64 end of central directory")
                entries, length, offset = struct.unpack_from("<QQQ", end, 32)
        block, p = self.range(offset, length), 0
        for _ in range(entries):
            if block[p : p + 4] != CENTRAL:
                raise ValueError("bad central directory")
            method = struct.unpack_from("<H", block, p + 10)[0]
            packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", block, p + 20)
            local = struct.unpack_from("<I", block, p + 42)[0]
            name = block[p + 46 : p + 46 + n_name].decode()
            extra = block[p + 46 + n_name : p + 46 + n_name + n_extra]
            p += 46 + n_name + n_extra + n_note
            e = 0
            while e + 4 <= len(extra):
                tag, n = struct.unpack_from("<HH", extra, e)
                if tag == 1:  # ZIP64: 8 bytes for each field that is all ones, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                    plain = next(wide) if plain == MAX32 else plain
                    packed = next(wide) if packed == MAX32 else packed
                    local = next(wide) if local == MAX32 else local
                e += 4 + n
            yield Member(name, method, packed, local)

    def stored(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, by its local header, and how many they are."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is compressed in the archive and can't be read by range")
        head = self.range(m.local, 30)
        if head[:4] != LOCAL:
            raise ValueError("no local header")
        return m.local + 30 + sum(struct.unpack_from("<HH", head, 26)), m.size

    def chunks(self, name: str, n: int = RANGE) -> Iterator[bytes]:
        start, size = self.stored(name)
        for a in range(0, size, n):
            yield self.range(start + a, min(n, size - a))

    def index(self) -> Iterator[tuple[int, int, str, str]]:
        rest = b""
        for chunk in self.chunks(INDEX):
            *lines, rest = (rest + chunk).split(b"\n")
            for line in lines:
                a, n, kind, sha = line.decode().split()
                yield int(a), int(n), kind, sha

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """Every indexed record; neighbours are fetched with one range of RANGE bytes or one record."""
        (start, size), have, held = self.stored(DATA), 0, b""
        for a, n, _, _ in self.index():
            if not (have <= a and a + n <= have + len(held)):
                have, held = a, self.range(start + a, min(max(n, RANGE), size - a))
            yield read_record(zlib.decompress(held[a - have : a - have + n], 31))


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder, which the driver and every executor must reach; raises where there is none for its scheme.

    Spark's names of S3 (s3a, s3n) are S3.  HDFS needs its native library on
    every machine.
    """
    if "://" not in folder:
        return pafs.LocalFileSystem(), folder
    scheme, rest = folder.split("://", 1)
    try:
        return pafs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")
    except Exception as error:
        raise ValueError(f"archives can't be kept in {folder}: {error}") from error


def repeated(pages: DataFrame) -> DataFrame:
    """(sha, top) of payloads that occur more than once, with their largest page_id (null if all are null); counted from digests alone, with partial counts before the exchange."""
    sums = pages.select(F.col("page_id").cast("long"), _sha().alias("sha")).groupBy("sha").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    return materialize(sums.filter("n > 1 and top is not null").select("sha", "top"), "warc-top")


def _sha() -> Column:
    return F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write every page as a record; returns (path, records), a row per archive, which is all that counts as written.

    Of records with equal payloads the one with the largest page_id is the
    response (each such row, if repeated), the others revisit it; rows without
    a page_id revisit it too, however many, and are responses where no other
    is.  Repeated payloads meet their pages by digest: sent to all tasks if few,
    else in an exchange that splits frequent ones.  A task that is run again
    writes other files; those of the lost attempt are named by no row.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    file_system(folder)
    top = repeated(pages)
    few = top.count() <= BROADCAST_ROWS
    page = pages.select(F.col("page_id").cast("long"), "url", "html").withColumn("sha", _sha())
    page = page.join(F.broadcast(top) if few else top, "sha", "left").select("page_id", "url", "html", "sha", "top")

    def work(batches):
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        now, name, n, done = None, "", 0, []

        def close():
            now[1].close()
            now[0].close()
            done.append((f"{root}/{name}", n))

        for batch in batches:
            for page_id, url, html, sha, largest in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    out = fs.open_output_stream(f"{root}/{name}")
                    now, n = (out, ArchiveWriter(_Counted(out))), 0
                payload, sha = (html or "").encode(), base64.b32encode(bytes.fromhex(sha)).decode()
                refers = None if largest == page_id else largest
                now[1].add(record(page_id, url, payload, sha, refers), "response" if refers is None else "revisit", sha)
                n += 1
                if now[1].at >= ARCHIVE_BYTES:
                    close()
                    now = None
        if now:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["path", "records"])

    return materialize(page.mapInArrow(work, "path string, records long"), "warc-manifest")


class _Counted(io.RawIOBase):
    """A write-only stream without seek; zipfile then writes sizes behind the data."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def write(self, data) -> int:
        self.out.write(data)
        return len(data)


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), a row per record in the manifest's archives.

    Digests of responses are computed anew from the payload and must agree
    with the header.
    """

    def work(batches):
        fs, _ = file_system(folder)
        page_of = lambda x: int(x[10:-1]) if len(x) > 11 else None
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_file(path) as file:
                    rows: list[tuple] = []
                    for fields, block in ArchiveReader(file, file.size()).records():
                        kind, sha, n = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                        if kind == "response":
                            sha, n = digest(block), len(block)
                            if f"sha1:{sha}" != fields["WARC-Payload-Digest"]:
                                raise ValueError(f"{path}: a payload doesn't match its digest")
                        rows.append((page_of(fields["WARC-Record-ID"]), n, sha, kind, page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None))
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    # archives are few and of bounded size: one to a task where there are tasks enough
    spread = manifest.select("path").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4)
    return spread.mapInArrow(work, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives in the shared folder, then read them all back. An empty table gives no rows."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)


#: Base 32 of a SHA-1: each five hexadecimal digits are four characters.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), q AS (SELECT page_id, html, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS top FROM p),
d AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || h[5 * i + 1 : 5 * i + 5] AS INTEGER)) AS v FROM q)
SELECT page_id, strlen(html) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1]), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM d
"""
