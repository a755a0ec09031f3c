"""WARC writer and splittable reader.

Writer: each task appends gzip members, one per record, to its own archive in the shared folder and returns a manifest
row; only archives of the manifest's committed tasks count, so retried or doubled tasks leave no duplicates. Payload
digests decide who is the response; only digests and ids are shuffled for that, then the pages once, by their own id.

Reader: archives are cut into byte ranges without any index. A task looks for gzip magic in its range, proves a
candidate by decoding it up to ``WARC/1.``, and owns every record that starts inside, reading on past the range's end
for the last one. Memory is one range plus one record.

Damage is an error, never a shorter result: an archive must have the size its manifest states; its first member must
begin at 0; from the first member of a range on, members must follow each other without a gap, up to the first that
starts beyond the range, whose header is decoded too; and a member that begins like a WARC record must decode to its end,
with the payload its header states.

Files are opened through pyarrow.fs, which serves local, HDFS and object-store addresses alike.

Defined results: null html is an empty payload. A null page_id is larger than any other and is referred to only if it
is null everywhere, in which case all its records are responses. Rows that share the smallest page_id of their payload
are all responses. A null url is written as ``urn:x-none`` and read back as null; blanks and controls in urls are
percent-encoded. Empty tables give no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrid.runtime import by_value, slices, stage, staged_path

by_value(__name__)

MAGIC, SPLIT_BYTES, ARCHIVE_BYTES = b"\x1f\x8b\x08", 16 << 20, 1 << 30
#: Date of all records; a crawl would give each its own.
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, bytes long, records long"
RECORD = "archive string, at long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _name(page_id) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page(name: str):
    value = name.rsplit(":", 1)[1].rstrip(">")
    return None if value == "null" else int(value)


def _uri(url) -> str:
    return "urn:x-none" if url is None else "".join(c if c > " " and c not in "%\x7f" else "".join(f"%{x:02X}" for x in c.encode()) for c in url)


def _url(uri: str):
    from urllib.parse import unquote

    return None if uri == "urn:x-none" else unquote(uri)


def record(page_id, url, payload: bytes, refers_to=None, revisit: bool = False, min_revisit: int = 0) -> bytes:
    """One gzip member. A revisit keeps the HTTP header, with the payload's length, but not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[2:2] = [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def archive_header() -> bytes:
    body = b"software: callgrid\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head + body + b"\r\n\r\n") + z.flush()


def with_record_types(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """(page_id, url, html, revisits, refers_to): revisits where an equal payload has a smaller page_id."""
    digest = F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    light = stage(pages.select("page_id", digest.alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size")), "warc-digests")
    firsts = light.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("refers_to"),
        F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    again = light.join(firsts, "digest").where("page_id IS NULL OR page_id > refers_to").groupBy("page_id", "digest").agg(F.min("refers_to").alias("refers_to"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), digest.alias("digest"))
    same = rows["page_id"].eqNullSafe(again["page_id"]) & (rows["digest"] == again["digest"])
    return rows.join(again, same, "left").select(rows["page_id"], "url", "html", "refers_to")


def write_warc(pages: DataFrame, folder: str, min_revisit: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all rows (page_id, url, html) as records under ``folder``; returns the manifest (path, bytes, records)."""

    def write(batches):
        task = TaskContext.get()
        out, done, number = None, [], 0

        def close():
            out.close()
            done.append((path, size, n))

        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        for b in slices(batches, 64):
            for page_id, url, html, refers_to in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None or size >= archive_bytes:
                    if out is not None:
                        close()
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{number}-{uuid.uuid4().hex[:8]}.warc.gz"
                    path, number, n = f"{folder}/{name}", number + 1, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                    size = out.write(head := archive_header()) or len(head)
                data = record(page_id, url, html.encode(), refers_to, refers_to is not None)
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "bytes", "records"])

    return stage(with_record_types(pages, min_revisit).mapInArrow(write, MANIFEST), "warc-manifest")


class _Reading:
    """A stretch of an archive that grows as members are read on."""

    def __init__(self, source, start: int, end: int, size: int):
        source.seek(start)
        self.source, self.start, self.size, self.data = source, start, size, bytearray(source.read(end - start))

    def has(self, at: int, n: int) -> bool:
        """Whether ``n`` bytes from ``at`` are there, or all that the archive has."""
        while at + n > len(self.data) and self.start + len(self.data) < self.size:
            more = self.source.read(max(1 << 16, at + n - len(self.data)))
            if not more:
                break
            self.data += more
        return at + n <= len(self.data)

    def begins(self, at: int) -> bool:
        """Whether a gzip member with a WARC record begins at ``at``."""
        if not self.has(at, len(MAGIC)) or self.data[at : at + len(MAGIC)] != MAGIC:
            return False
        z, head, fed = zlib.decompressobj(31), b"", at
        try:
            while len(head) < 7 and not z.eof and self.has(fed, 1):
                piece = bytes(self.data[fed : fed + 512])
                head, fed = head + z.decompress(piece), fed + len(piece)
        except zlib.error:
            return False
        return head.startswith(b"WARC/1.")

    def member(self, at: int) -> tuple[bytes, int]:
        """Content and end of the member that begins at ``at``."""
        z, parts, fed = zlib.decompressobj(31), [], at
        try:
            while not z.eof and self.has(fed, 1):
                piece = bytes(self.data[fed : fed + (1 << 16)])
                fed += len(piece)
                parts.append(z.decompress(piece))
        except zlib.error as e:
            raise ValueError(f"broken record at byte {self.start + at}: {e}") from None
        content = b"".join(parts)
        if not z.eof or b"\r\n\r\n" not in content:
            raise ValueError(f"record at byte {self.start + at} is cut off")
        return content, fed - len(z.unused_data)


def _members(source, start: int, end: int, size: int):
    """(offset, content) of the gzip members of WARC records that start in [start, end)."""
    reading, at, found = _Reading(source, start, end, size), 0, False
    while start + at < end:
        if reading.begins(at):
            content, after = reading.member(at)
            yield start + at, content
            at, found = after, True
        elif found or start == 0:
            raise ValueError(f"no record begins at byte {start + at}")
        else:  # before the first member of the range lies the end of one that started earlier
            at = reading.data.find(MAGIC[:1], at + 1)
            if at < 0:
                return
    if found and start + at < size and not reading.begins(at):
        raise ValueError(f"no record begins at byte {start + at}")


def _parsed(content: bytes):
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    if fields["WARC-Type"] not in ("response", "revisit"):
        return None
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    n = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    if fields["WARC-Type"] == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != stated or n != len(payload):
            raise ValueError(f"record {fields['WARC-Record-ID']}: payload of {len(payload)} bytes has digest {found}, its header says {n} and {stated}")
    refers = fields.get("WARC-Refers-To")
    return _page(fields["WARC-Record-ID"]), _url(fields["WARC-Target-URI"]), n, stated, fields["WARC-Type"], _page(refers) if refers else None, payload


def read_warc(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payload: bool = False) -> DataFrame:
    """All response and revisit records of the archives (path, bytes): RECORD, and the payload if asked for."""
    ranges = manifest.select("path", "bytes", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {split_bytes}L)")).alias("start"))
    n = manifest.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("bytes") / split_bytes)))).first()[0] or 1
    ranges = ranges.repartition(int(n), "path", "start")  # a stated number: rows are small, but each is a range to read
    schema = RECORD + (", payload binary" if payload else "")
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.binary()] if payload else [])]
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches):
        for b in batches:
            for path, size, start in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                system, name = _open(path)
                rows = []
                with system.open_input_file(name) as source:
                    if source.size() != size:
                        raise ValueError(f"{path} has {source.size()} bytes, its manifest says {size}")
                    for at, content in _members(source, start, min(size, start + split_bytes), size):
                        if (got := _parsed(content)) is not None:
                            rows.append((path, at, *(got if payload else got[:-1])))
                        if len(rows) >= 1000 or payload and len(rows) >= 50:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return ranges.mapInArrow(read, schema)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    manifest = write_warc(pages, staged_path(spark, "warc"))
    return read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


SQL = """
WITH rows AS (SELECT page_id, url, sha1(coalesce(html, '')) AS hex, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM rows)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to, url
FROM firsts
"""
