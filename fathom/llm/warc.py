"""WARC archives: a writer that deduplicates payloads by revisit records, and a splittable reader.

Each record is one gzip member. Reader tasks own byte ranges of the archives: a task scans its
range for gzip magic, takes a candidate for a member if it inflates to a WARC header, and owns the
records whose member starts inside its range, reading past the end of the range to finish the last.
Archives lie in a folder that driver and executors share; they are reached through pyarrow.fs.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.shared import shared_dir

MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of an archive that one reader task owns, of one read, and from which a writer starts another archive.
SPLIT, READ, ROTATE = 8 << 20, 1 << 20, 1 << 30
#: Compressed bytes that are inflated at once: what lies behind a small record is not copied, and what comes out is bounded.
INFLATE = 16 << 10
SALT = 16


def _filesystem(uri: str):
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    return pafs.FileSystem.from_uri(uri)


def record(page_id, url: str | None, payload: bytes | None, length: int, digest: str, refers_to=None, date: str = DATE) -> bytes:
    """One gzip member with a response, or with a revisit of page refers_to (then the payload is left out)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or ""), f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + z.flush()


def _writer(folder: str, rotate: int):
    def run(batches):
        task = TaskContext.get()
        fs, path = _filesystem(folder)
        out, name, size, count, number = None, "", 0, 0, 0

        def close():
            out.close()
            fs.move(f"{name}.{task.taskAttemptId()}", name)  # an attempt's archive appears whole or not at all
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rpartition('/')[2]}"]), pa.array([size]), pa.array([count])], ["path", "bytes", "records"])

        for batch in batches:
            for page, url, html, first in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "html", "first")), strict=True):
                if out is None:
                    name = f"{path}/part-{task.partitionId():06d}-{number:04d}.warc.gz"
                    out, size, count, number = fs.open_output_stream(f"{name}.{task.taskAttemptId()}"), 0, 0, number + 1
                payload = (html or "").encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                member = record(page, url, payload, len(payload), digest, first)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= rotate:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, id_col="page_id", url_col="url", html_col="html", least: int = 0, rotate: int = ROTATE) -> DataFrame:
    """Writes a record for each row and returns the archives as rows (path, bytes, records).

    Of rows with equal payloads of at least `least` bytes the one with the smallest id is a
    response and the others revisit it; rows that repeat that id are responses too, as are rows
    without an id where no row of the payload has one. A null html is an empty payload. Payloads
    are compared by SHA-1 and length before anything wide moves; a payload that many rows share is
    met by them in SALT places. No rows give no archives; other columns are ignored. The folder is the
    caller's to remove.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    fs, path = _filesystem(folder)
    fs.create_dir(path, recursive=True)
    body = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), body.alias("html"))
    rows = rows.withColumn("length", F.octet_length("html")).withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    shared = rows.groupBy("digest", "length").agg(F.min("page").alias("least"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("length") >= least))
    shared = shared.select("digest", "length", "least", F.explode(F.array(*map(F.lit, range(SALT)))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALT)).cast("int")).join(shared, ["digest", "length", "salt"], "left")
    rows = rows.withColumn("first", F.when(~F.col("page").eqNullSafe(F.col("least")), F.col("least")))
    written = rows.select("page", "url", "html", "first").mapInArrow(_writer(folder, rotate), "path string, bytes long, records long").collect()  # a row for each archive
    return spark.createDataFrame([tuple(x) for x in written], "path string, bytes long, records long")


class _Range:
    """Reads a file from some offset on, keeping only what is still needed; what is dropped is cut off at the next read. What is
    held grows in place, so a record of any length is copied once."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data, self.start = file, at, bytearray(), 0
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(READ)
        del self.data[: self.start]
        self.data += got
        self.start = 0
        return bool(got)

    def left(self) -> int:
        return len(self.data) - self.start

    def drop(self, n: int) -> None:
        self.start, self.at = self.start + n, self.at + n


def _member(source: _Range) -> bytes | None:
    """The inflated WARC record at the range's position, which then stands after it; None if there is none.

    A candidate has no reserved flags, inflates, starts with a WARC version and ends with its checksum.
    """
    while source.left() < 10 and source.more():
        pass
    first = source.data[source.start : source.start + 10]
    if first[:3] != MAGIC or len(first) < 10 or first[3] & 0xE0:
        return None
    z, out, used, head = zlib.decompressobj(31), [], 0, b""
    try:
        while not z.eof:
            if used == source.left() and not source.more():
                return None
            piece = source.data[source.start + used : source.start + used + INFLATE]
            got = z.decompress(piece)
            used += len(piece) - len(z.unused_data)
            if len(head) < 5:
                head += got[:5]
                if not b"WARC/".startswith(head[:5]):
                    return None
            out.append(got)
    except zlib.error:
        return None
    if len(head) < 5:
        return None
    source.drop(used)
    return b"".join(out)


def members(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each member that starts in [start, end)."""
    source = _Range(file, start)
    while source.at < end:
        at = source.at
        found = _member(source)
        if found is not None:
            yield at, found
            continue
        # not a member: on to the next magic, which may straddle two reads
        source.drop(min(1, source.left()))
        while (k := source.data.find(MAGIC, source.start)) < 0 and source.at < end:
            source.drop(max(0, source.left() - 2))
            if not source.more():
                return
        if k >= 0:
            source.drop(k - source.start)


def parse(raw: bytes) -> dict:
    """Fields of one record: type, page_id, url, digest, length and payload of its HTTP message, refers_to."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    page = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:x-page:(-?\d+)>", fields.get(x, ""))) else None
    return {
        "page_id": page("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "refers_to": page("warc-refers-to"),
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "payload_bytes": int(length[1]) if length else len(payload), "payload": payload,
    }


def _reader(payloads: bool):
    names = ["path", "offset", "page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", *["payload"] * payloads]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * payloads]

    def run(batches):
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
                fs, local = _filesystem(path)
                rows, held = [], 0
                with fs.open_input_file(local) as file:
                    for at, raw in members(file, start, end):
                        x = parse(raw)
                        if x["record_type"] == "response" and x["payload_bytes"] != len(x["payload"]):
                            raise ValueError(f"{path}: the record at {at} doesn't have its payload's length")
                        if x["record_type"] == "response" and base64.b32encode(hashlib.sha1(x["payload"]).digest()).decode() != x["payload_digest"]:
                            raise ValueError(f"{path}: the record at {at} doesn't match its payload digest")
                        rows.append([path, at, *(x[n] for n in names[2:])])
                        held += len(raw)
                        if held > READ * 8 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def read_archives(spark: SparkSession, archives: DataFrame, payloads: bool = False, split: int = SPLIT) -> DataFrame:
    """One row per record of the archives (path, bytes): path, offset, page_id, url, record_type,
    refers_to, payload_digest, payload_bytes and, if asked for, payload. Bytes between members that
    are no record are passed over; a truncated last member is left out. No archives give no rows.
    """
    ranges = archives.select("path", "bytes", F.explode(F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split))).alias("start"))
    ranges = ranges.select("path", F.col("start").cast("long").alias("start"), F.least(F.col("start") + split, "bytes").cast("long").alias("end"))
    n = max(1, ranges.count())
    schema = "path string, offset long, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long" + ", payload binary" * payloads
    return ranges.repartition(n).mapInArrow(_reader(payloads), schema)
