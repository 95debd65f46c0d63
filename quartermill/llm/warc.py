"""Operator 8: WARC archives, written per task and read back by byte ranges.

Writing: one .warc.gz per task of the shuffle, one gzip member per record, first under a
name of the attempt, then renamed, so a retried task replaces its own file. Reading: a
task owns a byte range, scans it for gzip magic, takes a candidate only if it inflates to
a WARC header, and reads each record that starts inside its range to the end, past the
range's end if need be.

Defined results: null html is the empty payload; among equal payloads each row with the
largest page_id is the response (null page_ids only if there is no other); an empty
table writes no archive and reads no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import batches, bound_batches, fresh_path, part_rows, utf8

#: Bytes a reading task owns; bytes a step of the scan holds.
RANGE, STEP = 32 << 20, 1 << 20
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1.1\r\n"
WROTE = "path string, bytes long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, when: str) -> bytes:
    """One WARC record as a gzip member; a revisit keeps the HTTP head, which states the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", when), ("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if kind == "revisit":
        fields[3:3] = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"
    return pack.compress(raw) + pack.flush()


def _writer(folder: str, when: str):
    def write(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        name = f"{root}/part-{context.partitionId():06d}.warc.gz"
        temporary, size, out = f"{name}.{context.taskAttemptId()}", 0, None
        try:
            for b in batches(source):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(temporary, compression=None)
                ids, urls, kinds, refers = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "kind", "refers_to"))
                for row in zip(ids, urls, utf8(b, "html"), kinds, refers):
                    size += out.write(member := record(*row, when)) or len(member)
        except BaseException:
            if out is not None:
                out.close()
                fs.delete_file(temporary)
            raise
        if out is not None:
            out.close()
            fs.move(temporary, name)
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{context.partitionId():06d}.warc.gz"]), pa.array([size], pa.int64())], names=["path", "bytes"])

    return write


def classified(pages: DataFrame) -> DataFrame:
    """pages with kind and refers_to: the largest page_id of equal payloads is the response."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # largest ids of shares of the rows first, then of digests: the html of a common page is dealt over as many tasks as it has shares
    rows = rows.withColumn("share", F.expr(f"cast(pmod(xxhash64(page_id, url), {part_rows(pages.sparkSession)}) as int)"))
    shares = rows.groupBy("digest", "share").agg(F.max("page_id").alias("first"))
    first = shares.groupBy("digest").agg(F.max("first").alias("first"))
    joined = rows.join(shares.select("digest", "share").join(first, "digest"), ["digest", "share"])
    is_first = F.expr("page_id <=> first")
    return joined.select("page_id", "url", "html", F.when(is_first, "response").otherwise("revisit").alias("kind"), F.when(~is_first, F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives; returns their names and sizes (a few rows, written already)."""
    bound_batches(pages.sparkSession)
    when = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = classified(pages).mapInArrow(_writer(folder, when), WROTE).collect()
    return pages.sparkSession.createDataFrame(rows or [("", 0)], WROTE).where("bytes > 0")


class Window:
    """A file's bytes from a position on, read in steps; keeps no more than a step beyond what was asked for."""

    def __init__(self, stream, at: int):
        self.stream, self.at, self.data = stream, at, b""
        stream.seek(at)

    def need(self, n: int) -> bool:
        """Whether n bytes are there from `at` on."""
        while len(self.data) < n and (more := self.stream.read(STEP)):
            self.data += more
        return len(self.data) >= n

    def skip(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def parsed(raw: bytes) -> tuple:
    """A record's row in the order of READ."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda x: int(n) if (n := x.rpartition(":")[2].rstrip(">")) not in ("", "None") else None
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (length, digest) != (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload isn't what its record says")
    return number(fields["WARC-Record-ID"]), length, digest, kind, number(fields["WARC-Refers-To"]) if kind == "revisit" else None, fields["WARC-Target-URI"], payload if kind == "response" else None


def member_at(window: Window) -> tuple[bytes, int] | None:
    """The record whose gzip member starts at the window's position, and the member's length; None if none does."""
    inflate, out, used = zlib.decompressobj(31), [], 0
    first = True
    while not inflate.eof:
        if not window.need(used + 1):
            return None
        piece = window.data[used : used + (4096 if first else STEP)]
        try:
            out.append(inflate.decompress(piece))
        except zlib.error:
            return None
        used += len(piece)
        if first and len(out[0]) >= len(VERSION):
            if not out[0].startswith(b"WARC/1."):
                return None
            first = False
    if first and not b"".join(out).startswith(b"WARC/1."):
        return None
    return b"".join(out), used - len(inflate.unused_data)


def records(stream, start: int, end: int) -> Iterator[tuple]:
    """Rows of the records that start in [start, end)."""
    window = Window(stream, start)
    while window.at < end:
        if not window.need(len(MAGIC)):
            return
        found = window.data.find(MAGIC)
        if found < 0:
            window.skip(max(1, len(window.data) - len(MAGIC) + 1))
            continue
        window.skip(found)
        if window.at >= end:
            return
        if got := member_at(window):
            yield parsed(got[0])
            window.skip(got[1])
        else:
            window.skip(1)


def _reader(folder: str, keep_payload: bool):
    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in READ.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

        for b in batches(source):
            for path, start, end in zip(*(c.to_pylist() for c in b.columns)):
                rows, held = [], 0
                with fs.open_input_file(f"{root}/{path}") as stream:
                    for r in records(stream, start, end):
                        rows.append(r if keep_payload else (*r[:6], None))
                        held += len(r[6] or b"") if keep_payload else 100
                        if held > STEP << 2:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return read


def read_warc(spark: SparkSession, folder: str, files: DataFrame, span: int = RANGE, keep_payload: bool = True) -> DataFrame:
    """All records under folder: files (path, bytes) are cut into ranges of `span` bytes, one task each."""
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(span).cast("long"))).alias("start"), "bytes")
    ranges = ranges.select("path", "start", F.least(F.col("start") + span, F.col("bytes")).alias("end"))
    n = max(1, ranges.count())
    return ranges.repartition(n, "path", "start").mapInArrow(_reader(folder, keep_payload), READ)


def warc_round_trip(pages: DataFrame, span: int = RANGE) -> DataFrame:
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    files = write_warc(pages, folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)
    return read_warc(spark, folder, files, span, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
