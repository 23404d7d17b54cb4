"""WARC archives: a writer with one gzip member per record, and a sequential reader.

The writer puts pages into archives of bounded size in a shared folder. A payload is stored once, as the `response` of
its largest page; other pages with it become `revisit` records. A task's archives are named after its attempt and
listed in a manifest that Spark commits, so what failed attempts leave behind is never read.

The reader walks an archive from its start: it inflates piece by piece, starts anew at each gzip member, frames the
record by its content length and checks block and payload digests while the bytes pass.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha1

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.tables import shared_folder, written

ARCHIVE_BYTES = 64 << 20
READ_BYTES = 256 << 10
BATCH_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
RECORDS = ("path string, place long, type string, page_id long, refers_to long, uri string, payload binary, "
           "payload_bytes long, payload_digest string, intact boolean")


# --- writing --------------------------------------------------------------------------------------------------------

def base32_sha1(data: bytes) -> str:
    return base64.b32encode(sha1(data).digest()).decode()


def name_of(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A whole record: a revisit holds the head of the response, without the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri or "")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name_of(page_id)}",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
             f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name_of(refers_to)}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def with_responses(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, revisit, refers_to. Of equal payloads of at least `least` bytes, the largest page_id is the
    response; rows that share that id are all responses, and so are rows of a payload without any id."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    first = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("keeper"),
                                                                              F.count(F.lit(1)).alias("copies"))
    first = first.where("copies > 1 and keeper is not null").drop("copies")
    return rows.join(first, ["digest", "bytes"], "left").select(
        "page_id", "url", "html", (F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))).alias("revisit"),
        F.col("keeper").alias("refers_to"))


def write_archives(pages: DataFrame, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each page (page_id, url, html); returns the manifest: path, records, bytes."""
    folder = shared_folder(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        out, done, records, size, made = None, [], 0, 0, 0

        def close():
            nonlocal out, records, size
            if out is not None:
                out.close()
                done.append((path, records, size))
            out, records, size = None, 0, 0

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{root}/{context.partitionId():06d}-{context.taskAttemptId()}-{made:04d}.warc.gz"
                    out, made = store.open_output_stream(path), made + 1
                data = member(record(row["page_id"], row["url"], row["html"].encode(), row["refers_to"], row["revisit"]))
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= archive_bytes:
                    close()
        close()
        for path, n, b in done:
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64()), "bytes": pa.array([b], pa.int64())})

    manifest = written(with_responses(pages, least).mapInArrow(run, MANIFEST), "warc-manifest")
    scheme = re.match(r"[a-z0-9+.-]+://[^/]*|[a-z0-9+.-]+:(?=/)", folder)
    return manifest.withColumn("path", F.concat(F.lit(scheme[0] if scheme else ""), "path"))


# --- reading --------------------------------------------------------------------------------------------------------

@dataclass
class Member:
    """One record while its bytes arrive."""

    held: bytearray = field(default_factory=bytearray)
    headers: dict[str, str] | None = None
    left: int = 0  # bytes of the block still to come
    body: bool = False  # the head of the response is over
    block: object = field(default_factory=sha1)
    inner: object = field(default_factory=sha1)
    http: dict[str, str] = field(default_factory=dict)
    payload: bytearray = field(default_factory=bytearray)

    def feed(self, data: bytes) -> None:
        self.held += data
        if self.headers is None:
            end = self.held.find(b"\r\n\r\n")
            if end < 0:
                return
            first, self.headers = parsed(self.held[:end])
            if not first.startswith("WARC/"):
                raise ValueError(f"no WARC record: {first[:40]!r}")
            self.left = int(self.headers["content-length"])
            del self.held[:end + 4]
        take = bytes(self.held[:self.left])
        if take:
            del self.held[:len(take)]
            self.left -= len(take)
            self.block.update(take)
            self.pass_on(take)

    def pass_on(self, data: bytes) -> None:
        if not self.body:
            self.payload += data
            end = self.payload.find(b"\r\n\r\n")
            if end < 0:
                return
            _, self.http = parsed(self.payload[:end])
            data, self.body = bytes(self.payload[end + 4:]), True
            self.payload.clear()
        self.inner.update(data)
        self.payload += data

    def row(self, path: str, place: int) -> dict:
        h = self.headers
        if h is None or self.left or bytes(self.held) != b"\r\n\r\n":
            raise ValueError(f"{path} at {place}: the record's length is not its content length")
        said = h["warc-payload-digest"].removeprefix("sha1:")
        intact = base64.b32encode(self.block.digest()).decode() == h["warc-block-digest"].removeprefix("sha1:")
        revisit = h["warc-type"] == "revisit"
        if not revisit:
            intact &= base64.b32encode(self.inner.digest()).decode() == said and len(self.payload) == int(self.http["content-length"])
        return {"path": path, "place": place, "type": h["warc-type"], "page_id": page_of(h["warc-record-id"]),
                "refers_to": page_of(h["warc-refers-to"]) if revisit else None, "uri": h["warc-target-uri"],
                "payload": None if revisit else bytes(self.payload), "payload_bytes": int(self.http["content-length"]),
                "payload_digest": said, "intact": intact}


def parsed(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode().split("\r\n")
    return first, {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}


def page_of(name: str) -> int | None:
    number = name.removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def records_of(stream, path: str, piece: int = READ_BYTES) -> Iterator[dict]:
    """The records of an archive, in order; `place` is the offset of the record's gzip member."""
    place, taken, data = 0, 0, stream.read(piece)
    while data:
        unpack, now = zlib.decompressobj(31), Member()
        while not unpack.eof:
            if not data:
                raise EOFError(f"{path} at {place}: the archive ends inside a record")
            now.feed(unpack.decompress(data))
            taken += len(data) - len(unpack.unused_data)
            data = unpack.unused_data if unpack.eof else stream.read(piece)
        yield now.row(path, place)
        place, data = taken, data or stream.read(piece)


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the listed archives: path, place, type, page_id, refers_to, uri, payload (null in a revisit),
    payload_bytes and payload_digest (of the full payload), intact (all digests and lengths agree).

    A torn or misframed archive ends the job with its path and place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("place", pa.int64()), ("type", pa.string()), ("page_id", pa.int64()),
                            ("refers_to", pa.int64()), ("uri", pa.string()), ("payload", pa.binary()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, inner = fs.FileSystem.from_uri(path)
                held, size = [], 0
                with store.open_input_stream(inner) as stream:
                    for row in records_of(stream, path):
                        held.append(row)
                        size += 500 + len(row["payload"] or b"")
                        if size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    spark = manifest.sparkSession
    tasks = max(1, spark.sparkContext.defaultParallelism, manifest.rdd.getNumPartitions())
    return manifest.select("path").repartition(tasks).mapInArrow(run, RECORDS)
