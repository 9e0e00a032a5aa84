"""Operator 4: WARC archives in seekable Zstandard bundles.

Every row becomes a WARC/1.1 record. Records collect into frames that
decompress on their own; frames collect into a bundle, which ends in a seek
table (a skippable frame of the seekable format: each frame's compressed and
plain size, then their number and the format's magic number). The index maps
each record's identifier to its bundle, its frame, and the place of the record
in the plain frame, so one record is read by decompressing one frame.

A bundle is one row of a Parquet table (``bundle`` binary) in the shared
folder: Spark's writer commits it, so a lost executor leaves no half file, and
any store that Spark can write will do. ``export`` copies bundles out as
``.warc.zst`` files; plain Zstandard tools read them.

Records with the same payload of at least ``LEAST_BYTES`` bytes share one: the
largest id is the response, the others revisit it and carry its identifier and
the digest and length of the payload, not the payload.

Defined results: a null payload is empty; a null id is written as an empty
one and is smaller than any other; rows that repeat both id and payload are
all responses, or all revisits. An empty table gives no bundle. Other columns
stay out of the archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: Payloads from this size on are shared.
LEAST_BYTES = 1000
#: Plain bytes from which a frame is closed, compressed bytes from which a
#: bundle is, and the compression level.
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 8 << 20
LEVEL = 3

# Fixed values of the seekable format.
_SKIPPABLE = 0x184D2A5E
_SEEKABLE = 0x8F92EAB1

_DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = "array<struct<record:string,frame:int,offset:bigint,length:bigint>>"
_BUNDLE = f"bundle binary, records {_INDEX}"
_INDEX_TYPE = pa.list_(pa.struct([("record", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))


def record_types(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """``id, url, payload, size, sha1, record_type, refers_to``.

    Only groups of equal payloads (by size and SHA-256) with more than one
    record are joined back; small payloads, which never share, take no part in
    the join. Where one payload has most rows Spark splits its join."""
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"),
                        F.coalesce(pages[payload_col], F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long"))
    large = rows.filter(F.col("size") >= LEAST_BYTES).withColumn("same", F.unhex(F.sha2("payload", 256)))
    groups = (large.groupBy("same").agg(F.max("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
              .filter(F.col("n") > 1).select("same", "first_id"))
    joined = large.join(stored(groups, "archive-groups"), "same", "left")
    revisit = F.coalesce(F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id")), F.lit(False))
    shared = joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")) \
        .withColumn("refers_to", F.when(revisit, F.col("first_id"))).drop("same", "first_id")
    small = rows.filter(F.col("size") < LEAST_BYTES).withColumn("record_type", F.lit("response")) \
        .withColumn("refers_to", F.lit(None).cast(rows.schema["id"].dataType))
    return shared.unionByName(small).withColumn("sha1", F.sha1("payload"))


def _base32(sha1: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1)).decode()


def record_id(id_) -> str:
    return f"urn:page:{'' if id_ is None else id_}"


def write_record(id_, url: str | None, payload: bytes, size: int, sha1: str, kind: str, refers_to) -> bytes:
    """One WARC record. A revisit's block has the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(id_)}>", f"WARC-Date: {_DATE}",
             "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
             f"WARC-Payload-Digest: sha1:{_base32(sha1)}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(data: bytes):
    """``(offset, headers, block)`` of each record in a plain frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        size = int(headers["Content-Length"])
        yield at, headers, data[end + 4:end + 4 + size]
        at = end + 4 + size + 4


class Bundle:
    """Frames under way; ``close`` appends the seek table."""

    def __init__(self):
        import zstandard

        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.bytes = 0
        self.plain: list[bytes] = []
        self.plain_bytes = 0
        self.index: list[dict] = []

    def add(self, name: str, record: bytes) -> None:
        self.index.append({"record": name, "frame": len(self.frames), "offset": self.plain_bytes, "length": len(record)})
        self.plain.append(record)
        self.plain_bytes += len(record)
        if self.plain_bytes >= FRAME_BYTES:
            self._end_frame()

    def _end_frame(self) -> None:
        if self.plain:
            frame = self.zip.compress(b"".join(self.plain))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.plain_bytes))
            self.bytes += len(frame)
            self.plain, self.plain_bytes = [], 0

    def close(self) -> pa.RecordBatch:
        self._end_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        data = b"".join(self.frames) + struct.pack("<II", _SKIPPABLE, len(table)) + table
        return pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([self.index], _INDEX_TYPE)], ["bundle", "records"])


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """``(start, compressed size, plain size)`` of each frame, from the end."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    table = bundle[len(bundle) - 9 - n * entry:len(bundle) - 9]
    out, at = [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", table, i * entry)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(bundle: bytes, table: list[tuple[int, int, int]], frame: int) -> bytes:
    import zstandard

    start, packed, plain = table[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[start:start + packed], max_output_size=plain)


def read_record(bundle: bytes, frame: int, offset: int, length: int) -> tuple[dict, bytes]:
    """One record by its place in the index: decompresses its frame alone."""
    data = read_frame(bundle, seek_table(bundle), frame)[offset:offset + length]
    _, headers, block = next(read_records(data))
    return headers, block


def write(pages: DataFrame, path: str, id_col: str, url_col: str, payload_col: str) -> None:
    """Archive ``pages`` under ``path``: a Parquet table of bundles, each with
    its index. A task holds one frame and one bundle at a time."""

    def run(batches):
        bundle = Bundle()
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                bundle.add(record_id(r["id"]), write_record(
                    r["id"], r["url"], r["payload"] if r["record_type"] == "response" else b"", r["size"], r["sha1"],
                    r["record_type"], r["refers_to"]))
                if bundle.bytes >= BUNDLE_BYTES:
                    yield bundle.close()
                    bundle = Bundle()
        if bundle.index:
            yield bundle.close()

    rows = record_types(pages, id_col, url_col, payload_col).select(
        "id", "url", F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b"")).alias("payload"),
        "size", "sha1", "record_type", "refers_to")
    rows.mapInArrow(run, _BUNDLE).write.parquet(path)


_READ = "record string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Every record of an archive, frame by frame through the seek tables. A
    response's length and digest are those of the payload that was read, and
    must be those its headers give; a revisit's come from its headers."""

    def run(batches):
        for b in batches:
            for bundle in b.column("bundle"):
                data = bundle.as_py()
                table = seek_table(data)
                for k in range(len(table)):
                    rows = [_parsed(h, block, payload) for _, h, block in read_records(read_frame(data, table, k))]
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ_TYPE)

    # Bundles do not shrink further, so a partition holds as many as its bytes say.
    return spark.read.schema(_BUNDLE).parquet(path).select("bundle").mapInArrow(run, _READ)


_READ_TYPE = pa.schema([("record", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _parsed(headers: dict, block: bytes, keep: bool) -> dict:
    size, digest = int(headers["X-Payload-Length"]), base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    body = None
    if headers["WARC-Type"] == "response":
        body = block[block.index(b"\r\n\r\n") + 4:]
        if (len(body), hashlib.sha1(body).hexdigest()) != (size, digest):
            raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
    refers = headers.get("WARC-Refers-To")
    return {"record": headers["WARC-Record-ID"][1:-1], "url": headers["WARC-Target-URI"], "record_type": headers["WARC-Type"],
            "refers_to": refers[1:-1] if refers else None, "payload_bytes": size, "payload_digest": digest,
            "payload": body if keep else None}


def index(spark: SparkSession, path: str) -> DataFrame:
    """``record, bundle_file, bundle_row, frame, offset, length``: where each
    record lies; ``bundle_row`` numbers the bundles of a file."""
    table = spark.read.schema(_BUNDLE).parquet(path)
    return table.select(F.col("_metadata.file_path").alias("bundle_file"), F.col("_metadata.row_index").alias("bundle_row"),
                        F.explode("records").alias("r")).select("r.record", "bundle_file", "bundle_row", "r.frame", "r.offset", "r.length")


def export(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Copy the bundles to ``folder`` (mounted on every executor) as
    ``.warc.zst`` files, named by their content, each written aside and then
    put in place: a repeated task writes the same file again."""

    def run(batches):
        import os

        for b in batches:
            names = []
            for bundle in b.column("bundle"):
                data = bundle.as_py()
                name = os.path.join(folder, hashlib.sha1(data).hexdigest() + ".warc.zst")
                with open(f"{name}.{os.getpid()}.part", "wb") as f:
                    f.write(data)
                os.replace(f.name, name)
                names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["file"])

    return spark.read.schema(_BUNDLE).parquet(path).select("bundle").mapInArrow(run, "file string")
