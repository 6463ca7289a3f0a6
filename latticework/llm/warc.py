"""Operator 3: web archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole WARC/1.1 records, and ends in the
seek table of the seekable format (a skippable frame with every frame's compressed and full size).  The
index maps a record's id to its bundle, frame, offset inside the frame and length, so one record is read by
decompressing one frame.

Equal payloads are found by a grouped digest (a group of any size leaves a task as one row); the page with
the largest id holds the payload, the others become revisit records.  Tasks write bundles to the shared
folder and the index names the bundles of the attempts that succeeded; others are never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import cut, shared_dir, table

#: Full bytes after which a frame, and compressed bytes after which a bundle, is closed; compression level.
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 16 << 20, 3
#: Fixed values of the seekable format and of the revisit profile.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


# ---- records


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").rstrip(">")
    return None if name == "null" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes | None, refers_to: int | None, size: int, sha1: str) -> bytes:
    """A response (``payload`` given) or a revisit of ``refers_to``; the block of either begins with the HTTP
    header of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url))
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, bytes, int]:
    """(WARC header, HTTP header, payload, where the record ends) of the record at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return head, http, payload, end + 4 + len(block) + 4


# ---- bundles


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames_of(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, full size) of each frame, from the table at the bundle's end."""
    n, flags, magic = struct.unpack_from("<IBI", data, len(data) - 9)
    if magic != SEEKABLE or flags & 0x7C:
        raise ValueError("no seek table")
    step = 12 if flags & 0x80 else 8
    out, at = [], 0
    for k in range(n):
        packed, full = struct.unpack_from("<II", data, len(data) - 9 - step * (n - k))
        out.append((at, packed, full))
        at += packed
    return out


def read_frame(data: bytes, frame: tuple[int, int, int]) -> bytes:
    at, packed, full = frame
    return zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=max(full, 1))


class Bundle:
    """Frames and the index of one bundle while it is filled."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.frame_bytes, self.zstd = frame_bytes, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.filled = self.packed = 0
        self.index: list[tuple[int, int, int, int]] = []

    def add(self, page_id: int, data: bytes) -> None:
        self.index.append((page_id, len(self.frames), self.filled, len(data)))
        self.open.append(data)
        self.filled += len(data)
        if self.filled >= self.frame_bytes:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            frame = self.zstd.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.filled))
            self.packed += len(frame)
            self.open, self.filled = [], 0

    def bytes(self) -> bytes:
        self.close_frame()
        return b"".join(self.frames) + seek_table(self.sizes)


INDEX = "bundle string, page_id long, frame int, at long, length long"


def write_bundles(pages: DataFrame, folder: str, smallest: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) below ``folder``; returns the index, written too.

    Null html is an empty payload; payloads of at least ``smallest`` bytes are stored once.  Rows that repeat
    a page_id with one payload are records of their own, all of the type that their id has.  A null page_id
    is written as the id ``null`` and read back as null; it holds a payload only where no other page has it.
    An empty table writes nothing.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    # SHA-1 is the format's digest; MD5 and the length beside it keep forged equal digests apart.
    keys = [F.unhex(F.sha1("payload")).alias("sha1"), F.unhex(F.md5("payload")).alias("md5"), F.length("payload").alias("size")]
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.select("*", *keys)
    groups = rows.select("page_id", *keys).groupBy("sha1", "md5", "size").agg(F.max("page_id").alias("holder"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        part, attempt, seq = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0
        bundle = Bundle(frame_bytes)

        def close() -> pa.RecordBatch:
            nonlocal bundle, seq
            name = f"pages-{part:06d}-{seq:05d}-{attempt}.warc.zst"
            with fs.open_output_stream(f"{top}/.{name}", compression=None) as f:
                f.write(bundle.bytes())
            fs.move(f"{top}/.{name}", f"{top}/{name}")
            ids, frames, at, length = zip(*bundle.index, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(ids, pa.int64()), pa.array(frames, pa.int32()), pa.array(at, pa.int64()), pa.array(length, pa.int64())], ["bundle", "page_id", "frame", "at", "length"])
            bundle, seq = Bundle(frame_bytes), seq + 1
            return out

        for b in batches:
            for page, url, payload, sha1, holder in zip(*(b.column(k) for k in ("page_id", "url", "payload", "sha1", "holder")), strict=True):
                page, holder = page.as_py(), holder.as_py()
                payload, name = payload.as_py(), base64.b32encode(sha1.as_py()).decode()
                held = page == holder or len(payload) < smallest
                bundle.add(page, record(page, url.as_py(), payload if held else None, None if held else holder, len(payload), name))
                if bundle.packed >= bundle_bytes:
                    yield close()
        if bundle.index:
            yield close()

    joined = keyed.join(groups, ["sha1", "md5", "size"]).select("page_id", "url", "payload", "sha1", "holder")
    return cut(joined.mapInArrow(write, INDEX), "warc-index")


def read_bundles(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """Every record of the bundles that the index names, found through it: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, payload (null for a revisit).  A response's payload is hashed
    anew and must have the digest and length that its header states.  A record of the index that no bundle holds is
    an error where its digest is asked for."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0), b.column(1), strict=True):
                name, data = path.as_py().rsplit("/", 1)[-1], data.as_py()
                for k, frame in enumerate(frames_of(data)):
                    rows, full, at = [], read_frame(data, frame), 0
                    while at < len(full):
                        head, http, payload, end = parse(full, at)
                        kind, stated = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(http.decode().split("Content-Length: ")[1].split("\r\n")[0])
                        if kind == "response" and (digest(payload) != stated or len(payload) != size):
                            raise ValueError(f"{name}: a payload differs from its header")
                        page = page_of(head["WARC-Record-ID"])
                        refers = page_of(head["WARC-Refers-To"]) if kind == "revisit" else None
                        rows.append((name, k, at, page, head.get("WARC-Target-URI"), size, stated, kind, refers, payload if kind == "response" else None))
                        at = end
                    cols = list(zip(*rows, strict=True))
                    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                    names = ["bundle", "frame", "at", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names)

    schema = "bundle string, frame int, at long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    out = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    if index.isEmpty():
        return spark.createDataFrame([], schema).select(*out)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "pages-*.warc.zst").load(folder).select("path", "content")
    place = ["bundle", "frame", "at"]
    found = index.select(*place).join(files.mapInArrow(read, schema), place, "left")
    lost = F.raise_error(F.concat(F.lit("a record of the index is missing in "), "bundle")).cast("string")
    return found.withColumn("payload_digest", F.coalesce("payload_digest", lost)).select(*out)


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages and read the archives back, through the index: a row per record that was written."""
    return read_bundles(pages.sparkSession, folder, write_bundles(pages, folder))


def read_record(data: bytes, frame: int, at: int) -> tuple[dict[str, str], bytes]:
    """(header, payload) of one record of a bundle: only its frame is decompressed."""
    head, _, payload, _ = parse(read_frame(data, frames_of(data)[frame]), at)
    return head, payload


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"), shared_dir(spark, "warc")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), g AS (SELECT html, max(page_id) AS holder FROM p GROUP BY html)
SELECT page_id, octet_length(encode(p.html)) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM p JOIN g USING (html)
"""
