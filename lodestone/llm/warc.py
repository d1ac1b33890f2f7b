"""WARC archives as seekable Zstandard bundles.

``write_warc`` writes one record per row, ``read_warc`` reads a folder of bundles back. Of the rows
with one payload digest the one with the largest id is the response and holds the payload; the
others are revisits that refer to it. A bundle is one file: frames that each hold a group of whole
records and can be decompressed by themselves, a skippable frame with the map from record ids to
(frame, offset in the frame), and a skippable frame with the seek table of the Zstandard seekable
format as the footer. Between two frames stands an empty skippable frame (eight ASCII bytes), which
is what lets Spark's text writer put the file together: a row of its output is a frame, its line
separator the empty frame. So bundles go through Spark's commit protocol to any file system that it
knows, and a task that is lost is written again.

The payloads are shuffled once at most, by id, to meet the few rows that say which are revisits;
digests and ids alone are grouped, with partial sums, so a payload that a third of all rows share is
one row by the time it is shuffled.

A null payload is empty. A null id is smaller than any other. Rows that repeat id and payload are each
written, all with the same type and target. Empty input gives bundles without records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, written

#: Fixed values of the Zstandard formats: magic numbers of skippable frames and of the seek table.
SKIPPABLE, SEEK_SKIPPABLE, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
EMPTY_FRAME = struct.pack("<II", SKIPPABLE, 0)
#: Bytes of records after which a frame ends.
FRAME_BYTES = 256 << 10
#: Pages of one payload from which their ids are not dealt out by it.
HOT = 100_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_urn(page_id: int | None, digest: str) -> str:
    """The record's id; the same for the same page id and payload, so that a rerun writes the same bytes."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has no block, but the length and digest of its payload."""
    digest = base32_digest(payload)
    fields = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", record_urn(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if is_revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_urn(refers_to, digest)), ("X-Refers-To-Page-ID", "" if refers_to is None else str(refers_to))]
    block = b"" if is_revisit else payload
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, block) of each record in a frame's bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = data[at:end].decode().split("\r\n")
        if head[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head[1:])
        begin, length = end + 4, int(fields["Content-Length"])
        block = data[begin : begin + length]
        if len(block) != length or data[begin + length : begin + length + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is cut short")
        yield at, fields, block
        at = begin + length + 4


def skippable(content: bytes, magic: int = SKIPPABLE + 1) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer of the seekable format for frames of (compressed, decompressed) size."""
    return skippable(b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEK_MAGIC), SEEK_SKIPPABLE)


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, from the end of a bundle."""
    bundle = bundle.removesuffix(EMPTY_FRAME)
    n, _, magic = struct.unpack_from("<IBI", bundle, len(bundle) - 9)
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table")
    out, at = [], 0
    for k in range(n):
        packed, size = struct.unpack_from("<II", bundle, len(bundle) - 9 - 8 * (n - k))
        out.append((at, packed, size))
        at += packed
    return out


def record_index(bundle: bytes) -> dict[str, tuple[int, int]]:
    """Record id to (frame, offset in the frame), from the skippable frame before the seek table."""
    frames = read_seek_table(bundle)
    at, packed, _ = frames[-1]
    content = zstandard.decompress(bundle[at + 8 : at + packed - len(EMPTY_FRAME)])
    return {urn: (int(f), int(o)) for urn, f, o in (line.rsplit(" ", 2) for line in content.decode().splitlines())}


def read_record(bundle: bytes, urn: str) -> tuple[dict[str, str], bytes]:
    """One record by its id: only its frame is decompressed."""
    frame, offset = record_index(bundle)[urn]
    at, packed, _ = read_seek_table(bundle)[frame]
    data = zstandard.ZstdDecompressor().decompressobj().decompress(bundle[at : at + packed])
    _, fields, block = next(parse_records(data[offset:]))
    return fields, block


def plan_revisits(pages: DataFrame, *, page_id: str, payload: Column, min_revisit_bytes: int) -> DataFrame:
    """pages with refers_to__ and revisit__."""
    keyed = pages.withColumn("digest__", F.sha1(payload.cast("binary")))
    long_enough = F.octet_length(payload) >= min_revisit_bytes
    groups = keyed.where(long_enough).groupBy("digest__").agg(F.max(page_id).alias("target__"), F.count(F.lit(1)).alias("n__"), F.count(page_id).alias("known__")).where("n__ > 1")
    groups = written(groups, "digests")
    # narrow rows only: the ids of revisits, then the payloads meet them by id and digest. The ids of a popular payload stay where
    # they are: such digests are few, a row for each HOT pages at most
    ids = keyed.where(long_enough).select("digest__", F.col(page_id).alias("id__"))
    popular, others = F.broadcast(groups.where(F.col("n__") > HOT)), groups.where(F.col("n__") <= HOT)
    met = ids.join(popular.select("digest__"), "digest__", "left_anti").join(others, "digest__").unionByName(ids.join(popular, "digest__"))
    revisits = met.where("known__ > 0 and not (id__ <=> target__)").select("digest__", "id__", "target__").distinct()
    return (
        keyed.alias("p")
        .join(revisits.alias("r"), (F.col(f"p.{page_id}").eqNullSafe(F.col("r.id__"))) & (F.col("p.digest__") == F.col("r.digest__")), "left")
        .select("p.*", F.col("r.target__").alias("refers_to__"), F.col("r.digest__").isNotNull().alias("revisit__"))
    )


def write_warc(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0, level: int = 3) -> None:
    """Write the bundles of pages into the new folder ``path``."""
    payload = F.coalesce(F.col("html__"), F.lit(""))
    source = pages.select(F.col(page_id).cast("long").alias("id__p"), F.col(url).cast("string").alias("url__"), F.col(html).cast("string").alias("html__"))
    planned = plan_revisits(source, page_id="id__p", payload=payload, min_revisit_bytes=min_revisit_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        frames: list[tuple[int, int]] = []
        index: list[str] = []
        group: list[bytes] = []
        size = 0

        def frame() -> pa.RecordBatch:
            data = b"".join(group)
            packed = packer.compress(data)
            frames.append((len(packed) + len(EMPTY_FRAME), len(data)))
            group.clear()
            return row(packed)

        def row(content: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["frame"])

        for batch in batches:
            for page, at, html_, target, again in zip(*(batch.column(c).to_pylist() for c in ("id__p", "url__", "html__", "refers_to__", "revisit__")), strict=True):
                record = record_bytes(page, at, (html_ or "").encode(), target, again)
                index.append(f"{record_urn(page, base32_digest((html_ or '').encode()))} {len(frames)} {size}\n")
                group.append(record)
                size += len(record)
                if size >= FRAME_BYTES:
                    yield frame()
                    size = 0
        if group:
            yield frame()
        content = skippable(packer.compress("".join(index).encode()))
        frames.append((len(content) + len(EMPTY_FRAME), 0))
        yield row(content)
        yield row(seek_table(frames))

    bundles = map_arrow(planned.select("id__p", "url__", "html__", "refers_to__", "revisit__"), run, "frame binary")
    bundles.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME.decode()).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of all records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle in batch.column("content"):
                view = bundle.as_py()
                for at, packed, size in read_seek_table(view):
                    if not size:
                        continue
                    data = zstandard.ZstdDecompressor().decompressobj().decompress(view[at : at + packed])
                    rows = []
                    for _, f, block in parse_records(data):
                        number = lambda k, f=f: int(f[k]) if f.get(k) else None
                        revisit = f["WARC-Type"] == "revisit"
                        digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and base32_digest(block) != digest:
                            raise ValueError(f"{f['WARC-Record-ID']}: the payload does not match its digest")
                        rows.append((number("X-Page-ID"), f["WARC-Target-URI"], int(f["X-Payload-Length"]), digest, f["WARC-Type"], number("X-Refers-To-Page-ID"), None if revisit else block))
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return map_arrow(files, run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
