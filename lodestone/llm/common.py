"""What the operators share: Arrow text buffers, vectorised words and hashes, shared folders."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import scratch, written  # noqa: F401

#: Bytes of text that one vectorised step works on; bounds a worker's memory.
STEP_BYTES = 2 << 20
#: White space that separates words: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_K0, _K1, _K2 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_mod5(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def row_key(*cols: str) -> Column:
    """A 64-bit key of a row; repeated rows share it."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in cols])


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow in batches of few bytes: rows may be long, and each task's worker holds a batch. The session's setting of
    that size stays changed, as a plan is read when it runs."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(STEP_BYTES))
    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column with 8 bytes of padding, and n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    if len(at) == 0:
        at = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    return np.concatenate([raw, np.full(8, 32, np.uint8)]), at - at[0]


def steps(batches: Iterable[pa.RecordBatch], column: str = "text", step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``step`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, begin = np.cumsum(size), 0
        while begin < len(size):
            before = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, before + step, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for n + 1 documents the first word of each."""
    n = int(offsets[-1])
    solid = ~SPACE[data[: n + 1]]
    solid[n] = False
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    at = offsets[1:-1]
    start[at] = solid[at]
    inner = at[at > 0] - 1
    end[inner] = solid[inner]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return start, end, np.searchsorted(start, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes of all words at a time."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    eights = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    left = ends - starts
    h, pos, live = left.astype(np.uint64) * _K0, starts, None
    while True:
        v = eights[pos] & _MASK[np.minimum(left, 8)]
        x = (h if live is None else h[live]) ^ v
        x *= _K1
        x ^= x >> np.uint64(32)
        x *= _K2
        x ^= x >> np.uint64(29)
        if live is None:
            h = x
        else:
            h[live] = x
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        live = more if live is None else live[more]
        pos, left = pos[more] + 8, left[more] - 8


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the pair (a, b); not symmetric."""
    x = a * _K1 + (b ^ (b >> np.uint64(31))) * _K2 + _K0
    x ^= x >> np.uint64(32)
    x *= _K1
    x ^= x >> np.uint64(29)
    return x


def per_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over each document's items; bounds has n + 1 entries."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype if values.dtype.kind != "b" else np.int64), np.cumsum(values, axis=0, dtype=None if values.dtype.kind != "b" else np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def row_keys(text: str, *known_by: str) -> tuple[Column, Column]:
    """96 bits that tell rows apart by their text and the columns they are known by; repeated rows share them."""
    columns = [F.col(c) for c in known_by]
    return F.xxhash64(*columns, F.col(text)).alias("key__"), F.hash(F.col(text), *columns).alias("check__")


def packed_docs(docs: DataFrame, text: str, keep: tuple[str, ...], known_by: tuple[str, ...] | None = None) -> DataFrame:
    """keep, key__ and check__ (of the row) and z__, the text's bytes, compressed for the shuffle."""
    source = docs.select(*keep, *row_keys(text, *(keep if known_by is None else known_by)), F.col(text).alias("text__"))
    schema = source.drop("text__").schema.add("z__", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in steps(batches, "text__"):
            z = [None if x is None else pack.compress(x.encode()) for x in batch.column("text__").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in range(len(keep) + 2)] + [pa.array(z, pa.binary())], names=schema.names)

    return map_arrow(source, run, schema)


def unpacked(batches: Iterator[pa.RecordBatch], most: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Rows and their texts, about ``most`` bytes of text at a time."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        begin, size, texts = 0, 0, []
        for k, z in enumerate(batch.column("z__")):
            texts.append(unpack.decompress(z.as_py()) if z.is_valid else None)
            size += len(texts[-1] or b"")
            if size >= most or k == len(batch) - 1:
                yield batch.slice(begin, k + 1 - begin), pa.array(texts, pa.large_binary())
                begin, size, texts = k + 1, 0, []
