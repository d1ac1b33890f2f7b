"""Language-model scores by deleted interpolation.

The probability of a token is a mixture of maximum-likelihood estimates of orders ``order`` down to
one and the uniform distribution. The weights depend on how often the token's longest context
occurs, in buckets of powers of two; expectation-maximisation finds them on held-out counts: the
training documents are parted, the n-grams of one part are predicted with the counts of the other.
The scores then use the counts of both.

Each task cuts its documents into chunks, which are written once. A chunk sends its distinct n-grams,
sorted and packed, to shards by leading bits of their hashes; a shard adds up the counts and answers
each chunk in the order of its n-grams. So an n-gram is shuffled once a chunk, however often it occurs,
no task holds more than a chunk or a shard, and the number of both grows with the input. The answers
are written once; weights and scores join them with the chunks. The sums for the weights are kept by
bins of half a power of two of each estimate, so what reaches the driver is bounded by the bins, not
by the documents.

A-Z count as a-z; each text ends with one end token. N-grams are known by 64-bit hashes. A null or empty
text is its end alone. Without training documents all counts are 0. Repeated rows, and rows of one id,
are each counted and scored. A very long text is a chunk of its own. Empty input gives empty output.
Ties do not arise. Other columns than ``keep`` and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .common import hash_words, map_arrow, mix, steps, text_bytes, word_spans, written

#: Bytes of text from which a chunk is full.
CHUNK_BYTES = 8 << 20
#: Parts of the documents: scored only, training (kept), training (held out for the weights).
SCORED, KEPT, HELD = 0, 1, 2
_START, _END = np.uint64(0x5354415254), np.uint64(0x454E44)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BINS = 64
_BUCKETS = 24


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    v = np.ascontiguousarray(values)
    return zstandard.compress(np.ascontiguousarray(v.view(np.uint8).reshape(len(v), v.itemsize).T).tobytes(), 1)


def unpack(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


@dataclass
class Tokens:
    """The n-gram hashes of each token of a chunk, by order; bounds of the documents."""

    bounds: np.ndarray
    grams: list[np.ndarray]  # [order - 1]
    first: np.ndarray  # whether a token is its text's first

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, order: int) -> Tokens:
        data = _FOLD[data]
        starts, ends, words = word_spans(data, offsets)
        n = len(offsets) - 1
        bounds = words + np.arange(n + 1)
        token = np.full(int(bounds[-1]), _END, np.uint64)
        own = np.ones(len(token), bool)
        own[bounds[1:] - 1] = False
        token[own] = hash_words(data, starts, ends)
        grams = [token]
        for far in range(1, order):
            back = np.full(len(token), _START, np.uint64)
            back[far:] = token[: len(token) - far]
            for near in range(far):
                at = bounds[:-1] + near
                back[at[at < bounds[1:]]] = _START
            grams.append(mix(back, grams[-1]))
        first = np.zeros(len(token), bool)
        first[bounds[:-1]] = True
        return cls(bounds, grams, first)


def _sorted_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.diff(np.append(first, len(k)))


def _chunks(marked: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(chunk, part, rows, sizes, z): the documents of one part and task, ``CHUNK_BYTES`` of text at a time, compressed together."""
    rows = marked.select(*keep, "held_out").schema
    schema = StructType([StructField("chunk", LongType()), StructField("part", IntegerType()), StructField("rows", ArrayType(rows)), StructField("sizes", ArrayType(LongType())), StructField("z", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        pack = zstandard.ZstdCompressor(level=6)
        held: dict[int, list[tuple[pa.RecordBatch, np.ndarray, bytes]]] = {}

        def chunk(part: int) -> pa.RecordBatch:
            parts = held.pop(part)
            table = pa.Table.from_batches([b for b, _, _ in parts]).combine_chunks()
            columns = [table.column(c).chunk(0) if table.num_rows else pa.array([], table.column(c).type) for c in range(len(keep) + 1)]
            own = pa.StructArray.from_arrays(columns, names=[*keep, "held_out"])
            end = pa.array([0, len(own)], pa.int32())
            sizes = pa.array(np.concatenate([x for _, x, _ in parts]))
            z = pack.compress(b"".join(x for _, _, x in parts))
            return pa.RecordBatch.from_arrays([pa.array([first + made]), pa.array([part], pa.int32()), pa.ListArray.from_arrays(end, own), pa.ListArray.from_arrays(end, sizes), pa.array([z], pa.binary())], names=schema.names)

        filled: dict[int, int] = {}
        for batch in steps(batches, "text__"):
            which = batch.column("part__").to_numpy(zero_copy_only=False)
            for part in np.unique(which).tolist():
                some = batch.filter(pa.array(which == part))
                data, offsets = text_bytes(some.column("text__"))
                held.setdefault(part, []).append((some, np.diff(offsets), data[: offsets[-1]].tobytes()))
                filled[part] = filled.get(part, 0) + int(offsets[-1])
                if filled[part] >= CHUNK_BYTES:
                    yield chunk(part)
                    made, filled[part] = made + 1, 0
        for part in sorted(held):
            yield chunk(part)
            made += 1

    return map_arrow(marked.select(*keep, "held_out", "part__", "text__"), run, schema)


def _texts(chunk: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of the texts of a chunk's row."""
    raw = np.frombuffer(zstandard.decompress(chunk.column("z")[0].as_py()), np.uint8)
    sizes = np.array(chunk.column("sizes")[0].as_py(), np.int64)
    return np.concatenate([raw, np.full(8, 32, np.uint8)]), np.concatenate([[0], np.cumsum(sizes)])


def _requests(chunks: DataFrame, order: int, shards: int) -> DataFrame:
    """(kind, shard, chunk, part, grams, counts): a chunk's distinct n-grams and how often it has them."""
    bits = shards.bit_length() - 1
    names = ["kind", "shard", "chunk", "part", "grams", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                yield asked(batch.slice(k, 1))

    def asked(chunk: pa.RecordBatch) -> pa.RecordBatch:
        tokens = Tokens.of(*_texts(chunk), order)
        part, number = chunk.column("part")[0].as_py(), chunk.column("chunk")[0].as_py()
        rows = []
        for kind, keys in enumerate(tokens.grams, 1):
            keys, n = _sorted_counts(keys)
            cut = np.searchsorted(keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64), np.arange(shards + 1, dtype=np.uint64))
            for s in np.flatnonzero(np.diff(cut)).tolist():
                a, b = cut[s], cut[s + 1]
                rows.append((kind, s, number, part, pack(np.diff(keys[a:b], prepend=np.uint64(0))), pack(n[a:b].astype(np.uint32))))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return map_arrow(chunks.select("chunk", "part", "sizes", "z"), run, "kind int, shard int, chunk long, part int, grams binary, counts binary")


def _answers(requests: DataFrame, shards: int) -> DataFrame:
    """(kind, shard, chunk, part, n, total, kept); chunk -1 has the shard's sums of distinct and all tokens."""
    names = ["kind", "shard", "chunk", "part", "distinct", "tokens", "kept_tokens", "total", "kept"]

    def run(group: pa.Table) -> pa.Table:
        kind, shard = group.column("kind")[0].as_py(), group.column("shard")[0].as_py()
        part = np.array(group.column("part").to_pylist(), np.int32)
        keys = [np.cumsum(unpack(g.as_py(), "<u8"), dtype=np.uint64) for g in group.column("grams")]
        size = np.array([len(k) for k in keys])
        keys = np.concatenate(keys)
        order = np.argsort(keys).astype(np.uint32)
        keys = keys[order]
        new = np.empty(len(keys), bool)
        new[0] = True
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        del keys
        begin = np.flatnonzero(new)
        which = np.empty(len(new), np.uint32)
        which[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
        del new
        n = np.concatenate([unpack(n.as_py(), "<u4") for n in group.column("counts")])

        def sums(parts: np.ndarray) -> np.ndarray:
            """The counts of each n-gram in the documents of some parts."""
            return np.add.reduceat((n * np.repeat(parts, size))[order].astype(np.uint64), begin)

        total, kept = sums(part != SCORED), sums(part == KEPT)
        del order, n
        rows, at = [(kind, shard, -1, -1, int((total > 0).sum()), int(total.sum()), int(kept.sum()), b"", b"")], 0
        for c, p, m in zip(group.column("chunk").to_pylist(), part.tolist(), size.tolist(), strict=True):
            own = which[at : at + m]
            at += m
            rows.append((kind, shard, c, p, 0, 0, 0, pack(total[own]), pack(kept[own]) if p == HELD else b""))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32()) + (pa.int64(),) * 3 + (pa.binary(),) * 2
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return requests.repartition(shards, "kind", "shard").groupBy("kind", "shard").applyInArrow(run, "kind int, shard int, chunk long, part int, distinct long, tokens long, kept_tokens long, total binary, kept binary")


def _counts(tokens: Tokens, answers: pa.Table, column: str, order: int) -> list[np.ndarray]:
    """The answered count of each token's n-gram, by order."""
    out = []
    rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("kind", "shard", column)), strict=True), key=lambda r: r[:2])
    for kind in range(1, order + 1):
        values = [unpack(x, "<u8") for k, _, x in rows if k == kind]
        counts = np.concatenate(values).astype(np.int64) if values else np.zeros(0, np.int64)
        keys = tokens.grams[kind - 1]
        at = np.argsort(keys)
        new = np.concatenate([[True], keys[at][1:] != keys[at][:-1]]) if len(keys) else np.zeros(0, bool)
        if int(new.sum()) != len(counts):
            raise ValueError("a chunk's answers are not those to its n-grams")
        c = np.empty(len(keys), np.int64)
        c[at] = counts[np.cumsum(new) - 1]
        out.append(c)
    return out


@dataclass
class Model:
    order: int
    docs: int  # training documents, which are the starts
    tokens: int
    distinct: int
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))  # [bucket, orders longest first, then uniform]

    def estimates(self, tokens: Tokens, counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Maximum-likelihood estimates of each token [order longest first, uniform last], and its bucket."""
        n = len(counts[0])
        p = np.zeros((self.order + 1, n))
        p[-1] = 1 / (self.distinct + 1)
        p[-2] = counts[0] / max(1, self.tokens)
        context = np.full(n, self.tokens, np.int64)
        for k in range(2, self.order + 1):
            # the context is the n-gram of order k - 1 that ends one token before
            before = np.concatenate([[0], counts[k - 2][:-1]]) if n else counts[0]
            context = np.where(tokens.first, self.docs, before)
            p[self.order - k] = np.where(context > 0, counts[k - 1] / np.maximum(context, 1), 0)
        bucket = np.minimum(_BUCKETS - 1, np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0))
        return p, bucket


def expectation_maximisation(bucket: np.ndarray, p: np.ndarray, n: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Mixture weights by bucket for items that occur n times with estimates p [item, model]."""
    models = p.shape[1]
    w = np.full((_BUCKETS, models), 1 / models)
    for _ in range(rounds):
        joint = w[bucket] * p
        share = joint / np.maximum(joint.sum(1, keepdims=True), 1e-300) * n[:, None]
        new = np.column_stack([np.bincount(bucket, share[:, m], _BUCKETS) for m in range(models)])
        # half a token of each model keeps the uniform share above 0 and empty buckets at even weights
        new = (new + 0.5) / (new.sum(1, keepdims=True) + 0.5 * models)
        if np.abs(new - w).max() < 1e-5:
            return new
        w = new
    return w


def _bins(chunks: DataFrame, answers: DataFrame, model: Model) -> DataFrame:
    """(bin, n): the held-out tokens by bucket and binned estimates."""

    def run(chunk: pa.Table, answered: pa.Table) -> pa.Table:
        if not len(chunk):
            return pa.table([pa.array([], pa.int64())] * 2, names=["bin", "n"])
        tokens = Tokens.of(*_texts(chunk), model.order)
        p, bucket = model.estimates(tokens, _counts(tokens, answered, "kept", model.order))
        key = bucket
        for x in p[:-1]:
            key = key * _BINS + np.where(x > 0, np.minimum(_BINS - 2, np.rint(-2 * np.log2(np.maximum(x, 1e-300)))).astype(np.int64), _BINS - 1)
        key, n = np.unique(key, return_counts=True)
        return pa.table([pa.array(key), pa.array(n)], names=["bin", "n"])

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))


def lm_scores(docs: DataFrame, held_out: Column, held_for_weights: Column, *, order: int = 2, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs.

    The model learns from the rows where ``held_out`` is false; of these, those where
    ``held_for_weights`` holds are the held-out counts that the weights are fitted on.
    """
    spark = docs.sparkSession
    marked = docs.select(*keep, held_out.alias("held_out"), F.when(held_out, SCORED).when(held_for_weights, HELD).otherwise(KEPT).alias("part__"), F.col(text).alias("text__"))
    chunks = written(_chunks(marked, keep), "chunks")
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    sizes = {r["part"]: r for r in chunks.groupBy("part").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.size("sizes")).alias("n"), F.sum(size).alias("size")).collect()}
    partitions, total = int(spark.conf.get("spark.sql.shuffle.partitions")), sum(r["size"] for r in sizes.values())
    # a power of two; a shard has the n-grams of a chunk's size of text, or up to twice as many
    shards = 1 << max(0, (max(partitions, -(-total // CHUNK_BYTES))).bit_length() - 1)
    # as many tasks as chunks, however large the input: the session's number of partitions does not grow with it
    by_chunk = lambda df: df.repartition(max(1, sum(r["chunks"] for r in sizes.values())), "chunk")
    answers = written(_answers(_requests(chunks, order, shards), shards), "answers")
    sums = answers.where("chunk = -1 and kind = 1").agg(F.sum("distinct").alias("v"), F.sum("tokens").alias("n"), F.sum("kept_tokens").alias("k")).first()
    answers = answers.where("chunk >= 0")
    count = lambda *parts: sum(sizes[p]["n"] for p in parts if p in sizes)
    model = Model(order, count(KEPT, HELD), sums["n"] or 0, sums["v"] or 0)
    kept = Model(order, count(KEPT), sums["k"] or 0, model.distinct)
    held = _bins(by_chunk(chunks.where(F.col("part") == HELD).select("chunk", "sizes", "z")), by_chunk(answers.where(F.col("part") == HELD).select("kind", "shard", "chunk", "kept")), kept).toPandas()
    bins, n = held["bin"].to_numpy(np.int64), held["n"].to_numpy(np.float64)
    estimates = []
    for _ in range(order):
        q = bins % _BINS
        estimates.append(np.where(q == _BINS - 1, 0.0, np.exp2(-q / 2)))
        bins = bins // _BINS
    p = np.column_stack([*estimates[::-1], np.full(len(bins), 1 / (model.distinct + 1))])
    model.weights = expectation_maximisation(bins, p, n)

    schema = marked.select(*keep, "held_out").schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)

    def run(chunk: pa.Table, answered: pa.Table) -> pa.Table:
        tokens = Tokens.of(*_texts(chunk), order)
        counts = _counts(tokens, answered, "total", order)
        p, bucket = model.estimates(tokens, counts)
        score = np.log10(np.einsum("mi,im->i", p, model.weights[bucket]))
        base = np.log10((counts[0] + 0.5) / (model.tokens + 0.5 * (model.distinct + 1)))
        at = tokens.bounds[:-1]
        columns = [np.diff(tokens.bounds), np.add.reduceat((counts[0] > 0).astype(np.int64), at), np.full(len(at), model.tokens), np.add.reduceat(base, at), np.add.reduceat(score, at)]
        own = chunk.column("rows").combine_chunks().flatten()
        return pa.table([*own.flatten(), *map(pa.array, columns)], names=schema.names)

    answered = answers.select("kind", "shard", "chunk", "total")
    return by_chunk(chunks.drop("part")).groupBy("chunk").cogroup(by_chunk(answered).groupBy("chunk")).applyInArrow(run, schema)
