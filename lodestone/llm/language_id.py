"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to three bytes. A context predicts a byte by its
count, or escapes to the context that is one byte shorter (escape method C: a context with total T
and d distinct bytes gives a seen byte n / (T + d) and the escape d / (T + d)); bytes that the longer
context has seen are excluded below it, so the code is exact, and below the empty context all 256
bytes are equally likely. The statistics are frozen after training: the escapes of a context are
resolved once, into one row of code lengths, and a text's code length under a language is the sum of
one entry per byte. The language with the shortest code wins; ties go to the first in order.

Training takes a bounded sample of labelled rows (``per_language`` rows of each language, on
average, by a hash of the id); the counting runs on the executors and only the contexts of
that sample reach the driver. Prediction is one map over the rows, without a shuffle.

A null text, or one without a letter, is ``und`` with score 0. Without any training row every text
is ``und``. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, steps, text_bytes

UNDETERMINED = "und"
#: Bytes of the longest contexts.
ORDER = 3
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class PpmModel:
    """Frozen code lengths: ``rows[node[c3, c2, c1], byte, language]`` in bits."""

    languages: list[str]
    symbol: np.ndarray  # of each byte; 0 for bytes that training has not seen
    node: np.ndarray  # by the last three symbols, the deepest context in any language's tree
    rows: np.ndarray

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language; a text begins as if after line ends."""
        n, a = int(offsets[-1]), len(self.symbol_list)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if not n:
            return out
        x = self.symbol[data[:n]].astype(np.int32)
        end = int(self.symbol[10])
        back = []
        for far in (3, 2, 1):
            y = np.full(n, end, np.int32)
            y[far:] = x[:-far]
            back.append(y)
        for far in (3, 2, 1):
            for near in range(far):
                at = offsets[:-1] + near
                at = at[at < offsets[1:]]
                back[3 - far][at] = end
        state = self.node[(back[0] * a + back[1]) * a + back[2]]
        bits = self.rows.reshape(-1, len(self.languages))[state * a + x]
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        out[full] = np.add.reduceat(bits, offsets[:-1][full], axis=0, dtype=np.float64)
        return out

    @property
    def symbol_list(self) -> range:
        return range(int(self.symbol.max()) + 1)


def _count(texts: DataFrame) -> DataFrame:
    """(lang, gram, n): grams of order + 1 bytes, packed in 32 bits; a text begins after line ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                rows = batch.filter(pa.array(langs == lang))
                total: list[np.ndarray] = []
                for value in rows.column("text"):
                    raw = b"\n" * ORDER + (value.as_py() or "").encode()
                    data = np.frombuffer(raw, np.uint8).astype(np.uint32)
                    if len(data) > ORDER:
                        gram = np.zeros(len(data) - ORDER, np.uint32)
                        for k in range(ORDER + 1):
                            gram = gram << np.uint32(8) | data[k : len(data) - ORDER + k]
                        total.append(gram)
                if total:
                    gram, n = np.unique(np.concatenate(total), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return map_arrow(texts.select("lang", "text"), run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, *, where: Column | None = None, per_language: int = 1000, least: int = 2) -> PpmModel:
    """Fit on a sample of labelled rows: ``per_language`` of each non-null lang, on average.

    The sample is all rows of a language that has fewer, else those with a small hash of doc_id.
    Contexts of three bytes that occur less than ``least`` times are left out of the trees.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if where is not None:
        labelled = labelled.where(where)
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return PpmModel([], np.zeros(256, np.uint8), np.zeros(1, np.int32), np.zeros((1, 1, 0), np.float32))
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / sizes[lang]))).otherwise(share)
    near = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20)
    counted = _count(labelled.where(near)).toPandas()
    return build(languages, {k: (g["gram"].to_numpy(np.int64), g["n"].to_numpy(np.float64)) for k, g in counted.groupby("lang")}, least)


def build(languages: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]], least: int) -> PpmModel:
    """Resolve the trees of grams of four bytes into rows of code lengths."""
    seen = np.zeros(256, bool)
    seen[10] = True
    for gram, _ in counts.values():
        seen[gram & 255] = True
    symbol = np.zeros(256, np.uint8 if seen.sum() < 256 else np.int32)
    symbol[seen] = np.arange(1, seen.sum() + 1)
    a, kinds = int(seen.sum()) + 1, len(languages)
    grams = {}
    for lang in languages:
        gram, n = counts.get(lang, (np.zeros(0, np.int64), np.zeros(0)))
        parts = [symbol[gram >> shift & 255].astype(np.int64) for shift in (24, 16, 8, 0)]
        grams[lang] = (parts, n)
    unseen = max(1, 256 - int(seen.sum()))
    # contexts by length: ids of those in any tree
    contexts = [np.zeros(1, np.int64)]
    for depth in range(1, ORDER + 1):
        ids, total = [], []
        for lang in languages:
            parts, n = grams[lang]
            key = np.zeros(len(n), np.int64)
            for k in range(3 - depth, 3):
                key = key * a + parts[k]
            ids.append(key)
            total.append(n)
        key, inverse = np.unique(np.concatenate(ids), return_inverse=True)
        n = np.bincount(inverse, np.concatenate(total), len(key))
        contexts.append(key[n >= (least if depth == ORDER else 1)])
    rows = []
    for depth in range(ORDER + 1):
        context = contexts[depth]
        below = None
        if depth:
            shorter = contexts[depth - 1]
            below = np.minimum(np.searchsorted(shorter, context % a ** (depth - 1)), len(shorter) - 1)
        p = np.zeros((len(context), a, kinds))
        for which, lang in enumerate(languages):
            parts, n = grams[lang]
            key = np.zeros(len(n), np.int64)
            for k in range(3 - depth, 3):
                key = key * a + parts[k]
            at = np.minimum(np.searchsorted(context, key), max(0, len(context) - 1))
            ok = context[at] == key if len(context) else np.zeros(len(key), bool)
            c = np.bincount(at[ok] * a + parts[3][ok], n[ok], len(context) * a).reshape(len(context), a)
            total, distinct = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
            if depth == 0:
                lower = np.full((1, a), 1 / 256)
                lower[0, 0] = unseen / 256
            else:
                lower = rows[depth - 1][below, :, which].copy()
                lower[:, 0] *= unseen
            rest = np.where(c > 0, 0, lower)
            left = rest.sum(1, keepdims=True)
            escape = np.where(left > 0, distinct / np.maximum(total + distinct, 1), 0)
            here = np.where(c > 0, c / np.maximum(total + np.where(left > 0, distinct, 0), 1), escape * rest / np.maximum(left, 1e-300))
            here = np.where(total > 0, here, lower)
            here[:, 0] /= unseen  # symbol 0 stands for every byte that training has not seen
            p[:, :, which] = here
        rows.append(p)
    first = np.cumsum([0, *(len(c) for c in contexts)])
    node = np.zeros(1, np.int32)
    for depth in range(1, ORDER + 1):
        node = np.tile(node, a)
        node[contexts[depth]] = first[depth] + np.arange(len(contexts[depth]))
    return PpmModel(languages, symbol, node, (-np.log2(np.concatenate(rows))).astype(np.float32))


def identify(docs: DataFrame, model: PpmModel, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """lang_pred, score (0 to 1: the language's share if all were equally likely before) and bits_per_byte."""
    source = docs.select(*keep, F.col(text).alias("text__"))
    schema = source.drop("text__").schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("bits_per_byte", "double")):
        schema = schema.add(name, kind)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text__", 2 << 20):
            judged = _judge(shared.value, batch.column("text__"))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in range(len(keep))] + [pa.array(x) for x in judged], names=schema.names)

    return map_arrow(source, run, schema)


def _judge(m: PpmModel, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and bits a byte of each text."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    lettered = np.zeros(n, bool)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        lettered[full] = np.logical_or.reduceat(_LETTER[data[: offsets[-1]]], offsets[:-1][full])
    for i in full[~lettered[full]]:
        lettered[i] = any(map(str.isalpha, texts[int(i)].as_py()))
    best, score, bits = np.full(n, len(m.languages)), np.zeros(n), np.zeros(n)
    if m.languages and n:
        lengths = m.code_lengths(data, offsets)
        won = lengths.argmin(1)
        least = lengths[np.arange(n), won]
        share = 1 / np.exp2(np.maximum(least[:, None] - lengths, -1000)).sum(1)
        bits = np.where(offsets[1:] > offsets[:-1], least / np.maximum(1, np.diff(offsets)), 0)
        best, score = np.where(lettered, won, best), np.where(lettered, share, 0)
    return np.array([*m.languages, UNDETERMINED], object)[best].tolist(), score, bits


def _class(size: Column) -> Column:
    """Of a text of so many bytes: powers of four, as the bits a byte of short texts vary more."""
    return F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) / 2).cast("int")


def limits(docs: DataFrame, model: PpmModel, fence: float = 15.0, least: int = 50) -> list[tuple[str, int, float]]:
    """(language, class of size, bits a byte) beyond which a text is in none of the languages: the quartiles of all rows of docs
    (counted exactly, in steps of 1/100) and ``fence`` times the distance between them. A class with fewer rows than
    ``least`` has the limit of plain bytes, eight."""
    judged = identify(docs.withColumn("size__", F.octet_length("text")), model, keep=("size__",)).where(F.col("lang_pred") != UNDETERMINED)
    steps_of = judged.groupBy("lang_pred", _class(F.col("size__")).alias("class"), F.floor(F.col("bits_per_byte") * 100).alias("step")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    out = []
    for (lang, number), g in steps_of.sort_values("step").groupby(["lang_pred", "class"]):
        total = g["n"].cumsum().to_numpy()
        q1, q3 = (float(g["step"].iloc[int(np.searchsorted(total, share * total[-1]))]) / 100 for share in (0.25, 0.75))
        out.append((lang, int(number), q3 + fence * (q3 - q1 + 0.02) if total[-1] >= least else 8.0))
    return out


def keep_identified(docs: DataFrame, model: PpmModel, fence: float = 15.0) -> DataFrame:
    """The rows of docs (text) in a learned language: those that are not ``und`` and whose best code is no longer, a byte, than
    the limit of their language and size, nor than plain bytes. The limits are a row for each language and class."""
    shared = docs.sparkSession.sparkContext.broadcast((model, {(lang, number): most for lang, number, most in limits(docs, model, fence)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, most = shared.value
        for batch in steps(batches, step=2 << 20):
            lang, _, bits = _judge(model, batch.column("text"))
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            kept = [x != UNDETERMINED and b <= min(8.0, most.get((x, (max(n, 1).bit_length() - 1) // 2), 8.0)) for x, b, n in zip(lang, bits, size, strict=True)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
