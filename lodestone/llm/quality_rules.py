"""Quality rules: counts of words, symbols, repeated lines and words, and n-gram perplexity bands.

The perplexity is that of an interpolated modified Kneser-Ney model over bytes, one for each language:
the highest order has raw counts, the lower ones the number of different bytes seen before, and each
order its three discounts; grams that occur once give their mass to the shorter context. Spark counts the grams of all texts; tasks add up their own before the
shuffle. The model is stored in sorted arrays of gram hashes with their log probabilities and, for
contexts, their back-off weights. A gram is ``ORDER`` bytes, so its size follows the variety of the
scripts and not the number of documents. The arrays of as many languages as have ``MOST_GRAMS`` together
are broadcast at a time; with more, the texts are measured in several passes, each over its own languages.

A document's mean log probability is compared with the bands of its language: quartiles of all its
documents (counted exactly, in steps of 1/1000 bit) widened by ``width`` interquartile ranges (1.5, as is
usual for outliers), and by more for a short text, whose mean varies more. Beyond the upper band a text
is noise, below the lower one it is repetition. The bands are those of the model's own texts: with all of
them counted, one text hardly moves it, and grams that only it has are left out.

A null or empty text has no words and fails. Null languages form a language of their own. Repeated rows are each
judged, equal rows alike; there are no ties to break. A very long text is a step of its own. Empty input gives empty output.
Only ``keep``, text and lang are read of other columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, hash_words, map_arrow, mix, per_document, steps, text_bytes, word_spans, written

#: Bytes of a gram: at most four, as a gram is packed in 32 bits.
ORDER = 4
#: Grams of the models that are broadcast together: about 16 bytes each. A language has fewer, as its script bounds them.
MOST_GRAMS = 20_000_000
#: Stands for a null language: a character for private use, which no language is named by.
NO_LANG = "\ue000"
#: Occurrences (in lower orders: different bytes before) that a gram of two bytes or more needs.
LEAST = 2
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: A text of this many bytes gets a band wider by the root of two.
EVEN_BYTES = 500.0


def packed_grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the gram that ends there; a text begins as if after line ends."""
    n = int(offsets[-1])
    x = data[:n].astype(np.uint32)
    gram = x.copy()
    for far in range(1, ORDER):
        y = np.full(n, 10, np.uint32)
        y[far:] = x[:-far] if far < n else x[:0]
        for near in range(far):
            at = offsets[:-1] + near
            y[at[at < offsets[1:]]] = 10
        gram |= y << np.uint32(8 * far)
    return gram


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            keys = np.concatenate([k for k, _ in parts])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], np.add.reduceat(np.concatenate([n for _, n in parts])[order], first)

        for batch in steps(batches):
            data, offsets = text_bytes(batch.column("text"))
            if not offsets[-1]:
                continue
            gram = packed_grams(data, offsets)
            langs, which = np.unique(np.array(batch.column("lang").to_pylist(), str), return_inverse=True)
            at = np.repeat(which, np.diff(offsets))
            for k, lang in enumerate(langs.tolist()):
                keys = np.sort(gram[at == k])
                if not len(keys):
                    continue
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                parts = held.setdefault(lang, [])
                parts.append((keys[first], np.diff(np.append(first, len(keys)))))
                if len(parts) > 8:
                    held[lang] = [merged(parts)]
        for lang, parts in held.items():
            keys, n = merged(parts)
            for at in range(0, len(keys), 200_000):
                k = keys[at : at + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.astype(np.int64)), pa.array(n[at : at + 200_000].astype(np.int64))], names=["lang", "gram", "n"])

    texts = docs.select(F.coalesce(F.col("lang"), F.lit(NO_LANG)).alias("lang"), "text")
    return map_arrow(texts, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _scatter(keys: np.ndarray) -> np.ndarray:
    """A hash of 32-bit keys in which no two meet: an odd multiplier and shifts can be undone."""
    h = keys.astype(np.uint32) * np.uint32(0x9E3779B1)
    return h ^ h >> np.uint32(15)


@dataclass
class HashArray:
    """Values by 32-bit key in arrays sorted by the keys' hash."""

    hashes: np.ndarray
    values: np.ndarray
    begin: np.ndarray  # of each bucket of hashes with equal leading bits
    shift: int

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> HashArray:
        h = _scatter(keys)
        order = np.argsort(h)
        h = h[order]
        bits = max(1, min(22, int(len(h)).bit_length()))
        begin = np.searchsorted(h.astype(np.int64) >> (32 - bits), np.arange((1 << bits) + 1))
        return cls(h, values[order].astype(np.float32), begin.astype(np.int32), 32 - bits)

    def get(self, keys: np.ndarray, missing: float) -> np.ndarray:
        out = np.full(len(keys), missing, np.float32)
        if not len(self.hashes):
            return out
        h = _scatter(keys)
        bucket = h >> np.uint32(self.shift)
        at, end = self.begin[bucket], self.begin[bucket + np.uint32(1)]
        todo = None
        while True:
            inside = at < end
            hit = inside & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == h)
            found = np.flatnonzero(hit)
            out[found if todo is None else todo[found]] = self.values[at[found]]
            rest = np.flatnonzero(inside & ~hit)
            if not len(rest):
                return out
            todo = rest if todo is None else todo[rest]
            at, end, h = at[rest] + 1, end[rest], h[rest]


@dataclass
class KneserNey:
    """log2 probabilities of seen grams by order (longest first), and log2 back-off weights of contexts."""

    grams: list[HashArray]
    backoff: list[HashArray]

    @classmethod
    def of(cls, gram: np.ndarray, n: np.ndarray) -> KneserNey:
        """From the counts of grams of ORDER packed bytes."""
        tables = [(gram.astype(np.int64), n.astype(np.float64))]
        for order in range(ORDER - 1, 0, -1):
            keys, _ = tables[-1]
            tables.append(np.unique(keys & (1 << 8 * order) - 1, return_counts=True))
        lower: tuple[np.ndarray, np.ndarray] | None = None
        grams, backoff = [], []
        for order in range(1, ORDER + 1):
            keys, c = tables[ORDER - order]
            c = c.astype(np.float64)
            n1, n2, n3, n4 = (float((c == k).sum()) for k in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 else 0.5
            cut = [y] * 3 if not (n1 and n2 and n3) else [k - (k + 1) * y * b / a for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
            cut = np.clip(cut, 0.05, [0.95, 1.9, 2.85])
            discount = cut[np.minimum(c, 3).astype(int) - 1]
            context, inverse = np.unique(keys >> 8, return_inverse=True)
            total = np.bincount(inverse, c)
            # grams with one occurrence have no entry, else a text of noise would be predicted by itself
            kept = (c >= LEAST) | (order == 1)
            own = np.where(kept, (c - discount) / total[inverse], 0)
            weight = np.maximum(1 - np.bincount(inverse, own), 1e-9)
            if lower is None:
                below = np.full(len(keys), 1 / 256)
            else:
                below = lower[1][np.searchsorted(lower[0], keys & (1 << 8 * (order - 1)) - 1)]
            p = own + weight[inverse] * below
            grams.append(HashArray.of(keys[kept], np.log2(p[kept])))
            backoff.append(HashArray.of(context, np.log2(weight)))
            lower = keys, p
        return cls(grams[::-1], backoff[::-1])

    def log2_p(self, gram: np.ndarray) -> np.ndarray:
        """Of each gram's last byte after the others."""
        out = np.zeros(len(gram), np.float32)
        todo, key = np.arange(len(gram)), gram
        for order in range(ORDER, 0, -1):
            p = self.grams[ORDER - order].get(key, np.nan)
            known = ~np.isnan(p)
            out[todo[known]] += p[known]
            todo, key = todo[~known], key[~known]
            if not len(todo):
                return out
            out[todo] += self.backoff[ORDER - order].get(key >> np.uint32(8), 0.0)
            key = key & np.uint32((1 << 8 * (order - 1)) - 1)
        out[todo] += np.float32(-8)
        return out


def _groups(counts: DataFrame) -> list[list[str]]:
    """The languages, as many together as have ``MOST_GRAMS``."""
    out: list[list[str]] = []
    total = 0
    for r in sorted(counts.groupBy("lang").count().collect(), key=lambda r: (r["count"], r["lang"])):
        if not out or total + r["count"] > MOST_GRAMS:
            out, total = [*out, []], 0
        out[-1].append(r["lang"])
        total += r["count"]
    return out


def _fit(counts: DataFrame, languages: list[str]) -> dict[str, KneserNey]:
    frames = {lang: counts.where(F.col("lang") == lang).select("gram", "n").toPandas() for lang in languages}
    return {lang: KneserNey.of(g["gram"].to_numpy(), g["n"].to_numpy()) for lang, g in frames.items()}


def train(docs: DataFrame) -> dict[str, KneserNey]:
    """A model of each language, from the counts of all texts."""
    counts = written(count_grams(docs), "grams")
    return {lang: model for group in _groups(counts) for lang, model in _fit(counts, group).items()}


def measure(docs: DataFrame, models: dict[str, KneserNey], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The counts of each text and ``bits`` (mean log2 perplexity of its bytes), with lang__ and bytes__."""
    source = docs.select(*keep, F.coalesce(F.col("lang"), F.lit(NO_LANG)).alias("lang__"), F.col("text").alias("text__"))
    schema = source.drop("text__").schema
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "bytes__")
    for name in names:
        schema = schema.add(name, "long")
    schema = schema.add("bits", "double")
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text__", 2 << 20):
            data, offsets = text_bytes(batch.column("text__"))
            n, size = len(offsets) - 1, int(offsets[-1])
            starts, ends, bounds = word_spans(data, offsets)
            plain = data[:size]
            chars = per_document(((plain & 0xC0) != 0x80) & ~SPACE[plain], offsets)
            symbols = per_document(SYMBOLS[plain], offsets)
            repeated = repeat_words(hash_words(data, starts, ends), bounds)
            lines = np.zeros(n, np.int64)
            raw = plain.tobytes()
            for i in range(n):
                solid = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip()]
                lines[i] = len(solid) - len(set(solid))
            bits = np.zeros(n)
            if size:
                gram = packed_grams(data, offsets)
                p = np.zeros(size, np.float32)
                langs, which = np.unique(np.array(batch.column("lang__").to_pylist(), str), return_inverse=True)
                at = np.repeat(which, np.diff(offsets))
                for k, lang in enumerate(langs.tolist()):
                    some = np.flatnonzero(at == k)
                    if not len(some):
                        continue
                    p[some] = shared.value[lang].log2_p(gram[some])
                bits = -per_document(p.astype(np.float64), offsets) / np.maximum(1, np.diff(offsets))
            columns = [np.diff(bounds), chars, symbols, lines, repeated, np.diff(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in range(len(keep) + 1)] + [pa.array(c.astype(np.int64)) for c in columns] + [pa.array(bits)], names=schema.names)

    return map_arrow(source, run, schema)


def repeat_words(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each document, its words in windows of three words that it has twice or more."""
    n = len(h)
    covered = np.zeros(n, bool)
    if n >= 3:
        doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
        key = mix(mix(mix(h[:-2], h[1:-1]), h[2:]), doc[:-2])
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        order = inside[np.argsort(key[inside])]
        same = key[order][1:] == key[order][:-1]
        twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
        for k in range(3):
            covered[twice + k] = True
    return per_document(covered, bounds)


def bands(measured: DataFrame, width: float) -> dict[str, tuple[float, float]]:
    """By language the lowest and highest mean bits of a long text."""
    steps_of = measured.where("bytes__ > 0").groupBy("lang__", F.floor(F.col("bits") * 1000).alias("step")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    out = {}
    for lang, g in steps_of.groupby("lang__"):
        g = g.sort_values("step")
        total = g["n"].cumsum().to_numpy()
        q1, q3 = (float(g["step"].iloc[int(np.searchsorted(total, share * total[-1]))]) / 1000 for share in (0.25, 0.75))
        out[lang] = q1 - width * (q3 - q1 + 0.02), q3 + width * (q3 - q1 + 0.02)
    return out


def _measured(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """measure() by the models of docs themselves."""
    counts = written(count_grams(docs), "grams")
    groups = _groups(counts)
    if len(groups) <= 1:
        return written(measure(docs, _fit(counts, groups[0] if groups else []), keep), "measured")
    lang, out = F.coalesce(F.col("lang"), F.lit(NO_LANG)), None
    known = [x for group in groups for x in group]
    for own, group in [*((lang.isin(g), g) for g in groups), (~lang.isin(known), [])]:  # the last have no bytes
        part = written(measure(docs.where(own), _fit(counts, group), keep), "measured")
        out = part if out is None else out.unionByName(part)
    return out


def quality_rules(docs: DataFrame, *, width: float = 1.5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts, base_failed, perplexity per byte and kept of each row of docs (text, lang)."""
    measured = _measured(docs, keep)
    by_lang = bands(measured, width)
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for lang, (a, b) in by_lang.items():
        low, high = F.when(F.col("lang__") == lang, F.lit(a)).otherwise(low), F.when(F.col("lang__") == lang, F.lit(b)).otherwise(high)
    slack = (F.sqrt(1 + EVEN_BYTES / F.greatest(F.lit(1), F.col("bytes__"))) - 1) * (high - low) / 2
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = (F.col("bits") >= low - slack) & (F.col("bits") <= high + slack)
    return (
        measured.withColumn("base_failed", failed)
        .withColumn("perplexity", F.exp2("bits") if hasattr(F, "exp2") else F.pow(F.lit(2.0), "bits"))
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))
        .drop("lang__", "bytes__", "bits")
    )
