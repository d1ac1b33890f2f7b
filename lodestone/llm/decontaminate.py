"""Benchmark decontamination by SimHash of item-sized windows.

An item of m words is looked for in all windows of m words of each document that have at least one of
its shingles of five words (without one, the similarity is 0). Such a window gets a fingerprint from
its shingles, as the item has from its own. Eight blocks of eight bits index the items: two
fingerprints within ``radius`` = 20 bits differ by at most two bits in one block, so an index of all
block values within two bits misses none. Candidates within the radius are then verified exactly: the
shingles, weighted by how often each occurs, must have a weighted Jaccard similarity of ``threshold``
or more. At 0.8 the fingerprints differ by 10 bits on average, and by more than 20 in about one window
of 5,000; an occurrence has several windows. A document of fewer than m words is one window, all of it,
and is verified without fingerprints, as it has no second window that a miss could fall back on.

A-Z count as a-z. An item of fewer than five words is one shingle, its whole sequence; an item without
words matches nothing. The items are a stated query set: they are broadcast in blocks of ``MOST_ITEMS``
and each block meets all documents in one map without a shuffle. A null text has no windows. Items with
equal texts are each reported; repeated documents give repeated results.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, map_arrow, mix, steps, text_bytes, word_spans

WORDS = 5
#: Items broadcast at once.
MOST_ITEMS = 20_000
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_NEAR = [[v for v in range(256) if (v ^ b).bit_count() <= 2] for b in range(256)]


def _shingles(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words."""
    out = h[: max(0, len(h) - length + 1)]
    for k in range(1, length):
        out = mix(out, h[k : k + len(out)])
    return out


def _signs(shingles: np.ndarray) -> np.ndarray:
    return np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)


def _pack(ones: np.ndarray, of: int) -> np.ndarray:
    return np.packbits(2 * ones > of, axis=1, bitorder="little").view("<u8").ravel()


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def _counted(words: list[bytes], length: int) -> Counter:
    return Counter(zip(*(words[k:] for k in range(length)), strict=False))


class ItemIndex:
    """Items by shingle, and by size and fingerprint block."""

    def __init__(self, items: list[tuple[object, bytes]], radius: int, threshold: float):
        self.radius, self.threshold = radius, threshold
        self.ids, self.words, self.counted, self.fp = [], [], [], []
        self.of_shingle: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        self.block: dict[tuple[int, int, int], list[int]] = defaultdict(list)
        self.of_size: dict[int, list[int]] = defaultdict(list)
        for item_id, text in items:
            words = text.lower().split()  # of bytes: folds A-Z only
            if not words:
                continue
            n, length = len(self.ids), min(WORDS, len(words))
            data = np.frombuffer(b" ".join(words) + b" " * 8, np.uint8)
            starts, ends, _ = word_spans(data, np.array([0, len(data) - 8]))
            shingles = _shingles(hash_words(data, starts, ends), length)
            fp = int(_pack(_signs(shingles).sum(0)[None], len(shingles))[0])
            self.ids.append(item_id)
            self.words.append(len(words))
            self.counted.append(_counted(words, length))
            self.fp.append(fp)
            self.of_size[len(words)].append(n)
            for s in shingles.tolist():
                self.of_shingle[length][s].add(len(words))
            for b in range(8):
                for value in _NEAR[fp >> 8 * b & 255]:
                    self.block[len(words), b, value].append(n)
        self.of_shingle = {k: dict(v) for k, v in self.of_shingle.items()}
        self.block = dict(self.block)
        self.of_size = dict(self.of_size)
        self.sorted = {k: np.array(sorted(v), np.uint64) for k, v in self.of_shingle.items()}
        bits = max(16, min(24, sum(map(len, self.sorted.values())).bit_length() + 6))
        self.mask = np.uint64((1 << bits) - 1)
        self.bloom = {}
        for k, v in self.sorted.items():
            self.bloom[k] = np.zeros(1 << bits, bool)
            self.bloom[k][v & self.mask] = True

    def seeds(self, h: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, position, shingle length) of shingles that an item has."""
        for length, known in self.sorted.items():
            s = _shingles(h, length)
            at = np.flatnonzero(self.bloom[length][s & self.mask])
            at = at[doc[at] == doc[at + length - 1]]
            s = s[at]
            hit = known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s
            for p, v in zip(at[hit].tolist(), s[hit].tolist(), strict=True):
                yield p, v, length

    def search(self, h: np.ndarray, doc: np.ndarray, bounds: np.ndarray, word_at) -> Iterator[tuple[int, int, int, int, float]]:
        """(document, item, first word, words, similarity) of the best window of each occurrence."""
        windows: dict[tuple[int, int], set[int]] = defaultdict(set)
        short: set[tuple[int, int]] = set()
        for p, v, length in self.seeds(h, doc):
            d = int(doc[p])
            lo, hi = int(bounds[d]), int(bounds[d + 1])
            for m in self.of_shingle[length][v]:
                if hi - lo < m:
                    short.add((d, m))
                    continue
                windows[d, m].update(range(max(lo, p + length - m), min(p, hi - m) + 1))
        for d, m in short:
            lo, hi = int(bounds[d]), int(bounds[d + 1])
            length = min(WORDS, m)
            # no more shingles in common than the document has
            if (hi - lo - length + 1) / (m - length + 1) >= self.threshold:
                own = _counted([word_at(k) for k in range(lo, hi)], length)
                for n in self.of_size[m]:
                    if (similarity := weighted_jaccard(own, self.counted[n])) >= self.threshold:
                        yield d, n, lo, hi - lo, similarity
        for (d, m), starts in windows.items():
            length = min(WORDS, m)
            at, per = np.array(sorted(starts)), m - length + 1
            first = int(at[0])
            total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_signs(_shingles(h[first : int(at[-1]) + m], length)), axis=0)])
            fp = _pack(total[at - first + per] - total[at - first], per)
            found: dict[int, list[tuple[int, float]]] = defaultdict(list)
            known: dict[int, Counter] = {}
            for start, x in zip(at.tolist(), fp.tolist(), strict=True):
                near = {n for b in range(8) for n in self.block.get((m, b, x >> 8 * b & 255), ())}
                for n in near:
                    if (self.fp[n] ^ x).bit_count() <= self.radius:
                        if start not in known:
                            known[start] = _counted([word_at(k) for k in range(start, start + m)], length)
                        if (similarity := weighted_jaccard(known[start], self.counted[n])) >= self.threshold:
                            found[n].append((start, similarity))
            for n, hits in found.items():
                best = None
                for start, similarity in hits:
                    if best is not None and start >= best[2] + m:
                        yield d, n, best[0], m, best[1]
                        best = None
                    if best is None:
                        best = [start, similarity, start]
                    elif similarity > best[1]:
                        best[:2] = start, similarity
                yield d, n, best[0], m, best[1]


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.8, radius: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, end_word, similarity): where documents have an item's passage."""
    source = docs.select(doc_id, F.col(text).alias("text__"))
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    schema = source.select(doc_id).schema.add("item_id", items.schema["item_id"].dataType)
    for name, kind in (("start_word", "long"), ("end_word", "long"), ("similarity", "double")):
        schema = schema.add(name, kind)
    out = None
    for index in _item_blocks(items, radius, threshold):
        found = _find(source, schema, index)
        out = found if out is None else out.unionByName(found)
    return out


def _item_blocks(items: DataFrame, radius: int, threshold: float) -> Iterator[ItemIndex]:
    blocks = max(1, -(-items.count() // MOST_ITEMS))
    for block in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        yield ItemIndex([(r["item_id"], (r["text"] or "").encode()) for r in some], radius, threshold)


def _search(items: ItemIndex, texts: pa.Array) -> list[tuple[int, int, int, int, float]]:
    """(row, item, first word in the row, words, similarity)."""
    data, offsets = text_bytes(texts)
    data = _FOLD[data]
    starts, ends, bounds = word_spans(data, offsets)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    raw = data.tobytes()
    found = items.search(hash_words(data, starts, ends), doc, bounds, lambda k: raw[starts[k] : ends[k]])
    return [(d, n, start - int(bounds[d]), words, similarity) for d, n, start, words, similarity in found]


def _find(source: DataFrame, schema, index: ItemIndex) -> DataFrame:
    shared = source.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        kind = pa.array(items.ids).type if items.ids else pa.int64()
        for batch in steps(batches, "text__"):
            if rows := _search(items, batch.column("text__")):
                d, n, start, words, similarity = zip(*rows, strict=True)
                begin = np.array(start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(d)), pa.array([items.ids[k] for k in n], kind), pa.array(begin), pa.array(begin + words), pa.array(similarity)],
                    names=schema.names,
                )

    return map_arrow(source, run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.8, radius: int = 20) -> DataFrame:
    """The rows of docs (text) without an occurrence of any item: a filter, without a shuffle."""
    for index in _item_blocks(benchmark.select("item_id", "text"), radius, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in steps(batches):
                hit = {d for d, *_ in _search(shared.value, batch.column("text"))}
                yield batch.filter(pa.array([k not in hit for k in range(len(batch))], pa.bool_()))

        docs = map_arrow(docs, run, docs.schema)
    return docs
