"""Substring dedup: words of passages that occur elsewhere go, by FM-indexes over shards.

Two windows of ``window`` words that are equal choose the same anchor, the run of ``ANCHOR`` words in
them with the least hash. So a document falls into segments, the windows that share one anchor's
place, and equal windows meet where the anchor's hash sends their segments.

1. Anchors are counted over all documents (hashes only). One that occurs once has no repeat.
2. The segments of the others are dealt out by anchor. One whose anchor is very common is cut into its
   single windows, dealt out by their own hash, so no shard gets more than the segments of an anchor
   with ``HOT`` places, or one window. Equal segments of a step are one row with a count before the
   shuffle, and equal single windows of a task.
3. Each partition is read in order of the anchors and cut into shards of ``SHARD_WORDS``. A shard
   builds a compressed FM-index of its segments and streams them through it: backward search gives
   their matching statistics, and runs of ``window`` words or more with two occurrences are reported.
4. The reports meet the segments' places, places meet documents, and the words go.

Hashes decide what meets: segments are one if their words are, and reports find their places by 128 bits of them, places their
rows by 96 bits of id and text. Windows are judged on the input. A null text has no words; null ids are an id like any other. Very
long texts are one step of their own. Repeated rows repeat each other and lose their windows. Documents of fewer words than the
window stay whole. Empty input gives empty output. Of ties nothing depends on an order. Other columns pass through
``remove_repeats`` as they are, whatever their names and types.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_words, map_arrow, mix, packed_docs, row_keys, steps, text_bytes, unpacked, word_spans, written
from .fm_index import FmIndex

#: Words of an anchor, at most.
ANCHOR = 12
#: Places from which an anchor's windows are dealt out one by one.
HOT = 500
#: Single windows whose counts a task holds.
SINGLES = 50_000
#: Words of a shard.
SHARD_WORDS = 150_000


def rolling(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` items, by doubling."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, at, part, size = None, 0, 0, h, 1
    while True:
        if length >> at & 1:
            piece = part[have : have + n]
            out = piece if out is None else mix(out, piece)
            have += size
        at += 1
        if not length >> at:
            return out
        part = mix(part[:-size], part[size:])
        size *= 2


def least_place(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of the least, the first of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    place, size = np.arange(len(values)), 1
    while 2 * size <= width:
        a, b = place[:-size], place[size:]
        place = np.where(values[b] < values[a], b, a)
        size *= 2
    a, b = place[:n], place[width - size : width - size + n]
    return np.where(values[b] < values[a], b, a)


class Windows:
    """Windows of the documents of a batch, and the segments into which their anchors cut them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int):
        self.starts, self.ends, self.bounds = word_spans(data, offsets)
        self.window = window
        self.h = hash_words(data, self.starts, self.ends)
        q = min(ANCHOR, window)
        doc = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        grams = rolling(self.h, q)
        place = least_place(grams, window - q + 1)
        whole = np.flatnonzero(doc[: len(place)] == doc[window - 1 :]) if len(place) else np.zeros(0, np.int64)
        # a segment: consecutive windows of one document with one anchor's place
        new = np.concatenate([[True], (place[whole][1:] != place[whole][:-1]) | (whole[1:] != whole[:-1] + 1)]) if len(whole) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.begin = whole[first]
        self.last = whole[np.append(first[1:], len(whole)) - 1] if len(whole) else whole
        self.doc = doc[self.begin] if len(whole) else whole
        self.anchor = grams[place[self.begin]] if len(whole) else np.zeros(0, np.uint64)


def _anchors(docs: DataFrame, text: str, known_by: tuple[str, ...], window: int) -> DataFrame:
    """(anchor, key, check) of each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text__"):
            w = Windows(*text_bytes(batch.column("text__")), window)
            key, check = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(w.anchor.view(np.int64)), pa.array(key[w.doc]), pa.array(check[w.doc])], names=["anchor", "key", "check"])

    source = docs.select(*row_keys(text, *known_by), F.col(text).alias("text__"))
    return map_arrow(source, run, "anchor long, key long, check int")


def _segments(met: DataFrame, window: int) -> DataFrame:
    """(route, segment, mark, words, n, places) of met (key__, check__, z__, anchors, hot): equal ones of a step are one row. Single
    windows have their words and count in a row without places for many steps, and rows of places without them.

    segment and mark are hashes of the words, made in different ways.
    """
    names = ["route", "segment", "mark", "words", "n", "places"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]

    def rows(columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        singles: dict[tuple[int, int, int], list] = {}

        def summed() -> pa.RecordBatch:
            found = [(*k, words, n, b"") for k, (words, n) in singles.items()]
            singles.clear()
            return rows(zip(*found, strict=True))

        for batch, texts in unpacked(batches):
            data, offsets = text_bytes(texts)
            raw = data.tobytes()
            w = Windows(data, offsets, window)
            known, owner = _listed(batch.column("anchors"))
            hot, hot_owner = _listed(batch.column("hot"))
            chosen = np.isin(mix(w.anchor, w.doc.astype(np.uint64)), mix(known, owner))
            common = np.isin(mix(w.anchor, w.doc.astype(np.uint64)), mix(hot, hot_owner))
            a, b, route, doc = (x[chosen & ~common] for x in (w.begin, w.last, w.anchor, w.doc))
            several = len(a)
            each = np.flatnonzero(chosen & common)
            if len(each):
                many = w.last[each] - w.begin[each] + 1
                one = np.repeat(w.begin[each] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                a, b = np.concatenate([a, one]), np.concatenate([b, one])
                doc = np.concatenate([doc, np.repeat(w.doc[each], many)])
                route = np.concatenate([route, rolling(w.h, window)[one]])
            if not len(a):
                continue
            end = b + window  # after the last word
            prefix = rolling(w.h, window)
            segment = mix(mix(prefix[a], prefix[b]), mix((end - a).astype(np.uint64), route)).view(np.int64)
            key, check = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key__", "check__"))
            places = np.column_stack([key[doc], check[doc].astype(np.int64) << 32 | a - w.bounds[doc]]).astype("<i8")
            tell, packed = [], []
            for single, some in ((False, slice(0, several)), (True, slice(several, len(a)))):
                index: dict[tuple[int, bytes], list[int]] = {}
                at = np.arange(len(a))[some].tolist()
                spans = zip(w.starts[a[some]].tolist(), w.ends[end[some] - 1].tolist(), strict=True)
                for k, x, (y, z) in zip(at, segment[some].tolist(), spans, strict=True):
                    index.setdefault((x, b" ".join(raw[y:z].split())), []).append(k)
                for (x, words), members in index.items():
                    ident = int(route[members[0]].view(np.int64)), x, xxhash.xxh3_64_intdigest(words) - (1 << 63)
                    if single:
                        singles.setdefault(ident, [words, 0])[1] += len(members)
                    tell.append((*ident, None if single else words, 0 if single else len(members)))
                    packed.append(places[members].tobytes())
            yield rows([*zip(*tell, strict=True), packed])
            if len(singles) > SINGLES:
                yield summed()
        if singles:
            yield summed()

    return map_arrow(met, run, "route long, segment long, mark long, words binary, n long, places binary")


def _listed(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    size = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
    return values, np.repeat(np.arange(len(column), dtype=np.uint64), size)


def _reports(segments: DataFrame, window: int) -> DataFrame:
    """(segment, mark, runs): packed (start, end) of the repeated runs of each segment that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, bytes], int] = {}
        size, last = 0, None

        def shard() -> pa.RecordBatch:
            index = FmIndex([words.split(b" ") for _, _, words in held], np.array(list(held.values())))
            found = [(k, r) for k, r in zip(held, index.repeats(window), strict=True) if r]
            return pa.RecordBatch.from_arrays([pa.array([k[c] for k, _ in found], pa.int64()) for c in (0, 1)] + [pa.array([np.array(r, "<i4").tobytes() for _, r in found], pa.binary())], names=["segment", "mark", "runs"])

        for batch in batches:
            for route, *ident, n in zip(*(batch.column(c).to_pylist() for c in ("route", "segment", "mark", "words", "n")), strict=True):
                if route != last and size >= SHARD_WORDS:
                    yield shard()
                    held, size = {}, 0
                last, ident = route, tuple(ident)
                if ident in held:
                    held[ident] += n
                else:
                    held[ident] = n
                    size += window + window // 3
        if held:
            yield shard()

    return map_arrow(segments.sortWithinPartitions("route"), run, "segment long, mark long, runs binary")


def _spread(met: DataFrame) -> DataFrame:
    """(key, check, runs): the runs of each place, counted in words of its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, check, runs = [], [], []
            for places, found in zip(batch.column("places").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                r = np.frombuffer(found, "<i4").astype("<i8")
                for k, start in np.frombuffer(places, "<i8").reshape(-1, 2).tolist():
                    key.append(k)
                    check.append(start >> 32)
                    runs.append((r + (start & 0xFFFFFFFF)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(check, pa.int32()), pa.array(runs, pa.binary())], names=["key", "check", "runs"])

    return map_arrow(met.select("places", "runs"), run, "key long, check int, runs binary")


def _own(packed: DataFrame) -> Column:
    return (F.col("key__") == F.col("key")) & (F.col("check__") == F.col("check"))


def repeated_runs(docs: DataFrame, packed: DataFrame, *, window: int, text: str, known_by: tuple[str, ...]) -> DataFrame:
    """(key, check, all_runs): for each document with repeats, packed (start, end) runs of words to remove."""
    anchors = _anchors(docs, text, known_by, window)
    often = written(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "anchors")
    marked = anchors.join(often, "anchor").select("key", "check", "anchor", (F.col("n") > HOT).alias("hot"))
    marked = marked.groupBy("key", "check").agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    met = packed.select("key__", "check__", "z__").join(marked.hint("shuffle_hash"), _own(packed)).drop("key", "check")
    segments = written(_segments(met, window), "segments")
    reports = _reports(segments.where("n > 0").select("route", "segment", "mark", "words", "n").repartition("route"), window)
    met = segments.where("octet_length(places) > 0").select("segment", "mark", "places").join(written(reports, "reports"), ["segment", "mark"])
    return _spread(met).groupBy("key", "check").agg(F.collect_set("runs").alias("all_runs"))


def _cut(docs: DataFrame, window: int, text: str, keep: tuple[str, ...], known_by: tuple[str, ...], columns: list[tuple[str, str]], make) -> DataFrame:
    packed = packed_docs(docs, text, keep, known_by)
    runs = repeated_runs(docs, packed, window=window, text=text, known_by=known_by)
    met = packed.join(runs.hint("shuffle_hash"), _own(packed), "left").select(*keep, "z__", "all_runs")
    schema = met.select(*keep).schema
    for name, kind in columns:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in unpacked(batches):
            rows = []
            for raw, all_runs in zip(texts.to_pylist(), batch.column("all_runs").to_pylist(), strict=True):
                words = (raw or b"").split()
                gone = np.zeros(len(words) + 1, np.int64)
                for r in all_runs or ():
                    for a, b in np.frombuffer(r, "<i8").reshape(-1, 2).tolist():
                        gone[a] += 1
                        gone[b] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                rows.append(make(raw, words, gone))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in range(len(keep))] + [pa.array(c, schema[name].dataType.simpleString().replace("bigint", "int64")) for c, (name, _) in zip(zip(*rows, strict=True), columns, strict=True)], names=schema.names)

    return map_arrow(met, run, schema)


def _kept(words: list[bytes], gone: np.ndarray) -> bytes:
    return b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if gone.any() else b" ".join(words)


def substring_dedup(docs: DataFrame, *, window: int = 35, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_words, n_removed, kept_sha256 of each row of docs."""

    def make(raw: bytes | None, words: list[bytes], gone: np.ndarray) -> tuple:
        return len(words), int(gone.sum()), hashlib.sha256(_kept(words, gone)).hexdigest()

    return _cut(docs, window, text, keep, keep, [("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string")], make)


def remove_repeats(docs: DataFrame, *, window: int = 35) -> DataFrame:
    """docs (doc_id, text, n_chars) without the repeated words; an untouched text stays as it is, byte for byte."""
    others = [c for c in docs.columns if c != "text"]

    def make(raw: bytes | None, words: list[bytes], gone: np.ndarray) -> tuple:
        return (raw if raw is None else (_kept(words, gone) if gone.any() else raw).decode(),)

    # the other columns are one, so that their names and types are their own
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row__"), F.col("doc_id").alias("id__"), "text")
    out = _cut(held, window, "text", ("row__", "id__"), ("id__",), [("text", "string")], make)
    size = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in others else None
    return out.select(*[F.col("text") if c == "text" else size.alias(c) if c == "n_chars" else F.col(f"row__.`{c}`").alias(c) for c in docs.columns])
