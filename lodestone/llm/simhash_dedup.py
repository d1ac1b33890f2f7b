"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint's 64 bits are cut into ``BLOCKS`` blocks. Two fingerprints at ``radius`` = 3 or fewer
differing bits agree in at least three of six blocks, so each pair meets in one of the 20 keys that
three whole blocks make; the keys fix about 32 bits, so chance meetings stay rare. Equal fingerprints
are one row from the start, so copies cost nothing. Buckets are compared in blocks of rows with exact
Hamming distances. A bucket that has more than ``MOST`` fingerprints is dealt again by three of six
blocks of the bits that its key leaves free; such a key fixes 48 bits, so no more than 2 ** 16
different fingerprints can share it, and that bound holds at any size. What leaves a bucket is a
spanning forest of its links, not its pairs.

The components of all links come from label propagation with pointer jumping over tables in the
shared folder: each round is grouped minima, which Spark sums up before the shuffle.

A text without words has fingerprint zero and links like any other; null texts count as such.
A null id keeps its row, with its group's component; ids that are null are never a component's name
unless the group has no other. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, steps, written

BLOCKS = 6
#: A bucket with more fingerprints is dealt again.
MOST = 2048
_COMBINATIONS = list(combinations(range(BLOCKS), 3))
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of a text, repeats included; its whole sequence if it has fewer words."""
    w = text.translate(_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)) if len(w) > words else (b" ".join(w),)
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if more than half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, words: int = 3, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and fp (the fingerprint's bits as a long)."""
    source = docs.select(*keep, F.col(text).alias("text__"))
    schema = source.drop("text__").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text__"):
            fp = [fingerprint(shingle_hashes((x or "").encode(), words)) for x in batch.column("text__").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in range(len(keep))] + [pa.array(np.array(fp, np.uint64).view(np.int64))], names=schema.names)

    return map_arrow(source, run, schema)


def _cuts(width: int) -> list[int]:
    return [width * k // BLOCKS for k in range(BLOCKS + 1)]


def block_masks() -> list[int]:
    """Masks of the bits that each of the 20 keys fixes."""
    cut = _cuts(64)
    block = [(1 << cut[k + 1]) - (1 << cut[k]) for k in range(BLOCKS)]
    return [sum(block[k] for k in some) for some in _COMBINATIONS]


def finer_masks(mask: int) -> list[int]:
    """Masks that fix, besides mask, three of six blocks of the bits it leaves free."""
    free = [b for b in range(64) if not mask >> b & 1]
    cut = _cuts(len(free))
    block = [sum(1 << b for b in free[cut[k] : cut[k + 1]]) for k in range(BLOCKS)]
    return [mask | sum(block[k] for k in some) for some in _COMBINATIONS]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fp: np.ndarray, radius: int) -> np.ndarray:
    """Of each of the distinct fingerprints the index of its component's first, by exact distances."""
    n = len(fp)
    root = np.arange(n)
    while True:
        least = root.copy()
        for a in range(0, n, 1024):
            for b in range(a, n, 1024):
                x, y = np.nonzero(np.bitwise_count(fp[a : a + 1024, None] ^ fp[None, b : b + 1024]) <= radius)
                x, y = x + a, y + b
                np.minimum.at(least, root[x], root[y])
                np.minimum.at(least, root[y], root[x])
        while (further := least[least]).tolist() != least.tolist():
            least = further
        joined = least[root]
        if np.array_equal(joined, root):
            return root
        root = joined


def _links(keyed: DataFrame, radius: int) -> DataFrame:
    """(a, b): spanning links of the fingerprints that share (which, key); rows sorted within partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def linked(which, key, fp):
            edge = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (key[1:] != key[:-1]), [True]]))
            size = np.diff(edge)
            first, second = [], []
            for s, n in zip(edge[:-1][size > 1], size[size > 1], strict=True):
                group = fp[s : s + n].view(np.uint64)
                if n == 2:
                    if int(group[0] ^ group[1]).bit_count() <= radius:
                        first.append(fp[s : s + 1])
                        second.append(fp[s + 1 : s + 2])
                    continue
                root = forest(group, radius)
                # a chain through each component, so that no fingerprint has many links
                order = np.lexsort((np.arange(n), root))
                same = root[order][1:] == root[order][:-1]
                first.append(fp[s : s + n][order[:-1][same]])
                second.append(fp[s : s + n][order[1:][same]])
            if first:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), pa.array(np.concatenate(second))], names=["a", "b"])
            return None

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("which", "key", "fp")]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            which, key = columns[:2]
            change = np.flatnonzero((which[1:] != which[:-1]) | (key[1:] != key[:-1]))
            if not len(change):
                rest = columns
                continue
            cut = int(change[-1]) + 1
            rest = [c[cut:] for c in columns]
            if (out := linked(*(c[:cut] for c in columns))) is not None:
                yield out
        if rest is not None and (out := linked(*rest)) is not None:
            yield out

    return map_arrow(keyed.sortWithinPartitions("which", "key", "fp"), run, "a long, b long")


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b) links that connect every two fingerprints of ``distinct`` (fp) within ``radius`` bits."""
    if radius > BLOCKS - 3:
        raise ValueError(f"{BLOCKS} blocks of which three are whole find up to {BLOCKS - 3} differing bits")
    masks = block_masks()
    table = lambda ms: F.array(*[F.lit(_signed(m)) for m in ms])
    keyed = distinct.select("fp", F.posexplode(table(masks)).alias("which", "mask")).select("fp", "which", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    sizes = keyed.groupBy("which", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = written(sizes, "buckets")
    # most keys are alone: those rows go before the fingerprints are dealt out
    met = keyed.join(sizes, ["which", "key"])
    small = _links(met.where(F.col("n") <= MOST).select("which", "key", "fp").repartition("which", "key"), radius)
    if sizes.where(F.col("n") > MOST).isEmpty():
        return small
    finer = F.array(*[table(finer_masks(m)) for m in masks])
    again = (
        met.where(F.col("n") > MOST)
        .select("fp", "which", F.posexplode(F.element_at(finer, F.col("which") + 1)).alias("finer", "mask"))
        .select((F.col("which") * len(masks) + F.col("finer") + len(masks)).alias("which"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    )
    return small.unionByName(_links(again.repartition("which", "key"), radius))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable over edges (a, b), for the nodes that have edges."""
    both = written(edges.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")), "labels")
    while True:
        # the least label among neighbours, offered to a node and to the node that its label names
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        offered = labels.join(near, "node", "left").select("node", "root", F.least("root", "r").alias("r"))
        hooks = offered.select(F.explode(F.array(F.struct("node", "r"), F.struct(F.col("root").alias("node"), F.col("r")))).alias("h")).select("h.*")
        hooked = hooks.groupBy("node").agg(F.min("r").alias("r"))
        # pointer jumping: a label's own label
        further = hooked.select(F.col("node").alias("r"), F.col("r").alias("rr"))
        jumped = hooked.join(further, "r", "left").select("node", F.least("r", F.coalesce("rr", "r")).alias("root"))
        new = written(jumped, "labels")
        changed = new.join(labels.select("node", F.col("root").alias("before")), "node").where("root <> before").isEmpty()
        labels = new
        if changed:
            return labels


def near_duplicates(docs: DataFrame, *, words: int = 3, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row."""
    marked = written(fingerprints(docs, words=words, text=text, keep=(doc_id,)), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min(doc_id).alias("least"))
    distinct = written(distinct, "distinct")
    roots = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select(doc_id, hex16("fp").alias("fingerprint"), "component_id")


def hex16(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def one_of_each(docs: DataFrame, *, words: int = 3, radius: int = 3) -> DataFrame:
    """The rows of docs (doc_id) that name their near-duplicate group: one document of each stays."""
    found = near_duplicates(docs, words=words, radius=radius)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
