"""Near duplicates at a given shingle similarity, by pigeonhole blocks of long SimHash fingerprints.

At a Jaccard similarity of 0.8 two 64-bit fingerprints differ in about ten bits, and blocks that such a
pair shares for certain are too short to tell texts apart. So the fingerprint here is as long as the
text asks for: its shingles are parted by their hash into groups, and the SimHash of each group is one
64-bit block. Two texts whose shingle sets differ in d shingles differ in d groups at most. Texts of n
shingles get more than d groups, for the largest d that the similarity allows, so close pairs share
blocks: of short texts all groups are kept, over several partings; of long ones ``KEYS`` of twice as many
groups as d, of which close pairs share more than a third on average (none in less than one of a
million). As d follows the size, sizes are classes by the ratio of the similarity, and a text has a
fingerprint for its own class and one for the next, which is where a partner of another class looks.

Texts are joined on blocks; blocks with the same members are one. Members are near whose fingerprints differ
in ``RADIUS`` of 64 bits or fewer, over all blocks of the class they meet in. At a similarity of 0.8 that is 6
bits on average; of 8 million simulated pairs at that limit the furthest had 18, and unrelated texts have about
29. The components of near members, which are the same in many blocks and then one, are verified by their
exact similarity, and what leaves them is a spanning forest. A block of more than ``MOST`` members is cut into
tiles, and each pair of tiles is compared by itself, so no task holds more than two tiles. Equal shingle sets
are one row from the start.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, written
from .simhash_dedup import components, shingle_hashes

#: Blocks of a text in a size class.
KEYS = 24
#: Members of a tile.
MOST = 4096
#: Differing bits of 64 up to which fingerprints are near.
RADIUS = 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def size_class(n: int, similarity: float) -> int:
    return int(math.log(n) / -math.log(similarity)) if n else 0


def groups_of(level: int, similarity: float) -> int:
    """Groups into which the texts of a class are parted."""
    largest = math.ceil(similarity ** -(level + 1))
    differ = int(2 * largest * (1 - similarity) / (1 + similarity))
    return differ + 1 if differ < KEYS // 2 else max(KEYS, 2 * differ)


def parted(shingles: np.ndarray, parting: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Group and 64 bits of each shingle; every parting has its own."""
    h = (shingles ^ np.uint64(parting * 7 + 1)) * _M1
    h = (h ^ h >> np.uint64(32)) * _M2
    bits = (h ^ h >> np.uint64(29)) * _M1
    return ((h >> np.uint64(32)) % np.uint64(groups)).astype(np.int64), bits ^ bits >> np.uint64(32)


def fingerprint(shingles: np.ndarray, level: int, similarity: float) -> np.ndarray:
    """Blocks of a text with these distinct shingle hashes: the SimHash of each group, by parting; zero without shingles."""
    groups = groups_of(level, similarity)
    kept, partings = min(groups, KEYS), -(-KEYS // groups)
    out = np.zeros(partings * kept, np.uint64)
    for parting in range(partings if len(shingles) else 0):
        group, bits = parted(shingles, parting, groups)
        order = np.argsort(group, kind="stable") if groups <= KEYS else (some := np.flatnonzero(group < KEYS))[np.argsort(group[some], kind="stable")]
        if not len(order):
            continue
        group = group[order]
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        ones = np.add.reduceat(np.unpackbits(bits[order].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), begin, axis=0, dtype=np.int64)
        more = 2 * ones > np.diff(np.append(begin, len(group)))[:, None]
        out[parting * kept + group[begin]] = np.packbits(more, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


@cache
def salts(level: int, similarity: float) -> np.ndarray:
    """What tells the blocks of a class and place apart as join keys: a key is the block xor its salt."""
    x = np.arange(len(fingerprint(np.zeros(0, np.uint64), level, similarity)), dtype=np.uint64) + np.uint64(level + 1 << 16)
    x = (x * _M1 ^ x * _M1 >> np.uint64(29)) * _M2
    return x ^ x >> np.uint64(32)


def both_fingerprints(shingles: np.ndarray, similarity: float) -> bytes:
    """A text's class, and its fingerprints for that and for the next; nothing without shingles."""
    own = size_class(len(shingles), similarity)
    return np.concatenate([np.array([own], np.uint64), *(fingerprint(shingles, level, similarity) for level in (own, own + 1))]).tobytes() if len(shingles) else b""


def by_class(both: bytes, similarity: float) -> list[tuple[int, np.ndarray]]:
    """The classes and fingerprints that both_fingerprints packed."""
    if not both:
        return []
    own, blocks = int.from_bytes(both[:8], "little"), np.frombuffer(both, "<u8", offset=8)
    n = len(salts(own, similarity))
    return [(own, blocks[:n]), (own + 1, blocks[n:])]


def _keyed(marked: DataFrame, similarity: float) -> DataFrame:
    """(key, id) for each block of the fingerprints of marked (id, blocks) that has a bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.concatenate([(f ^ salts(level, similarity))[f != 0] for level, f in by_class(both, similarity)] or [np.zeros(0, np.uint64)]) for both in batch.column("blocks").to_pylist()]
            ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), np.fromiter(map(len, keys), np.int64, len(keys)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)), pa.array(ids, pa.int64())], names=["key", "id"])

    return map_arrow(marked.select("id", "blocks"), run, "key long, id long")


def spanning(n: int, near: Callable[[int], np.ndarray]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that connect all of n that are near by pairs, and a root of each; near(i) are those near to i."""
    root, out, left = np.arange(n), [], np.ones(n, bool)
    while len(out) < n - 1:
        # all links but those within one component have been seen when the unvisited are all in it; which one
        # it is may change, so it is chosen anew: the one with the most unvisited
        todo = np.flatnonzero(left)
        todo = todo[root[todo] != np.bincount(root[todo], minlength=n).argmax()] if len(todo) else todo
        if not len(todo):
            break
        i = int(todo[0])
        left[i] = False
        found = near(i)
        for r in np.unique(root[found]).tolist():
            if r != root[i]:
                out.append((i, int(found[root[found] == r][0])))
                root[root == r] = root[i]
    return out, root


def near_groups(fingerprints: np.ndarray, radius: int) -> list[np.ndarray]:
    """Components of two or more among fingerprints (a row of blocks each) by their exact Hamming distances."""
    n, most = len(fingerprints), radius * fingerprints.shape[1]
    links, root = spanning(n, lambda i: np.flatnonzero(np.bitwise_count(fingerprints ^ fingerprints[i]).sum(1, dtype=np.int64) <= most))
    return [np.flatnonzero(root == r) for r in np.unique(root[[a for a, _ in links]]).tolist()] if links else []


def forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect all whose Jaccard similarity is enough, as exact set sizes tell."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    known, column = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    flag = np.zeros(len(known), bool)

    def near(i: int) -> np.ndarray:
        own = column[begin[i] : begin[i] + sizes[i]]
        flag[own] = True
        both = np.add.reduceat(flag[column].astype(np.int64), begin) if sizes.all() else np.array([flag[column[b : b + s]].sum() for b, s in zip(begin, sizes, strict=True)])
        flag[own] = False
        return np.flatnonzero(both >= similarity * (sizes[i] + sizes - both) - 1e-9)

    return spanning(n, near)[0]


def _shared(keyed: DataFrame) -> DataFrame:
    """Of the blocks of keyed (key, id) with two members or more: a row (key, id) for each, and one with n,
    the least id and a mark of all ids. A block's members are read in order and not held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] | None = None  # key, members, mark, least id, last id of the block that may go on

        def rows(key, number, n=None, mark=None) -> pa.RecordBatch:
            none = pa.nulls(len(key), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(number, pa.int64()), none if n is None else pa.array(n, pa.int64()), none if mark is None else pa.array(mark, pa.int64())], names=["key", "id", "n", "mark"])

        for batch in batches:
            key, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id"))
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (number[1:] != number[:-1])])
            if held is not None and len(key) and held[0] == key[0] and held[4] == number[0]:
                new[0] = False
            key, number = key[new], number[new]
            if not len(key):
                continue
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n, mark, least = np.diff(np.append(begin, len(key))), np.bitwise_xor.reduceat(number, begin), number[begin].copy()
            if held is not None and held[0] == key[0]:
                if held[1] == 1:
                    yield rows([held[0]], [held[3]])
                n[0] += held[1]
                mark[0] ^= held[2]
                least[0] = held[3]
            elif held is not None and held[1] > 1:
                yield rows([held[0]], [held[3]], [held[1]], [held[2]])
            several = np.repeat(n > 1, np.diff(np.append(begin, len(key))))
            yield rows(key[several], number[several])
            done = np.flatnonzero(n[:-1] > 1)
            yield rows(key[begin[done]], least[done], n[done], mark[done])
            held = [int(key[-1]), int(n[-1]), int(mark[-1]), int(least[-1]), int(number[-1])]
        if held is not None and held[1] > 1:
            yield rows([held[0]], [held[3]], [held[1]], [held[2]])

    return map_arrow(keyed.repartition("key").sortWithinPartitions("key", "id"), run, "key long, id long, n long, mark long")


def _near(rows: DataFrame, similarity: float, radius: int) -> DataFrame:
    """(part, id): components of two or more by the distances of the rows (key, tile, other, id, blocks) of each key and
    pair of tiles. part is a mark of the component's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, prints = None, [], []

        def parts() -> Iterator[pa.RecordBatch]:
            # the class they meet in: the one whose block, salted, is the key
            met = [next((level, f) for level, f in by_class(both, similarity) if ((f ^ salts(level, similarity)) == key).any()) for both in prints]
            for level in {level for level, _ in met}:
                number = np.array([i for i, (own, _) in zip(ids, met, strict=True) if own == level], np.int64)
                for some in near_groups(np.stack([f for own, f in met if own == level]), radius):
                    h = number[some].view(np.uint64) * _M2
                    part = np.bitwise_xor.reduce((h ^ h >> np.uint64(29)) * _M1).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), part)), pa.array(number[some])], names=["part", "id"])

        for batch in batches:
            for *place, number, both in zip(*(batch.column(c).to_pylist() for c in ("key", "tile", "other", "id", "blocks")), strict=True):
                if place != at:
                    if len(ids) > 1:
                        yield from parts()
                    at, ids, prints, key = place, [], [], np.int64(place[0]).view(np.uint64)
                ids.append(number)
                prints.append(both)
        if len(ids) > 1:
            yield from parts()

    return map_arrow(rows.repartition("key", "tile", "other").sortWithinPartitions("key", "tile", "other", "id"), run, "part long, id long")


def _verified(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b) links among the rows (part, id, set) of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sets = None, [], []

        def links() -> pa.RecordBatch:
            found = forest([np.frombuffer(s, "<u4") for s in sets], similarity) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[x] for x, _ in found], pa.int64()), pa.array([ids[y] for _, y in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for part, number, members in zip(*(batch.column(c).to_pylist() for c in ("part", "id", "set")), strict=True):
                if part != at:
                    if len(ids) > 1:
                        yield links()
                    at, ids, sets = part, [], []
                ids.append(number)
                sets.append(members)
        if len(ids) > 1:
            yield links()

    return map_arrow(rows.repartition("part").sortWithinPartitions("part", "id"), run, "a long, b long")


def similar_groups(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and component_id: the least id of the texts reachable over pairs similar enough, of those near by radius.

    The shingles of a text count once each; a text of fewer words is one shingle, its whole sequence.
    Texts without words are each similar to one another. Null ids are never a component's name
    unless the group has no other.
    """
    source = docs.select(doc_id, F.col(text).alias("text__"))
    schema = source.select(doc_id).schema.add("id", "long").add("blocks", "binary").add("set", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints, sets = [], [], []
            for x in batch.column("text__"):
                h = np.unique(shingle_hashes((x.as_py() or "").encode(), words))
                ids.append(int(np.bitwise_xor.reduce((h ^ h >> np.uint64(29)) * _M1)) if len(h) else 0)
                prints.append(both_fingerprints(h, similarity))
                sets.append(np.unique((h >> np.uint64(32)).astype("<u4")).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(prints, pa.binary()), pa.array(sets, pa.binary())], names=schema.names)

    marked = written(map_arrow(source, run, schema), "shingled")
    distinct = marked.groupBy("id").agg(F.min(doc_id).alias("least"))
    shared = written(_shared(_keyed(marked, similarity)), "shared")
    # blocks with the same members are one
    once = shared.where("n is not null").groupBy("n", "mark", "id").agg(F.min("key").alias("key")).select("key", "n")
    tiles = F.ceil(F.col("n") / MOST).cast("int")
    own = F.pmod(F.xxhash64("id"), tiles)
    rows = shared.where("n is null").select("key", "id").join(once, "key").select("key", "id", own.alias("own"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("beside"))
    rows = rows.select("key", "id", F.least("own", "beside").alias("tile"), F.greatest("own", "beside").alias("other"))
    one = lambda column: marked.groupBy("id").agg(F.min(column).alias(column))
    near = written(_near(rows.join(one("blocks"), "id"), similarity, radius).distinct(), "near")
    links = _verified(near.join(one("set"), "id"), similarity)
    roots = components(links)
    rooted = distinct.join(roots, distinct["id"] == roots["node"], "left").select("id", "least", F.coalesce("root", "id").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.select(doc_id, "id").join(rooted.join(named, "root").select("id", "component_id"), "id").select(doc_id, "component_id")


def one_of_each(docs: DataFrame, *, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs (doc_id, text) without the other documents of each group: those whose id names it stay, and of a
    group without ids one row. Rows are told apart by id and text, so a text goes with its own group only."""
    key = F.xxhash64("text")
    rows = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key.alias("text_key")).alias("row"), "text")
    found = similar_groups(rows, words=words, similarity=similarity, doc_id="row").select("row.*", F.col("component_id").alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (~F.col("none") | (F.col("text_key") == F.col("first.text_key")))
    gone = written(found.where(~stays).select("doc_id", "text_key").distinct(), "gone")
    xxhash_of = lambda table: F.xxhash64(table["text"])
    # gone grows with docs, so it is never broadcast
    left = docs.where("doc_id is not null").join(gone.where("doc_id is not null").hint("shuffle_hash"), (docs["doc_id"] == gone["doc_id"]) & (xxhash_of(docs) == gone["text_key"]), "left_anti")
    nameless = docs.where("doc_id is null").join(gone.where("doc_id is null"), xxhash_of(docs) == gone["text_key"], "left_anti")
    return left.unionByName(nameless.dropDuplicates(["text"]))
