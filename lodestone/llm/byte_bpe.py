"""Byte-level BPE encoding and decoding.

A pre-token's merges run over a segment tree: its leaves are byte positions and hold the rank of
the pair that begins there, its nodes the leftmost least rank below them. The root is the next
merge; a merge changes at most three leaves, each a logarithmic walk, so a pre-token of n bytes
takes O(n log n) however long it is. Pre-tokens repeat, so a worker keeps the ids of the recent
ones; both generations of that memory are bounded.

Null and empty texts have no ids; their digests are those of empty bytes. Repeated rows give
repeated results; other columns of the input pass unread.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import map_arrow, steps

#: Pre-tokens that a generation of a worker's memory holds at most.
MEMORY = 150_000
#: Bytes of pre-tokens and ids (beside a bounded number of objects) that a generation holds, and one step beyond it.
MEMORY_BYTES = 32 << 20
#: Texts with more characters are cut into pre-tokens piece by piece.
LONG = 4 << 20
_POS = (1 << 40) - 1
_NONE = 1 << 80
#: Pre-tokens of up to _WIDE bytes are merged together, _LANES at a time.
_WIDE, _LANES = 128, 20_000
_NO = np.int64(1 << 40)

# In texts without characters above U+024F the classes of the pattern are these ranges, and the
# standard library's matcher, which is faster, gives the same pre-tokens.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_BEYOND = re.compile("[^\x00-ɏ]")
_PLAIN = {r"\p{L}": _L, r"\p{N}": _N, r"\s": _S}


def _plain_pattern(pattern: str) -> re.Pattern | None:
    """The pattern with its three classes as ranges; None if it has others."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        for name, chars in _PLAIN.items():
            if pattern.startswith(name, i):
                out.append(chars if inside else f"[{chars}]")
                i += len(name)
                break
        else:
            if pattern.startswith(r"\S", i) and not inside:
                out.append(f"[^{_S}]")
                i += 2
                continue
            if pattern[i] == "\\":
                return None
            inside = (inside or pattern[i] == "[") and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
    return re.compile("".join(out))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with lines of base64 bytes and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBpe:
    """Encodes and decodes by a table of ranks; each match of the pattern by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.slow, self.plain = regex.compile(pattern), _plain_pattern(pattern)
        self.new, self.old, self.size = {}, {}, 0
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {ranks[x] << 32 | ranks[y]: r for token, r in ranks.items() for cut in range(1, len(token)) if (x := token[:cut]) in ranks and (y := token[cut:]) in ranks}
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in sorted(pairs)], np.int64)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n, get = len(piece), ranks.get
        size = 1 << (n - 1).bit_length()
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            if (r := get(piece[i : i + 2])) is not None:
                tree[size + i] = r << 40 | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while (top := tree[1]) != _NONE:
            i = top & _POS
            j = after[i]
            after[i] = k = after[j]
            r = None
            if k < n:
                before[k] = i
                r = get(piece[i : after[k]])
            changes = [(i, r), (j, None)]
            if (p := before[i]) >= 0:
                changes.append((p, get(piece[p:k])))
            for leaf, r in changes:
                x, value = size + leaf, _NONE if r is None else r << 40 | leaf
                tree[x] = value
                while x > 1:
                    value = min(value, tree[x ^ 1])
                    x >>= 1
                    if tree[x] == value:
                        break
                    tree[x] = value
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many pre-tokens: the trees of equal size take their steps together."""
        out: list[bytes] = [b""] * len(pieces)
        lanes: dict[int, list[int]] = {}
        for n, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[n] = whole.to_bytes(4, "little")
            elif len(piece) > _WIDE or len(pieces) < 32:
                out[n] = np.array(self.merge(piece), "<u4").tobytes()
            else:
                lanes.setdefault(max(8, 1 << (len(piece) - 1).bit_length()), []).append(n)
        for size, all_of in lanes.items():
            for at in range(0, len(all_of), _LANES):
                some = all_of[at : at + _LANES]
                for n, ids in zip(some, self._together([pieces[n] for n in some], size), strict=True):
                    out[n] = ids
        return out

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that two tokens form, or _NO."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NO)

    def _together(self, pieces: list[bytes], size: int) -> list[bytes]:
        m, width = len(pieces), size + 2
        length = np.fromiter(map(len, pieces), np.int64, m)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(m, size)
        token = np.zeros((m, width), np.int64)
        token[:, :size] = self.byte_rank[raw]
        place = np.arange(width)
        after = np.broadcast_to(np.minimum(place + 1, size + 1), (m, width)).copy()
        before = np.broadcast_to(place - 1, (m, width)).copy()
        tree = np.full((m, 2 * size), _NO << 8, np.int64)
        rank = self._pair(token[:, : size - 1], token[:, 1:size])
        rank[place[: size - 1] >= (length - 1)[:, None]] = _NO
        tree[:, size : 2 * size - 1] = np.where(rank == _NO, _NO << 8, rank << 8 | place[: size - 1])
        low = size
        while low > 1:
            tree[:, low // 2 : low] = np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2])
            low //= 2
        live = np.arange(m)
        while True:
            root = tree[live, 1]
            going = root < _NO << 8
            live, root = live[going], root[going]
            if not len(live):
                break
            i, end = root & 255, length[live]
            j = after[live, i]
            k = after[live, j]
            token[live, i] = root >> 8
            after[live, i] = k
            before[live, k] = i
            p = before[live, i]
            right = np.where(k < end, self._pair(token[live, i], token[live, np.minimum(k, size)]), _NO)
            left = np.where(p >= 0, self._pair(token[live, p], token[live, i]), _NO)
            for leaf, rank in ((j, None), (i, right), (np.maximum(p, 0), left)):
                if rank is None:
                    value, who, x = np.full(len(live), _NO << 8), live, size + leaf
                else:
                    value, who, x = np.where(rank == _NO, _NO << 8, rank << 8 | leaf), live, size + leaf
                    if rank is left:
                        who, x, value = live[p >= 0], x[p >= 0], value[p >= 0]
                tree[who, x] = value
                for _ in range(size.bit_length() - 1):
                    x = x >> 1
                    tree[who, x] = np.minimum(tree[who, 2 * x], tree[who, 2 * x + 1])
        alive = np.zeros((m, width), bool)
        at, rows = np.zeros(m, np.int64), np.arange(m)
        while len(rows):
            alive[rows, at] = True
            at = after[rows, at]
            going = at < length[rows]
            rows, at = rows[going], at[going]
        ids, count = token[alive].astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(alive.sum(1))]) * 4
        return [ids[a:b] for a, b in zip(count[:-1].tolist(), count[1:].tolist(), strict=True)]

    def learn(self, pieces: set[str]) -> None:
        """Bring pre-tokens into memory."""
        if len(self.new) > MEMORY or self.size > MEMORY_BYTES:
            self.old, self.new, self.size = self.new, {}, 0
        new, old = self.new, self.old
        unknown = []
        for piece in pieces:
            if piece not in new:
                if (packed := old.get(piece)) is None:
                    unknown.append(piece)
                else:
                    new[piece] = packed
        merged = self.merge_many([x.encode() for x in unknown])
        new.update(zip(unknown, merged, strict=True))
        self.size += sum(map(len, unknown)) + sum(map(len, merged))

    def packed(self, pieces: list[str]) -> bytes:
        """Ids of pre-tokens as little-endian unsigned 32-bit integers."""
        self.learn(set(pieces))
        return b"".join(map(self.new.__getitem__, pieces))

    def packed_texts(self, texts: list[str]) -> Iterator[Iterator[bytes]]:
        """encode_packed of each text, with the unknown pre-tokens of all of them merged together."""
        found = [None if len(x) > LONG else self.matcher(x).findall(x) for x in texts]
        self.learn(set().union(*(x for x in found if x)))
        # before a long text, which may have the memory forget them
        short = [None if pieces is None else b"".join(map(self.new.__getitem__, pieces)) for pieces in found]
        for text, packed in zip(texts, short, strict=True):
            yield self.encode_packed(text) if packed is None else iter((packed,))

    def matcher(self, text: str) -> re.Pattern:
        return self.slow if self.plain is None or _BEYOND.search(text) else self.plain

    def encode_packed(self, text: str) -> Iterator[bytes]:
        """The packed ids of a text, in one or, if it is long, several parts."""
        match = self.matcher(text)
        if len(text) <= LONG:
            yield self.packed(match.findall(text))
            return
        found = (m.group() for m in match.finditer(text))
        while some := list(islice(found, 1 << 16)):
            yield self.packed(some)

    def encode(self, text: str | None) -> list[int]:
        return [i for part in self.encode_packed(text or "") for i in np.frombuffer(part, "<u4").tolist()]

    def decode_packed(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_loaded: dict[tuple[str, str], ByteBpe] = {}


def load(path: str, pattern: str) -> ByteBpe:
    """The encoder of a vocabulary file, kept by the worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _loaded[path, pattern]


def bpe_encode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encode each text, decode the ids again, and give the count and digests of both.

    ``path`` names a vocabulary file that every machine has. Columns ``keep`` pass through;
    ``ids`` (array<int>) follows if ``with_ids``. One map over the rows, without a shuffle.
    """
    source = docs.select(*keep, F.col(text).alias("text__"))
    schema = source.drop("text__").schema
    for name, kind in (("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")):
        schema = schema.add(name, kind)
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in steps(batches, "text__"):
            n, ids_sha, out_sha, ids = [], [], [], []
            for encoded in bpe.packed_texts([x or "" for x in batch.column("text__").to_pylist()]):
                ids_hash, out_hash, count, parts = hashlib.sha256(), hashlib.sha256(), 0, []
                for packed in encoded:
                    count += len(packed) // 4
                    ids_hash.update(packed)
                    out_hash.update(bpe.decode_packed(packed))
                    if with_ids:
                        parts.append(np.frombuffer(packed, "<i4"))
                n.append(count)
                ids_sha.append(ids_hash.hexdigest())
                out_sha.append(out_hash.hexdigest())
                if with_ids:
                    ids.append(np.concatenate(parts) if parts else np.zeros(0, np.int32))
            columns = [batch.column(c) for c in range(len(keep))] + [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_arrow(source, run, schema)
