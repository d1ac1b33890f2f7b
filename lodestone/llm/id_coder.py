"""An adaptive context-mixing range coder for token ids, in independent blocks.

The probability of an id is a linear mixture of three distributions: those of the ids after the two ids
before it (order 2), after the one before it (order 1) and of all ids (order 0), each from counts within the
block. A distribution is laid out by ascending id, so the interval of an id in the mixture begins at the
mixed sum of what lies below it in each: no order takes an id for itself, and no share is lost to an id that
another order names too. The share of a context's own counts follows from how often contexts that have been seen
about as often met an id that they had not (Good and Turing: the part of their counts that are ones).

A block's ids are cut into up to ``STREAMS`` runs that are coded side by side, an id of each at a time, by one
model; a step is a few vector operations. The model adapts at the steps of ``REBUILT``: it then takes in all ids
of the steps before. Between them the decoder finds an id by its slot in a table of each context, from order 2
down; the encoder, which knows all ids, gets all intervals of such a stretch at once.

Every block starts from the same state: the header has its distinct ids, and the model knows nothing else.
It also has the number of ids, its size and checksums of the coded bytes and of the ids. All sums are of
integers, or of doubles whose operations are exact by IEEE 754, so a block is read alike everywhere.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

STREAMS, RUN = 8192, 128
#: Ids of a block at most.
BLOCK_IDS = STREAMS * RUN
#: Steps before which the model takes in what has been coded.
REBUILT = (1, 5, 24)
#: Bits of the sum of all order-0 frequencies, of the mixture's sum, and of the range: kept above ``_LEAST``.
_FREQ, _TOTAL, _LEAST = 20, 30, 32
_ALL = 1 << _TOTAL
_MASK = (1 << _LEAST) - 1
_POSITION = 21
_HEAD = struct.Struct("<4sIIIIIII")  # magic, ids, vocabulary, streams, bytes of the alphabet, of the runs, crc of both, crc of ids
MAGIC = b"LIDC"


def _layout(n: int) -> tuple[int, int]:
    """Runs of a block of n ids, and the ids of the longest."""
    runs = max(1, min(STREAMS, -(-n // RUN)))
    return runs, -(-n // runs)


def _live(n: int, runs: int, longest: int) -> np.ndarray:
    """Where each step's ids begin among all, ordered by step and run; the last runs end first."""
    left = np.clip(n - np.arange(runs) * longest, 0, longest)
    return np.concatenate([[0], np.cumsum([int((left > t).sum()) for t in range(longest)])])


def _spans(longest: int) -> list[tuple[int, int]]:
    cut = [0, *(t for t in REBUILT if t < longest), longest]
    return list(zip(cut[:-1], cut[1:], strict=True))


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their counts, a position of each, and the rank of the key at each position."""
    packed = np.sort(keys << _POSITION | np.arange(len(keys)))
    at, packed = packed & ((1 << _POSITION) - 1), packed >> _POSITION
    new = np.empty(len(packed), bool)
    new[:1] = True
    np.not_equal(packed[1:], packed[:-1], out=new[1:])
    begin = np.flatnonzero(new)
    rank = np.empty(len(packed), np.int32)
    rank[at] = np.cumsum(new, dtype=np.int32) - 1
    return packed[begin], np.diff(np.append(begin, len(packed))), at[begin], rank


def _order0(counts: np.ndarray) -> np.ndarray:
    """Cumulative sums of frequencies, 2 ** _TOTAL in all, each above 0."""
    weight = 16 * counts + 1
    f = 1 + weight * ((1 << _FREQ) - len(counts)) // int(weight.sum())
    f[int(counts.argmax())] += (1 << _FREQ) - int(f.sum())
    return np.concatenate([[0], np.cumsum(f)]) << (_TOTAL - _FREQ)


def _masses(context: np.ndarray, counts: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """What the entries of each context get of the mixture: cumulative sums, for a first row of each context (0) and
    its entries; and what each context leaves to the order below.

    Contexts are 0 to contexts - 1, entries ordered by them.
    """
    entries = np.bincount(context, minlength=contexts)
    last = np.cumsum(entries)
    cum = np.concatenate([[0], np.cumsum(counts)])
    before = cum[last - entries]
    seen = cum[last] - before
    bucket = np.frexp(seen.astype(np.float64))[1].astype(np.int64)  # 0: never seen
    ones = np.bincount(bucket[context], counts == 1, 64).astype(np.int64)
    total = np.bincount(bucket, seen, 64).astype(np.int64)
    share = np.minimum((total - ones + 1) * _ALL // (total + 2), _ALL // 32 * 31)
    share[0] = 0
    own = share[bucket]
    mass = np.zeros(len(counts) + contexts, np.int64)
    # below 2 ** 53, so exact
    mass[np.arange(len(counts)) + context + 1] = np.floor((own[context] * (cum[1:] - before[context])).astype(np.float64) / seen[context]).astype(np.int64)
    return mass, _ALL - own


def _by_step(ids: np.ndarray, runs: int, at: np.ndarray) -> np.ndarray:
    longest = len(at) - 1
    if len(ids) == runs * longest:
        return ids.reshape(runs, longest).T.ravel()
    grid = np.zeros(runs * longest, ids.dtype)
    grid[: len(ids)] = ids
    grid = grid.reshape(runs, longest)
    return np.concatenate([grid[: at[t + 1] - at[t], t] for t in range(longest)])


def _by_run(x: np.ndarray, runs: int, at: np.ndarray) -> np.ndarray:
    longest = len(at) - 1
    if len(x) == runs * longest:
        return x.reshape(longest, runs).T.ravel()
    grid = np.zeros((runs, longest), x.dtype)
    for t in range(longest):
        grid[: at[t + 1] - at[t], t] = x[at[t] : at[t + 1]]
    return grid.ravel()[: len(x)]


def _intervals(x: np.ndarray, at: np.ndarray, width: int):
    """For each step the starts and sizes of the intervals of its ids."""
    longest = len(at) - 1
    step = np.diff(at)
    # the positions one step back; a run's first id has none
    back = np.arange(len(x)) - np.repeat(np.concatenate([[0], step[:-1]]), step)
    before = np.full(len(x), width)
    before[at[1] :] = x[back[at[1] :]]
    known1, _, _, rank1 = _ranks(before * width + x)
    context1, id1 = known1 // width, known1 % width
    known2, _, _, rank2 = _ranks(rank1.take(back[at[1] :]).astype(np.int64) * width + x[at[1] :])
    parent2 = known2 // width
    # rows of an order's intervals, side by side, as each is looked up at random
    rows1, rows2 = np.empty((len(known1), 2), np.int32), np.empty((len(known2), 4), np.int32)
    for first, end in _spans(longest):
        seen = at[first]
        low = _order0(np.bincount(x[:seen], minlength=width))
        counts = np.bincount(rank1[:seen], minlength=len(known1))
        active1 = counts > 0
        upto1 = np.cumsum(active1)
        mass, rest = _masses(context1[active1], counts[active1], width + 1)
        row, w = upto1 + context1, rest[context1]
        rows1[:, 0] = mass[row - active1] + (w * low[id1] >> _TOTAL)
        rows1[:, 1] = mass[row] + (w * low[id1 + 1] >> _TOTAL)
        if first:
            counts = np.bincount(rank2[: seen - at[1]], minlength=len(known2))
            active = counts > 0
            # context 0 is that of pairs that have not been seen
            context = np.where(active1, upto1, 0)[parent2]
            mass, rest = _masses(context[active], counts[active], int(upto1[-1]) + 1)
            row = np.where(context > 0, np.cumsum(active) + context, 0)
            mass, rest = mass.astype(np.int32), (rest - 1).astype(np.int32)
            rows2[:, 0], rows2[:, 1], rows2[:, 2] = mass.take(row - active), mass.take(row), rest.take(context)
        for t in range(first, end):
            own = rows1.take(rank1[at[t] : at[t + 1]], 0).astype(np.int64)
            start, stop = own[:, 0], own[:, 1]
            if first:
                own = rows2.take(rank2[at[t] - at[1] : at[t + 1] - at[1]], 0).astype(np.int64)
                w = own[:, 2] + 1
                start, stop = own[:, 0] + (w * start >> _TOTAL), own[:, 1] + (w * stop >> _TOTAL)
            yield start, stop - start


class _Level:
    """The contexts of an order, as the decoder reads them: ids by slot."""

    def __init__(self, context: np.ndarray, ids: np.ndarray, counts: np.ndarray, contexts: int, below: tuple[np.ndarray, np.ndarray]):
        mass, self.rest = _masses(context, counts, contexts)
        self.row = np.arange(len(ids)) + context + 1
        #: Of each row start, end, id and what the context's ids up to it have; side by side, as rows are looked up at random.
        self.rows = np.zeros((len(mass), 4), np.int32)
        w, own, got = self.rest[context], mass[self.row], np.empty((len(ids), 4), np.int32)
        start = mass[self.row - 1] + (w * below[0] >> _TOTAL)
        got[:, 0], got[:, 1], got[:, 2], got[:, 3] = start, own + (w * below[1] >> _TOTAL), ids, own
        self.rows[self.row] = got
        # each context has cells, more than twice as many as rows, that say where to look
        entries = np.bincount(context, minlength=contexts)
        bits = np.frexp(entries.astype(np.float64) + 1)[1].astype(np.int64) + 1
        bits[entries == 0] = 0
        cells = np.cumsum(1 << bits)
        self.cell = cells - (1 << bits) << 5 | _TOTAL - bits
        held = np.bincount((self.cell[context] >> 5) + (start >> (self.cell[context] & 31)), minlength=int(cells[-1]))
        held[self.cell >> 5] += 1
        self.found = (np.cumsum(held) - 1).astype(np.int32)

    def find(self, context: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last row of each context that starts at the slot or before it, and what it has."""
        cell = self.cell.take(context)
        row = self.found.take((cell >> 5) + (slot >> (cell & 31)))
        got = self.rows.take(row, 0)
        late = np.flatnonzero(got[:, 0] > slot)
        while len(late):
            back = row[late] - 1
            row[late] = back
            again = self.rows.take(back, 0)
            got[late] = again
            late = late[again[:, 0] > slot[late]]
        return row, got


def _below(slot: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The last slots of the order below that ``rest`` of the mixture takes to ``slot``."""
    z = np.minimum((slot + 1).astype(np.float64) * _ALL / rest, _ALL - 1).astype(np.int64)
    z -= (rest * z >> _TOTAL) > slot
    z += ((rest * (z + 1) >> _TOTAL) <= slot) & (z < _ALL - 1)
    return z


class _Reader:
    """The model of a stretch of steps, from the ids before it."""

    def __init__(self, x: np.ndarray, at: np.ndarray, first: int, width: int):
        seen = at[first]
        self.width = width
        self.low = _order0(np.bincount(x[:seen], minlength=width))
        step = np.diff(at[: first + 1])
        back = np.arange(seen) - np.repeat(np.concatenate([[0], step[:-1]]), step) if first else np.zeros(0, np.int64)
        before = np.full(seen, width)
        begin = at[min(first, 1)]
        before[begin:] = x[back[begin:]]
        known, counts, _, rank = _ranks(before * width + x[:seen])
        ids = known % width
        self.one = _Level(known // width, ids, counts, width + 1, (self.low[ids], self.low[ids + 1]))
        known, counts, where, _ = _ranks(rank.take(back[begin:]).astype(np.int64) * width + x[begin:seen])
        #: For the rows of order 2, the entries of order 1 with the same last two ids.
        link = rank[where + begin]
        row = self.one.row[link]
        below = self.one.rows.take(row, 0).astype(np.int64)
        self.two = _Level(known // width + 1, known % width, counts, len(self.one.row) + 1, (below[:, 0], below[:, 1]))
        self.link = np.zeros(len(self.two.rows), np.int32)
        self.link[self.two.row] = link + 1
        #: The order-2 contexts of the runs, 0 where the pair is new.
        self.pair = rank[at[first - 1] : seen] + 1 if first else np.zeros(at[1], np.int64)

    def decode(self, slot: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids, starts and ends of the intervals that hold the slots."""
        one, two, pair = self.one, self.two, self.pair[: len(slot)]
        row, got = two.find(pair, slot)
        start, end, x = (got[:, k].astype(np.int64) for k in range(3))
        after = self.link.take(row)
        miss = np.flatnonzero(slot >= end)
        if len(miss):
            mass, rest = got[miss, 3].astype(np.int64), two.rest.take(pair[miss])
            z = _below(slot[miss] - mass, rest)
            b = before[miss]
            row, got = one.find(b, z)
            s, e, found = (got[:, k].astype(np.int64) for k in range(3))
            entry = row - b
            new = np.flatnonzero(z >= e)
            if len(new):
                own, left = got[new, 3].astype(np.int64), one.rest.take(b[new])
                y = np.searchsorted(self.low, _below(z[new] - own, left), "right") - 1
                found[new], entry[new] = y, 0
                s[new], e[new] = own + (left * self.low[y] >> _TOTAL), own + (left * self.low[y + 1] >> _TOTAL)
            x[miss], after[miss] = found, entry
            start[miss], end[miss] = mass + (rest * s >> _TOTAL), mass + (rest * e >> _TOTAL)
        self.pair = after
        return x, start, end


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    n = len(ids)
    if not 0 < n <= BLOCK_IDS:
        raise ValueError(f"a block has an id at least and {BLOCK_IDS} at most")
    runs, longest = _layout(n)
    at = _live(n, runs, longest)
    ids = np.asarray(ids).astype(np.int64)
    used = np.bincount(ids, minlength=vocabulary) > 0
    alphabet = np.flatnonzero(used)
    x = _by_step((np.cumsum(used) - 1).take(ids), runs, at)
    low, span = np.zeros(runs, np.int64), np.full(runs, 1 << 48)
    # the words of all runs, the first of each, then the second of each
    words, place = np.zeros((2 * longest + 2) * runs, np.uint32), np.arange(runs)
    for t, (start, size) in enumerate(_intervals(x, at, len(alphabet))):
        live = slice(0, at[t + 1] - at[t])
        r = span[live] >> _TOTAL
        lo = low[live]
        lo += r * start
        r *= size
        span[live] = r
        short = np.flatnonzero(r <= _MASK)
        while len(short):
            moved = lo[short]
            to = place[short]
            words[to] = moved >> _LEAST  # 16 bits, and the carry
            place[short] = to + runs
            lo[short] = (moved & _MASK) << 16
            r = span[short] << 16
            span[short] = r
            short = short[r <= _MASK]
    # a word above low ends the run: it is inside, as the range has 32 bits or more
    words[place] = (low + _MASK) >> _LEAST
    sizes = place // runs + 1
    words = words.reshape(-1, runs)[: int(sizes.max())]
    for k in range(len(words) - 1, 0, -1):
        words[k - 1] += words[k] >> 16
    coded = sizes.astype("<u2").tobytes() + words.astype("<u2").T[np.arange(len(words)) < sizes[:, None]].tobytes()
    names = zlib.compress(np.diff(alphabet, prepend=0).astype("<u4").tobytes(), 6)
    return _HEAD.pack(MAGIC, n, vocabulary, runs, len(names), len(coded), zlib.crc32(coded, zlib.crc32(names)), zlib.crc32(ids.astype("<u4").tobytes())) + names + coded


def decode_block(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The ids of the block at ``at``, and where it ends."""
    magic, n, _, runs, named, length, crc, ids_crc = _HEAD.unpack_from(data, at)
    begin = at + _HEAD.size
    names, coded = data[begin : begin + named], data[begin + named : begin + named + length]
    if magic != MAGIC or len(coded) != length or zlib.crc32(coded, zlib.crc32(names)) != crc:
        raise ValueError(f"the block at {at} is damaged")
    alphabet = np.cumsum(np.frombuffer(zlib.decompress(names), "<u4")).astype(np.uint32)
    size = np.frombuffer(coded, "<u2", runs).astype(np.int64)
    # as the encoder has them; after its words a run reads zeros
    words = np.zeros((runs, int(size.max()) + 3), np.uint16)
    words[np.arange(words.shape[1]) < size[:, None]] = np.frombuffer(coded, "<u2", offset=2 * runs)
    words, place = words.T.ravel(), np.arange(runs)

    def word(k: np.ndarray) -> np.ndarray:
        p = place[k]
        place[k] = p + runs
        return words.take(p).astype(np.int64)

    _, longest = _layout(n)
    steps = _live(n, runs, longest)
    every = np.arange(runs)
    code = word(every) << 32
    code |= word(every) << 16
    code |= word(every)
    span = np.full(runs, 1 << 48)
    x = np.zeros(n, np.int64)
    before = np.full(runs, len(alphabet))
    for first, end in _spans(longest):
        model = _Reader(x, steps, first, len(alphabet))
        for t in range(first, end):
            live = slice(0, steps[t + 1] - steps[t])
            r = span[live] >> _TOTAL
            c = code[live]
            # exact: below 2 ** 48 over below 2 ** 18
            slot = np.minimum((c / r).astype(np.int64), _ALL - 1)
            found, s, e = model.decode(slot, before[live])
            c -= r * s
            r *= e - s
            span[live] = r
            short = np.flatnonzero(r <= _MASK)
            while len(short):
                c[short] = c[short] << 16 | word(short)
                r = span[short] << 16
                span[short] = r
                short = short[r <= _MASK]
            x[steps[t] : steps[t + 1]] = found
            before = found
    ids = alphabet.take(_by_run(x, runs, steps))
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError(f"the ids of the block at {at} do not match their checksum")
    return ids, begin + named + length
