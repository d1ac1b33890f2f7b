"""A compressed FM-index over word sequences: a wavelet matrix holds the Burrows-Wheeler transform.

All searches advance together, so that a step of backward search is a few vector operations a level.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Bit-packed levels; rank takes a popcount and a block count."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.blocks, self.zeros = [], [], []
        x = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (x >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view("<u8")
            count = np.zeros(len(packed), np.int32)
            np.cumsum(np.bitwise_count(packed[:-1]), out=count[1:], dtype=np.int32)
            self.words.append(packed)
            self.blocks.append(count)
            self.zeros.append(int(len(bit) - bit.sum()))
            x = np.concatenate([x[~bit], x[bit]])

    def locate(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the symbol's occurrences before ``at`` end in the lowest level."""
        for level, words, blocks, zeros in zip(range(self.levels - 1, -1, -1), self.words, self.blocks, self.zeros, strict=True):
            block = at >> 6
            ones = blocks[block] + np.bitwise_count(words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """By prefix doubling; no two suffixes are equal in their first ``depth`` symbols."""
    order = np.argsort(text, kind="stable")
    rank = np.empty(len(text), np.int64)
    new = np.concatenate([[0], np.cumsum(text[order][1:] != text[order][:-1])])
    rank[order] = new
    k = 1
    while k < depth and new[-1] < len(text) - 1:
        key = rank * (len(text) + 1)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank[order] = new
        k *= 2
    return order


class FmIndex:
    """Over segments of words, each with a weight: the times it occurs.

    The segments are stored backwards, so that backward search reads a pattern forwards.
    """

    def __init__(self, segments: list[list[bytes]], weights: np.ndarray):
        self.sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        ids: dict[bytes, int] = {}
        flat = np.fromiter((ids.setdefault(w, len(ids)) for s in segments for w in s), np.int64, int(self.sizes.sum()))
        n, self.sigma = len(segments), len(ids) + 1
        # symbol 0 ends a segment; while sorting, the ends differ
        self.first = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        where = np.repeat(self.first[:-1], self.sizes) + np.arange(len(flat)) - np.repeat(self.first[:-1] - np.arange(n), self.sizes)
        self.text = np.zeros(int(self.first[-1]), np.int64)  # forwards, for the patterns
        self.text[where] = flat + 1
        begin = np.repeat(self.first[:-1], self.sizes)
        backwards = np.zeros(len(self.text), np.int64)
        backwards[2 * begin + np.repeat(self.sizes, self.sizes) - 1 - where] = flat + 1
        ends = self.first[1:] - 1
        distinct = backwards + n
        distinct[ends] = np.arange(n)
        order = suffix_array(distinct, int(self.sizes.max(initial=0)) + 1)
        self.count = np.concatenate([[0], np.cumsum(np.bincount(backwards, minlength=self.sigma))])
        self.wavelet = WaveletMatrix(backwards[order - 1], self.sigma)
        every = np.arange(self.sigma)
        self.shift = self.count[:-1] - self.wavelet.locate(every, np.zeros(self.sigma, np.int64))
        owner = np.repeat(np.arange(n), self.sizes + 1)
        self.weight = np.concatenate([[0], np.cumsum(weights[owner[order]])])

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more word."""
        m = len(lo)
        both = self.wavelet.locate(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) + np.concatenate([self.shift[symbol]] * 2)
        return both[:m], both[m:]

    def repeats(self, window: int) -> list[list[tuple[int, int]]]:
        """For each segment the maximal (start, end) of at least ``window`` words that occur elsewhere too.

        Matching statistics from left to right: a search goes on while its interval holds two
        occurrences; where it stops, the next start is the first whose window is not decided.
        """
        n = len(self.sizes)
        out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        live = np.flatnonzero(self.sizes >= window)
        start = np.zeros(len(live), np.int64)
        size = np.zeros(len(live), np.int64)
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(self.text), np.int64)
        while len(live):
            at = start + size
            inside = at < self.sizes[live]
            symbol = self.text[self.first[live] + np.minimum(at, self.sizes[live] - 1)]
            lo2, hi2 = self.extend(lo, hi, symbol)
            on = inside & (self.weight[np.maximum(hi2, lo2)] - self.weight[lo2] >= 2)
            lo, hi, size = np.where(on, lo2, 0), np.where(on, hi2, len(self.text)), size + on
            off = np.flatnonzero(~on)
            if not len(off):
                continue
            for k in off[size[off] >= window].tolist():
                out[live[k]].append((int(start[k]), int(start[k] + size[k])))
            start[off] += np.maximum(1, size[off] - window + 1)
            size[off] = 0
            done = start + window > self.sizes[live]
            if done.any():
                live, start, size, lo, hi = (x[~done] for x in (live, start, size, lo, hi))
        return out
