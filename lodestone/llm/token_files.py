"""Token ids in binary files, coded by an adaptive context-mixing range coder.

Documents are dealt out by ranges of their id and sorted, so the files, in the order of their numbers,
hold all ids in ascending id order. A file is a row of segments; each holds whole documents: a
header, the table of their ids and lengths, and coded blocks (see ``id_coder``) that can be decoded by
themselves. Segments end with eight ASCII bytes, which is what lets Spark's text writer put the file
together (they are its line separator), so files go through Spark's commit protocol to any file system
that it knows.

Words are encoded by the tokenizers library; its pre-tokens never cross white space, so a worker keeps
the ids of recent words, in a bounded memory.

Null and empty texts have the end id alone. Null ids come first. Rows with equal ids are ordered by a
hash of their text; repeated rows are each written. Empty input gives files without segments.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, steps, text_bytes, word_spans, written
from .id_coder import BLOCK_IDS, decode_block, encode_block

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PAD = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Ones in the bytes after the first n of eight.
_AFTER = np.array([0xFFFFFFFFFFFFFFFF << 8 * n & 0xFFFFFFFFFFFFFFFF for n in range(9)], np.uint64)
_HEAD = struct.Struct("<4sIQII")  # magic, documents, ids, bytes of the table, its crc
MAGIC = b"LIDS"
END = "LIDSEND\n"
#: Words of up to 16 bytes that a worker's memory holds at most, and the ids it holds for them.
MEMORY, MEMORY_IDS = 2_000_000, 16_000_000
#: Unseen words that one call of the library encodes.
CALL = 4096
#: Stands between unseen words in one text; chosen as the first that is an id by itself.
_MARKS = "\x01\x02\x03\x04\x05\x06\x0e\x0f|¦§"
#: What a tokenizer that does not cross white space encodes as it does the words.
_PROBE = "Don't, a.b It's 3.5% (x) <|endoftext|> naïve É. über-all 'tis 2nd ΣΑΣ, ... \x01 foo_bar z"


class WordEncoder:
    """Ids of texts by a file of the tokenizers library.

    Where the file's pre-tokens do not cross white space, as ``_PROBE`` tells, words are encoded as they are, and
    the ids of those of up to 16 bytes are remembered, in tables of a fixed size that are emptied when full. Longer words, and
    texts for another kind of file, are encoded each time. Where the file's own steps are lower case, a composed form and a
    pattern of pre-tokens, an unseen word of Latin-1 letters and ASCII marks is cut into its pre-tokens by that pattern, and the
    library's model is asked for those that are new.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.vocabulary = self.library.get_vocab_size()
        self.kind = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        one_by_one = [i for w in _PROBE.split() for i in self._ids(w)]
        self.mark, self.mark_id = next(((m, i[0]) for m in _MARKS if len(i := self._ids(m)) == 1), ("", -1))
        joined = self._ids(f" {self.mark} ".join(_PROBE.split()))
        marked = [i for w in _PROBE.split() for i in [*self._ids(w), self.mark_id]][:-1]
        self.by_words = self.mark != "" and one_by_one == self._ids(_PROBE) and joined == marked
        self.pattern = self.by_words and self._steps(Tokenizer, path) or None
        bits = (2 * MEMORY - 1).bit_length()
        self.shift = np.uint64(64 - bits)
        self.slots = (1 << bits) - 1
        self._forget()

    def _steps(self, tokenizer: type, path: str) -> regex.Pattern | None:
        """The pattern of the file's pre-tokens, and the model alone, if the file's steps are known ones."""
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
        parts = lambda step, name: step[name] if step and step["type"] == "Sequence" else [step]
        normal = parts(steps["normalizer"], "normalizers")
        known = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
        split, *rest = parts(steps["pre_tokenizer"], "pretokenizers")
        whole = bool(split) and split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"] and "Regex" in split["pattern"]
        level = len(rest) == 1 and rest[0]["type"] == "ByteLevel" and not rest[0]["add_prefix_space"] and not rest[0]["use_regex"]
        suffix = steps["model"].get("end_of_word_suffix")
        if normal != known or not whole or not level or not suffix or regex.search(r"\(\?|\$|(?<!\[)\^|\\[bBAzZG]", split["pattern"]["Regex"]):
            return None
        from tokenizers import pre_tokenizers

        self.model = tokenizer.from_file(path)
        self.model.normalizer = None
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.last = np.zeros(self.vocabulary, bool)
        self.last[[i for t, i in self.model.get_vocab().items() if t.endswith(suffix)]] = True
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.level = {chr(k): level.pre_tokenize_str(chr(k))[0][0] for k in range(0x80, 0x100)}
        self.beyond = regex.compile(r"[\x80-\xff]")
        added = "|".join(regex.escape(t["content"]) for t in steps["added_tokens"])
        self.added = regex.compile(added.lower() or r"(?!)")
        pattern = split["pattern"]["Regex"]
        return None if regex.search(pattern, " ") else regex.compile(f"{pattern}| ")

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        self.known = 0
        self.words = np.zeros((self.slots + 1, 2), np.uint64)  # 16 bytes of each; words have no bytes of 0xFF, so 0 is free
        self.at = np.zeros(self.slots + 1, np.int32)
        self.many = np.zeros(self.slots + 1, np.uint8)
        self.held, self.end = np.zeros(1 << 16, self.kind), 0

    def _library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has; many words are one text with marks between them."""
        flat, sizes = [np.zeros(0, np.int64)], np.zeros(len(words), np.int64)
        for k in range(0, len(words), CALL):
            some = words[k : k + CALL]
            text = f" {self.mark} ".join(some)
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            marks = np.flatnonzero(ids == self.mark_id)
            if text.count(self.mark) == len(some) - 1 == len(marks):
                sizes[k : k + len(some)] = np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1
                flat.append(np.delete(ids, marks))
            else:  # a word has the mark itself
                parts = [self._ids(w) for w in some]
                sizes[k : k + len(some)] = [len(p) for p in parts]
                flat += [np.array(p, np.int64) for p in parts]
        return np.concatenate(flat), sizes

    @staticmethod
    def _texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
        return [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    @staticmethod
    def _hash(pair: np.ndarray) -> np.ndarray:
        x = pair[:, 0] * _K1 ^ pair[:, 1] * _K2
        x ^= x >> np.uint64(31)
        return x * _K1

    def _find(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each word, and whether it is free."""
        slot = (self._hash(pair) >> self.shift).astype(np.int64)
        got = self.words.take(slot, 0)
        free = got[:, 0] == 0
        other = np.flatnonzero(~free & ((got[:, 0] != pair[:, 0]) | (got[:, 1] != pair[:, 1])))
        while len(other):
            slot[other] = slot[other] + 1 & self.slots
            got = self.words.take(slot[other], 0)
            own = pair[other]
            free[other] = got[:, 0] == 0
            other = other[~free[other] & ((got[:, 0] != own[:, 0]) | (got[:, 1] != own[:, 1]))]
        return slot, free

    def _encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``_library`` of these words, by pre-tokens where that is the same."""
        latin = np.zeros(len(starts), bool)
        if self.pattern:
            after = np.concatenate([[False], data[:-1] == 0xC3])  # UTF-8 of À to ÿ
            own = (data > 0x20) & (data < 0x7F) | (data == 0xC3) | after & (data >= 0x80) & (data < 0xC0) & (data != 0x97) & (data != 0xB7)
            other = np.concatenate([[0], np.cumsum(~own)])
            latin = other[starts] == other[ends]
        lowered = self._joined(data, starts[latin], ends[latin]).decode().lower()
        if self.pattern and self.added.search(lowered):
            latin[:], lowered = False, ""
        rest, sizes_rest = self._library(self._texts(data, starts[~latin], ends[~latin]))
        if not latin.any():
            return rest, sizes_rest
        parts = self.pattern.findall(lowered)  # pre-tokens, and the spaces between words
        index = {p: k for k, p in enumerate(dict.fromkeys([" ", *parts]))}
        which = np.fromiter(map(index.__getitem__, parts), np.int64, len(parts))
        held, begin, many = self._pre_tokens(list(index)[1:])
        word = np.cumsum(which == 0)[which > 0]
        which = which[which > 0] - 1
        # the pre-tokens of each word, or the whole of another word, one after the other
        owner = np.concatenate([np.flatnonzero(latin)[word], np.flatnonzero(~latin)])
        at = np.concatenate([begin[which], len(held) + np.cumsum(sizes_rest) - sizes_rest])
        size = np.concatenate([many[which], sizes_rest])
        order = np.argsort(owner, kind="stable")
        at, size = at[order], size[order]
        upto = np.cumsum(size)
        flat = np.concatenate([held, rest])[np.repeat(at - upto + size, size) + np.arange(int(size.sum()))]
        return flat, np.bincount(owner[order], size, len(starts)).astype(np.int64)

    @staticmethod
    def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
        """The words with a space between them."""
        size = ends - starts + 1
        upto = np.cumsum(size)
        out = data[np.repeat(starts - upto + size, size) + np.arange(int(size.sum()))]
        out[upto - 1] = 32
        return out[:-1].tobytes()

    def _pre_tokens(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each pre-token begin and how many they are. A pre-token is a word, too."""
        data = np.frombuffer(" ".join(tokens).encode() + b" " * 8, np.uint8)
        starts, ends, _ = word_spans(data, np.array([0, len(data) - 8]))
        pair, short = self._pairs(data, starts, ends)
        slot, free = self._find(pair)
        new = np.flatnonzero(free | ~short)
        ids, sizes = np.zeros(0, np.int64), np.zeros(len(new), np.int64)
        if len(new):
            text = self._joined(data, starts[new], ends[new]).decode()
            # the model knows bytes by the characters of the file's own step for them
            text = text if text.isascii() else self.beyond.sub(lambda m: self.level[m[0]], text)
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            last = np.flatnonzero(self.last[ids]) + 1
            if len(last) != len(new):  # a text has the end of a word itself
                ids, sizes = self._library([tokens[k] for k in new.tolist()])
            else:
                sizes = np.diff(last, prepend=0)
        many, begin = self.many.take(slot).astype(np.int64), self.at.take(slot).astype(np.int64)
        held = np.concatenate([self.held[: self.end], ids])
        many[new], begin[new] = sizes, self.end + np.cumsum(sizes) - sizes
        keep = short[new]
        self._learn(pair[new[keep]], ids[np.repeat(keep, sizes)], sizes[keep])
        return held, begin, many

    @staticmethod
    def _pairs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first 16 bytes of each word as two numbers, and whether it has no more."""
        size = ends - starts
        pair = np.full((len(starts), 2), _PAD, np.uint64)
        eights = np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,))
        pair[:, 0] = eights[starts] | _AFTER[np.minimum(size, 8)]
        more = np.flatnonzero(size > 8)
        pair[more, 1] = eights[starts[more] + 8] | _AFTER[np.minimum(size[more] - 8, 8)]
        return pair, size <= 16

    def _learn(self, pair: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Remember distinct words and their ids, as many as there is room for."""
        room = max(0, MEMORY - self.known)
        pair, flat, sizes = pair[:room], flat[: int(sizes[:room].sum())], sizes[:room]
        while self.end + len(flat) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        self.held[self.end : self.end + len(flat)] = flat
        at = self.end + np.cumsum(sizes) - sizes
        self.end += len(flat)
        self.known += len(pair)
        left = np.arange(len(pair))
        while len(left):
            slot, _ = self._find(pair[left])
            self.at[slot] = left  # of those that want a slot the last one gets it
            won = self.at[slot] == left
            now, to = left[won], slot[won]
            self.words[to], self.many[to] = pair[now], sizes[now]
            left = left[~won]
        slot, _ = self._find(pair)
        self.at[slot] = at

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and n + 1 bounds."""
        if not self.by_words:
            parts = [np.array([*e.ids, end_id], self.kind) for e in self.library.encode_batch([x or "" for x in texts.to_pylist()], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, self.kind), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        data, offsets = text_bytes(texts)
        starts, ends, bounds = word_spans(data, offsets)
        data = np.concatenate([data, np.zeros(8, np.uint8)])
        pair, short = self._pairs(data, starts, ends)
        slot, free = self._find(pair)
        new = np.flatnonzero(free & short)
        if len(new):
            # of different words with one hash the first is learned, the others are encoded below
            _, first = np.unique(self._hash(pair[new]), return_index=True)
            if self.known and (self.known + len(first) > MEMORY or self.end > MEMORY_IDS):
                self._forget()
                return self.encode(texts, end_id)
            first = new[first]
            self._learn(pair[first], *self._encoded(data, starts[first], ends[first]))
            slot[new], free[new] = self._find(pair[new])
        rest = np.flatnonzero(free | ~short)
        flat, sizes = self._encoded(data, starts[rest], ends[rest]) if len(rest) else (np.zeros(0, np.int64), rest)
        many, begin, held = self.many.take(slot).astype(np.int64), self.at.take(slot).astype(np.int64), self.held[: self.end]
        if len(rest):
            many[rest], begin[rest] = sizes, len(held) + np.cumsum(sizes) - sizes
            held = np.concatenate([held, flat.astype(self.kind)])
        upto = np.concatenate([[0], np.cumsum(many)])
        cut = upto[bounds] + np.arange(len(bounds))  # an end id after each text
        at = np.repeat(begin - upto[:-1], many) + np.arange(upto[-1])
        out = np.full(cut[-1], end_id, self.kind)
        own = np.ones(len(out), bool)
        own[cut[1:] - 1] = False
        out[own] = held.take(at)
        return out, cut


_loaded: dict[str, WordEncoder] = {}


def load(path: str) -> WordEncoder:
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def pack_segment(doc_ids: list[int | None], ids: list[np.ndarray], vocabulary: int) -> bytes:
    """Whole documents: header, table, blocks."""
    known = np.array([x is not None for x in doc_ids], np.uint8)
    number = np.array([x or 0 for x in doc_ids], "<i8")
    sizes = np.array([len(x) for x in ids], "<i8")
    table = zlib.compress(known.tobytes() + number.tobytes() + sizes.tobytes(), 6)
    flat = np.concatenate(ids)
    blocks = [encode_block(flat[k : k + BLOCK_IDS], vocabulary) for k in range(0, len(flat), BLOCK_IDS)]
    return _HEAD.pack(MAGIC, len(ids), len(flat), len(table), zlib.crc32(table)) + table + b"".join(blocks)


def unpack_segments(data: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc ids, lengths, ids) of each segment of a file."""
    at = 0
    while at < len(data):
        magic, docs, n, size, crc = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        packed = data[at : at + size]
        if magic != MAGIC or zlib.crc32(packed) != crc:
            raise ValueError(f"the segment before {at} is damaged")
        table = zlib.decompress(packed)
        known = np.frombuffer(table, np.uint8, docs)
        number = np.frombuffer(table, "<i8", docs, docs)
        sizes = np.frombuffer(table, "<i8", docs, 9 * docs)
        at += size
        blocks = []
        while sum(map(len, blocks)) < n:
            ids, at = decode_block(data, at)
            blocks.append(ids)
        if data[at : at + len(END)] != END.encode():
            raise ValueError(f"no end of a segment at {at}")
        at += len(END)
        yield [int(x) if k else None for x, k in zip(number, known, strict=True)], sizes, np.concatenate(blocks)


def write_token_files(docs: DataFrame, out: str, tokenizer: str, *, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of docs into the new folder ``out``. ``tokenizer`` is a file that every machine has."""
    source = docs.select(F.col(doc_id).cast("long").alias("id__"), F.col(text).alias("text__")).withColumn("tie__", F.xxhash64("text__"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(tokenizer)
        held_ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0
        for batch in steps(batches, "text__"):
            every, cut = encoder.encode(batch.column("text__"), end_id)
            for k, number in enumerate(batch.column("id__").to_pylist()):
                ids = every[cut[k] : cut[k + 1]]
                if held and size + len(ids) > BLOCK_IDS:
                    yield _row(pack_segment(held_ids, held, encoder.vocabulary))
                    held_ids, held, size = [], [], 0
                held_ids.append(number)
                held.append(ids)
                size += len(ids)
        if held:
            yield _row(pack_segment(held_ids, held, encoder.vocabulary))

    ordered = source.repartitionByRange("id__", "tie__").sortWithinPartitions("id__", "tie__").select("id__", "text__")
    map_arrow(ordered, run, "segment binary").select(F.col("segment").cast("string").alias("value")).write.option("lineSep", END).text(out)


def _row(segment: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([segment], pa.binary())], names=["segment"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc_id, at, n_tokens, ids): ``at`` is the document's first id within the file."""
    files = _files(spark, path)
    return map_arrow(files, lambda batches: _documents(batches, lambda x: x.tolist()), "file long, doc_id long, at long, n_tokens long, ids array<int>")


def _files(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return found.select(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"part-(\d+)", 1).cast("long").alias("file"), "content")


def _documents(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column("file"), batch.column("content"), strict=True):
            at = 0
            for doc_ids, sizes, ids in unpack_segments(content.as_py()):
                cut = np.concatenate([[0], np.cumsum(sizes)])
                values = [of(ids[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                kind = pa.list_(pa.int32()) if values and isinstance(values[0], list) else pa.int64()
                last = "ids" if kind != pa.int64() else "ids_crc32"
                yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * len(sizes), pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(at + cut[:-1]), pa.array(sizes.astype(np.int64)), pa.array(values, kind)], names=["file", "doc_id", "at", "n_tokens", last])
                at += int(cut[-1])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files of a folder."""
    digest = lambda ids: zlib.crc32(ids.astype("<u4").tobytes())
    found = written(_files(spark, path).mapInArrow(lambda batches: _documents(batches, digest), "file long, doc_id long, at long, n_tokens long, ids_crc32 long"), "digests")
    # a row for each file: where it begins is the sum of those before it
    totals = sorted((r["file"], r["n"]) for r in found.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect())
    begin, rows = 0, []
    for file, n in totals:
        rows.append((file, begin))
        begin += n
    bases = spark.createDataFrame(rows, "file long, base long")
    return found.join(F.broadcast(bases), "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
