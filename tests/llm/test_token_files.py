import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from lodestone.llm import id_coder, token_files
from lodestone.llm.queries import op4_token_files

from .helpers import ODD, docs_frame

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, rows):
    out, start = {}, 0
    for i, text in sorted(rows):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def split_ids(encoder, texts):
    ids, cut = encoder.encode(pa.array(texts, pa.string()), 2)
    return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def test_query_against_the_library(spark, library):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in op4_token_files(spark, "/root/testdata/sf0.001").collect()}
    assert got == expected(library, rows)


def test_words_by_themselves_give_the_ids_of_the_text(library):
    texts = [*ODD, "It's, A.B. a.. 3.5, É. Don't. x Ünï, é, ÀB. <|endoftext|> x<|endoftext|>. a,b. İ. ́a Σας. ﬁ, ok.", "...,.,. 1, 2. _a. 'S. 's, we'll."]
    for text, ids in zip(texts, split_ids(token_files.load(PATH), texts), strict=True):
        assert ids.tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 2]


def test_odd_rows(spark, library, tmp_path):
    docs = docs_frame(spark, ODD)
    path = str(tmp_path / "ids")
    token_files.write_token_files(docs, path, PATH)
    assert {r.doc_id: tuple(r)[1:] for r in token_files.token_digests(spark, path).collect()} == expected(library, list(enumerate(ODD)))
    ids = {r.doc_id: r.ids for r in token_files.read_token_files(spark, path).collect()}
    assert ids[4] == [*library.encode(ODD[4], add_special_tokens=False).ids, 2]
    none = str(tmp_path / "none")
    token_files.write_token_files(docs_frame(spark, []), none, PATH)
    assert token_files.token_digests(spark, none).count() == 0
    ties = spark.createDataFrame([(None, "b"), (1, "x"), (1, "x"), (1, "y")], "doc_id long, text string")
    token_files.write_token_files(ties, str(tmp_path / "ties"), PATH)
    rows = token_files.token_digests(spark, str(tmp_path / "ties")).collect()
    assert sorted(r.start for r in rows) == [0, 2, 4, 6] and next(r.start for r in rows if r.doc_id is None) == 0


@pytest.mark.parametrize("n", [1, 2, 127, 129, 5000, 70_000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.zipf(1.3, n) % 49_408, np.full(n, 7), np.arange(n) % 3, rng.integers(0, 49_408, n)):
        block = id_coder.encode_block(ids, 49_408)
        back, end = id_coder.decode_block(b"xx" + block, 2)
        assert end == len(block) + 2 and (back == ids).all()


def test_prediction_saves_and_damage_is_seen():
    ids = np.tile(np.random.default_rng(1).integers(0, 49_408, 300), 100)
    block = id_coder.encode_block(ids, 49_408)
    assert len(block) < 0.6 * 2 * len(ids)
    for at in (40, len(block) - 1):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            id_coder.decode_block(bytes(bad))
    with pytest.raises(ValueError):
        id_coder.encode_block(np.zeros(id_coder.BLOCK_IDS + 1, np.int64), 10)


def test_carries_and_long_runs():
    rng = np.random.default_rng(5)
    for n in (300_000, id_coder.BLOCK_IDS, id_coder.BLOCK_IDS - 1, 8192 * 3 + 5):
        ids = np.where(rng.random(n) < 0.97, 7, rng.integers(0, 49_408, n))  # intervals next to all of the range
        assert (id_coder.decode_block(id_coder.encode_block(ids, 49_408))[0] == ids).all()


def test_intervals_are_those_of_the_mixture():
    """Against the mixture by direct counting: the intervals tile the range, and have the mixed probabilities."""
    rng = np.random.default_rng(7)
    runs, longest, width = 60, 40, 9
    x = (rng.zipf(1.5, runs * longest) % width).reshape(longest, runs)
    x[1:][rng.random((longest - 1, runs)) < 0.4] = 3
    at = np.arange(longest + 1) * runs
    first = 24
    lanes = [tuple(x[:first, r]) for r in range(runs)]
    c0, c1, c2 = Counter(), Counter(), Counter()
    for lane in lanes:
        padded = (width, *lane)
        for t, i in enumerate(lane):
            c0[i] += 1
            c1[padded[t], i] += 1
            if t:
                c2[padded[t - 1], padded[t], i] += 1

    def level(counts, context, below):
        """The mixture of a context's counts with the order below."""
        groups = {}
        for key, n in counts.items():
            groups.setdefault(key[:-1], Counter())[key[-1]] = n
        own = groups.get(context)
        if not own:
            return below
        bucket = lambda g: sum(g.values()).bit_length()
        alike = [g for g in groups.values() if bucket(g) == bucket(own)]
        total, ones = sum(sum(g.values()) for g in alike), sum(n == 1 for g in alike for n in g.values())
        share = min(31 / 32, (total - ones + 1) / (total + 2))
        return [share * own[i] / sum(own.values()) + (1 - share) * b for i, b in enumerate(below)]

    weights = [16 * c0[i] + 1 for i in range(width)]
    p0 = [w / sum(weights) for w in weights]
    for r in range(0, runs, 7):
        b2, b1 = lanes[r][-2:]
        want = level(c2, (b2, b1), level(c1, (b1,), p0))
        end = 0
        for i in range(width):
            y = x.copy()
            y[first, r] = i
            starts, sizes = list(id_coder._intervals(y.ravel(), at, width))[first]
            assert starts[r] == end and sizes[r] / 2**30 == pytest.approx(want[i], abs=1e-5)
            end = starts[r] + sizes[r]
            if i % 3 == 0:  # what the decoder finds at both ends of the interval
                model = id_coder._Reader(y.ravel(), at, first, width)
                for slot in (starts[r], end - 1):
                    slots = np.where(np.arange(runs) == r, slot, 0)
                    model.pair = id_coder._Reader(y.ravel(), at, first, width).pair
                    found, s, e = model.decode(slots, y[first - 1])
                    assert (found[r], s[r], e[r]) == (i, starts[r], end)
        assert end == 2**30


def test_fewer_bits_than_order_0(library):
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])
    ids, _ = token_files.load(PATH).encode(docs.column("text").combine_chunks(), 2)
    ids = ids[: id_coder.BLOCK_IDS]
    n = np.bincount(ids)
    n = n[n > 0]
    entropy = -(n * np.log2(n / len(ids))).sum() / len(ids)
    assert len(id_coder.encode_block(ids, 49_408)) * 8 / len(ids) < 0.85 * entropy


def test_unseen_words_by_pre_tokens(library, monkeypatch):
    texts = ["Häuser, naïve's don't; 12a.b÷c ×x Ÿes ÀÉ</w> x<|endoftext|>y \x01 a\x01b \0\0\0\0\0\0\0\0 soft\xadhyphen", "z" * 40 + ". " + "Q" * 17 + " é" * 30 + " ñandú's"]
    for limit in (2_000_000, 5):
        monkeypatch.setattr(token_files, "MEMORY", limit)
        encoder = token_files.WordEncoder(PATH)
        assert encoder.pattern is not None
        for some in (texts, texts[::-1], texts):
            for text, ids in zip(some, split_ids(encoder, some), strict=True):
                assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


def test_another_kind_of_file(library):
    path = P.path("byte_bpe_50k.json")
    encoder = token_files.WordEncoder(path)
    assert not encoder.by_words and encoder.pattern is None
    texts = ["It's  two\n\n spaces", "", "é"]
    for text, ids in zip(texts, split_ids(encoder, texts), strict=True):
        assert ids.tolist() == [*encoder.library.encode(text, add_special_tokens=False).ids, 2]
