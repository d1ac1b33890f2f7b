import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from lodestone.llm import byte_bpe

from .helpers import ODD, docs_frame

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return byte_bpe.load(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def test_every_character_splits_as_the_library_splits_it(own, theirs):
    for low in range(0, 0x3000, 64):
        text = " ".join(f"a{chr(c)}1{chr(c)}{chr(c)} {chr(c)}." for c in range(low, low + 64))
        assert own.encode(text) == theirs.encode_ordinary(text)


def test_random_texts(own, theirs):
    r = random.Random(1)
    for _ in range(1500):
        text = "".join(r.choice(" ab'stREve\n\t\x1c\x85\xa0é12²日~.  ") for _ in range(r.randrange(80)))
        assert own.encode(text) == theirs.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()


def test_trees_taken_together_give_what_each_gives(own):
    r = random.Random(2)
    pieces = ["".join(r.choice("etaoinéß ") for _ in range(r.randrange(1, 140))).encode() for _ in range(600)]
    for piece, packed in zip(pieces, own.merge_many(pieces), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == own.merge(piece)


def test_query_over_odd_rows(spark, theirs):
    docs = docs_frame(spark, ODD)
    got = {r.doc_id: r for r in byte_bpe.bpe_encode(docs, PATH, P.PATTERN, with_ids=True).collect()}
    assert len(got) == len(ODD)
    for i, text in enumerate(ODD):
        ids = theirs.encode_ordinary(text or "")
        assert (got[i].n_tokens, got[i].ids) == (len(ids), ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_no_rows(spark):
    assert byte_bpe.bpe_encode(docs_frame(spark, []), PATH, P.PATTERN).count() == 0


def test_a_long_text_among_others(theirs, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LONG", 40)
    r = random.Random(4)
    texts = ["some words here", " ".join(f"w{r.randrange(10**6)}" for _ in range(400)), "and other words there", "x" * 39]
    for name in ("MEMORY", "MEMORY_BYTES"):
        with monkeypatch.context() as m:
            m.setattr(byte_bpe, name, 3)
            own = byte_bpe.ByteBpe(byte_bpe.read_ranks(PATH), P.PATTERN)
            for _ in range(2):
                got = [b"".join(parts) for parts in own.packed_texts(texts)]
                assert [np.frombuffer(x, "<u4").tolist() for x in got] == [theirs.encode_ordinary(t) for t in texts]
