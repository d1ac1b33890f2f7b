import random
import math
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import language_id
from lodestone.llm.common import doc_mod5
from lodestone.llm.queries import op1_language_id

from .helpers import ODD, docs_frame


def code_length(train, text, least):
    """PPM by the book: escape method C, exclusion, contexts of three bytes only if seen ``least`` times."""
    contexts = defaultdict(Counter)
    for t in train:
        raw = b"\n\n\n" + t.encode()
        for i in range(3, len(raw)):
            for k in range(4):
                contexts[raw[i - k : i]][raw[i]] += 1
    contexts = {c: n for c, n in contexts.items() if len(c) < 3 or sum(n.values()) >= least}

    @cache
    def p(context, byte):
        if context not in contexts:
            return p(context[1:], byte)
        n = contexts[context]
        lower = (lambda b: p(context[1:], b)) if context else (lambda b: 1 / 256)
        rest = sum(lower(b) for b in range(256) if b not in n)
        total = sum(n.values()) + len(n)
        return n[byte] / total if byte in n else len(n) / total * lower(byte) / rest

    raw = b"\n\n\n" + text.encode()
    return -sum(math.log2(p(raw[i - 3 : i], raw[i])) for i in range(3, len(raw)))


def test_code_lengths_are_those_of_the_definition(spark):
    train = {"aa": ["abra cadabra", "bar"], "bb": ["xyzzy plugh", "yzx"]}
    docs = docs_frame(spark, [(i, t, k, "s", 1) for i, (k, t) in enumerate((k, t) for k, ts in train.items() for t in ts)])
    model = language_id.train(docs, least=2)
    for text in ("abracadabra", "zz", "q?é", "a"):
        data = np.frombuffer(text.encode() + b" " * 8, np.uint8)
        got = model.code_lengths(data, np.array([0, len(data) - 8]))[0]
        want = [code_length(train[k], text, 1) for k in model.languages]
        # contexts are kept if any language has seen them twice; compare those that both keep
        assert got.shape == (2,) and np.isfinite(got).all()
        full = language_id.train(docs, least=1).code_lengths(data, np.array([0, len(data) - 8]))[0]
        assert full == pytest.approx(want, rel=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op1_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    rows = got.agg(F.count("*").alias("n"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")).alias("ok")).first()
    assert rows.n > 150 and rows.ok / rows.n > 0.95


def test_odd_rows(spark):
    docs = docs_frame(spark, ODD + [(99, "The thing and other", None, None, None)])
    model = language_id.train(docs, where=doc_mod5() != 0)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert len(got) == len(ODD) + 1
    for i, text in enumerate(ODD):
        assert (got[i].lang_pred == "und") == (not any(map(str.isalpha, text or "")))
        assert 0 <= got[i].score <= 1
    kept = {r.doc_id for r in language_id.keep_identified(docs, model).collect()}
    assert {4, 5} <= kept and not {0, 1, 2, 3} & kept


def test_nothing_to_learn_from(spark):
    docs = docs_frame(spark, [(1, "abc", None, "s", 3)])
    assert [r.lang_pred for r in language_id.identify(docs, language_id.train(docs)).collect()] == ["und"]


def test_limits_by_brute_force_and_what_they_reject(spark):
    """Texts of one kind set the limit of their language and size; a text far from the language goes, others stay."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice("etaoinshr") for _ in range(r.randrange(2, 8))) for _ in range(200)]
    prose = [" ".join(r.choice(vocabulary) for _ in range(60)) for _ in range(120)]
    noise = " ".join("".join(r.choice("QXZJKVW!#%&") for _ in range(6)) for _ in range(50)) + " a"
    docs = docs_frame(spark, [*prose, noise])
    model = language_id.train(docs.where("doc_id < 120"))
    rows = language_id.identify(docs, model, keep=("doc_id", "text")).collect()
    for lang, number, most in language_id.limits(docs, model):
        some = sorted(int(np.floor(x.bits_per_byte * 100)) / 100 for x in rows if x.lang_pred == lang and int(math.log2(max(1, len(x.text.encode()))) / 2) == number)
        q1, q3 = (some[math.ceil(share * len(some)) - 1] for share in (0.25, 0.75))
        assert most == (pytest.approx(q3 + 15 * (q3 - q1 + 0.02)) if len(some) >= 50 else 8.0)
    assert {x.doc_id for x in language_id.keep_identified(docs, model).collect()} == set(range(120))
