import binascii
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import lm_score as L
from lodestone.llm.common import doc_mod5
from lodestone.llm.queries import op8_lm_score

from .helpers import ODD, docs_frame, lower, words


def mod5(i):
    return binascii.crc32(str("" if i is None else i).encode()) % 5


BUCKETS, BINS = 24, 64


def em(items):
    """Mixture weights by bucket, one item after the other: {(bucket, estimates): n}; half a token of each model beside the counts."""
    models = len(next(iter(items))[1])
    w = {b: [1 / models] * models for b, _ in items}
    for _ in range(30):
        sums = {b: [0.5] * models for b in w}
        for (b, p), n in items.items():
            joint = [x * y for x, y in zip(w[b], p, strict=True)]
            for m in range(models):
                sums[b][m] += n * joint[m] / sum(joint)
        new = {b: [x / sum(s) for x in s] for b, s in sums.items()}
        moved = max(abs(x - y) for b in w for x, y in zip(w[b], new[b], strict=True))
        w = new
        if moved < 1e-5:
            break
    return w


def brute(rows, order):
    """By id: the contract's columns, and the model by direct counting, with weights by plain expectation-maximisation."""
    tokens = {i: [*words(lower(t)), None] for i, t in rows}
    parts = {i: "scored" if mod5(i) == 1 else "held" if mod5(i) == 0 else "kept" for i in tokens}

    def count(which):
        grams = [Counter() for _ in range(order + 1)]
        for i, ts in tokens.items():
            if parts[i] in which:
                padded = ["<s>"] * (order - 1) + ts
                for k in range(order - 1, len(padded)):
                    for m in range(1, order + 1):
                        grams[m][tuple(padded[k - m + 1 : k + 1])] += 1
        return grams, sum(p in which for p in parts.values())

    full, docs = count({"kept", "held"})
    kept, kept_docs = count({"kept"})
    n, v = sum(full[1].values()), len(full[1])

    def estimates(grams, docs, padded, k):
        out, context = [], 0
        for m in range(1, order + 1):
            c = grams[m][tuple(padded[k - m + 1 : k + 1])]
            before = tuple(padded[k - m + 1 : k])
            if m == 1:
                context = sum(grams[1].values())
            else:
                context = docs if set(before) == {"<s>"} else grams[m - 1][before]
            out.append(c / context if context else 0.0)
        bucket = min(BUCKETS - 1, int(math.log2(context)) + 1) if context else 0
        return [*out[::-1], 1 / (v + 1)], bucket

    def binned(p):
        return 2.0 ** (-min(BINS - 2, round(-2 * math.log2(p))) / 2) if p else 0.0

    held = Counter()
    for i, ts in tokens.items():
        if parts[i] == "held":
            padded = ["<s>"] * (order - 1) + ts
            for k in range(order - 1, len(padded)):
                p, bucket = estimates(kept, kept_docs, padded, k)
                held[bucket, (*map(binned, p[:-1]), p[-1])] += 1
    w = defaultdict(lambda: [1 / (order + 1)] * (order + 1), em(held) if held else {})
    out = {}
    for i, ts in tokens.items():
        padded = ["<s>"] * (order - 1) + ts
        score = 0.0
        for k in range(order - 1, len(padded)):
            p, bucket = estimates(full, docs, padded, k)
            score += math.log10(sum(a * b for a, b in zip(p, w[bucket], strict=True)))
        base = sum(math.log10((full[1][t,] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        out[i] = (mod5(i) == 1, len(ts), sum(full[1][t,] > 0 for t in ts), n, base, score)
    return out


def compare(got, want):
    assert len(got) == len(want)
    for r in got:
        a = (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
        assert a[:4] == want[r.doc_id][:4]
        assert a[4:] == pytest.approx(want[r.doc_id][4:], rel=1e-6)


@pytest.mark.parametrize("order", [2, 3])
def test_against_direct_counting(spark, order, monkeypatch):
    monkeypatch.setattr(L, "CHUNK_BYTES", 2000)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("n_chars < 3000").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compare(L.lm_scores(docs, doc_mod5() == 1, doc_mod5() == 0, order=order).collect(), brute(rows, order))


def test_model_beats_the_base_on_held_out_text(spark):
    r = op8_lm_score(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.b < r.s < 0


def test_weights_raise_the_likelihood():
    rng = np.random.default_rng(3)
    p, bucket, n = rng.random((200, 3)), rng.integers(0, 4, 200), rng.integers(1, 9, 200).astype(float)
    likelihood = lambda w: (n * np.log((w[bucket] * p).sum(1))).sum()
    even = np.full((L._BUCKETS, 3), 1 / 3)
    fitted = L.expectation_maximisation(bucket, p, n)
    assert likelihood(fitted) > likelihood(even) and fitted.sum(1) == pytest.approx(1)


def test_odd_rows(spark):
    rows = list(enumerate(ODD))
    compare(L.lm_scores(docs_frame(spark, ODD), doc_mod5() == 1, doc_mod5() == 0).collect(), brute(rows, 2))
    assert L.lm_scores(docs_frame(spark, []), doc_mod5() == 1, doc_mod5() == 0).count() == 0
    none = L.lm_scores(docs_frame(spark, ["a b"]), F.lit(True), F.lit(False)).first()
    assert (none.n_tokens, none.n_known, none.train_tokens, none.base_score) == (3, 0, 0, 0.0)


def test_the_query_has_trigrams(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    compare(op8_lm_score(spark, sf_dir).collect(), brute(rows, 3))
