import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import toxicity as T
from lodestone.llm.queries import op5_toxicity

from .helpers import ODD, docs_frame


def test_labelled_documents_are_found(spark):
    got = op5_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").withColumnRenamed("toxic", "truth"), "doc_id")
    n = got.agg(*[F.sum((F.col("toxic") == bool(a)).cast("int") * (F.col("truth") == b).cast("int")).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)]).first()
    # one in sixteen of the English texts with the label has no word that others with it have
    assert n.n11 / (n.n11 + n.n01) > 0.93 and n.n10 < 0.005 * (n.n10 + n.n00)


def test_logistic_regression_is_at_its_optimum():
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.integers(0, 2, (300, 5)), np.ones(300)]).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [2, -1, 0, 1, 0, -0.5])))).astype(float)
    w = T.logistic(x, y)
    p = 1 / (1 + np.exp(-(x @ w)))
    assert (x.T @ (y - p))[:-1] == pytest.approx(w[:-1], abs=1e-3)
    assert (y - p).sum() == pytest.approx(0, abs=1e-3)


def test_later_models_use_earlier_categories(spark):
    rng = np.random.default_rng(2)
    n = 600
    x = rng.integers(0, 2, (n, 3)).astype(float)
    first = x[:, 0]
    second = np.where(rng.random(n) < 0.9, first, 1 - first)
    place = np.full(T.BUCKETS, -1, np.int32)
    place[:3] = range(3)
    chain = T._chain(["a", "b"], place, [np.array([0]), np.array([1, 2])], x, {"a": first, "b": second}, np.arange(n) % T.FOLDS)
    assert chain.weights[1][2] > 0.1
    p = chain.of_pairs(2, np.array([0]), np.array([0]))
    assert p[0, 1] > 0.8 > 0.2 > p[1, 1]


def test_odd_rows(spark):
    docs = docs_frame(spark, [*ODD, *["you idiot person number " + str(i) for i in range(20)], *["kind person number " + str(i) for i in range(20)]])
    labels = spark.createDataFrame([(i, int(i < len(ODD) + 20)) for i in range(len(ODD), len(ODD) + 40)] + [(None, 1), (9999, 1), (0, None), (len(ODD), 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in T.classify(docs, T.fit(docs, labels, ["toxic"])).collect()}
    assert len(got) == len(ODD) + 40
    assert all(got[i].toxic == (i < len(ODD) + 20) for i in range(len(ODD), len(ODD) + 40))
    one = T.fit(docs, labels.where("toxic = 1"), ["toxic"])
    assert not any(r.toxic for r in T.classify(docs, one).collect())
    none = T.fit(docs, labels.limit(0), ["toxic"])
    assert T.classify(docs, none).count() == len(got)
    assert T.classify(docs.limit(0), one).count() == 0


def plain_features(text):
    """Words and word beginnings of a text: runs of ASCII letters, in lower case, and of all bytes beyond ASCII."""
    out = set()
    for word in re.findall(rb"[a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())):
        out.add(word)
        out |= {(word[:k], k) for k in range(3, 8) if len(word) > k}
    return out


def test_the_whole_fit_by_brute_force(spark):
    """Features, chi-square choice, folds, chain and threshold, from plain sets and a dense matrix."""
    r = random.Random(6)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(60)] + ["Été", "naïveté", "ÜBERALL"]
    rows, labels = [], []
    for i in range(150):
        bad, rude = r.random() < 0.4, r.random() < 0.5
        words = [r.choice(vocabulary) for _ in range(25)] + ["Trashy"] * (bad and r.random() < 0.8) + ["scummy,"] * ((bad or rude) and r.random() < 0.7)
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad) if i % 11 else None, int(bad and rude)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, low int, toxic int")
    chain = T.fit(docs, table, ["low", "toxic"])
    has = [plain_features(t) for _, t in rows]
    every = sorted(set().union(*has), key=repr)
    x = np.array([[f in h for f in every] for h in has], float)
    folds = {q.doc_id: q.fold for q in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(T.FOLDS)).alias("fold")).collect()}
    fold = np.array([folds[i] for i, _ in rows])
    odds, probabilities = [], []
    for c in (1, 2):
        y = np.array([np.nan if q[c] is None else q[c] for q in labels], float)
        known = ~np.isnan(y)
        # the chi-square of presence against the label, for one degree of freedom
        chosen = []
        for f in range(len(every)):
            a, n, pos, total = x[known][y[known] == 1, f].sum(), x[known, f].sum(), (y == 1).sum(), known.sum()
            table2 = np.array([[a, n - a], [pos - a, total - n - pos + a]])
            want = table2.sum(1, keepdims=True) * table2.sum(0) / total
            chi = ((table2 - want) ** 2 / np.maximum(want, 1e-9)).sum() if 0 < n < total else 0
            if n >= 3 and chi > 4:
                chosen.append(f)
        full = np.column_stack([x[:, chosen], *odds, np.ones(len(x))])
        out = np.zeros(len(x))
        for k in range(T.FOLDS):
            out[fold == k] = T._p(full[fold == k], T.logistic(full[known & (fold != k)], y[known & (fold != k)]))
        probabilities.append(T._p(np.column_stack([x[:, chosen], *[np.log(p / (1 - p)) for p in probabilities], np.ones(len(x))]), T.logistic(full[known], y[known])))
        odds.append(T._odds(out))
    cuts = sorted(set(out[known]), reverse=True)
    f1 = [2 * ((out[known] >= c) & (y[known] == 1)).sum() / ((out[known] >= c).sum() + (y[known] == 1).sum()) for c in cuts]
    best = int(np.argmax(f1))
    assert chain.threshold == pytest.approx((cuts[best] + cuts[min(best + 1, len(cuts) - 1)]) / 2, abs=1e-3)
    got = {q.doc_id: (q.p_low, q.p_toxic) for q in T.classify(docs, chain).collect()}
    assert np.array([got[i] for i, _ in rows]) == pytest.approx(np.column_stack(probabilities), abs=2e-3)


def test_rows_of_one_id_do_not_enlarge_the_sample(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i % 7}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, toxic int")
    want = spark.createDataFrame([(i, "text 0") for i in range(5)], "doc_id long, text string")
    a, b = T.fit(docs, labels, ["toxic"]), T.fit(want, labels, ["toxic"])
    assert a.threshold == b.threshold and all((x == y).all() for x, y in zip(a.weights, b.weights, strict=True))
