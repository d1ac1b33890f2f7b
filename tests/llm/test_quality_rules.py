import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import quality_rules as Q
from lodestone.llm.queries import op10_quality_rules

from .helpers import ODD, docs_frame, words


def brute(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
    n, repeats = len(w), len(covered)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeats, n < 50 or 100 * repeats > 50 * n


def columns(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = op10_quality_rules(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(texts)
    for r in got:
        assert columns(r) == brute(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    assert sum(r.kept for r in got) > 0.9 * sum(not r.base_failed for r in got)


def kneser_ney(texts):
    """Interpolated modified Kneser-Ney over bytes, by its formulas."""
    order = Q.ORDER
    counts = [None, *(Counter() for _ in range(order))]
    for t in texts:
        raw = b"\n" * (order - 1) + t.encode()
        counts[order].update(raw[i - order + 1 : i + 1] for i in range(order - 1, len(raw)))
    for k in range(order - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])

    def discounts(k):
        n = [sum(c == x for c in counts[k].values()) for x in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [y] * 3 if not (n[1] and n[2] and n[3]) else [x - (x + 1) * y * n[x + 1] / n[x] for x in (1, 2, 3)]
        return [0, *np.clip(d, 0.05, [0.95, 1.9, 2.85])]

    cut = [None, *(discounts(k) for k in range(1, order + 1))]
    after = [None, *(defaultdict(dict) for _ in range(order))]
    for k in range(1, order + 1):
        for g, c in counts[k].items():
            after[k][g[:-1]][g[-1:]] = c

    def p(g):
        if not g:
            return 1 / 256
        k = len(g)
        seen = after[k].get(g[:-1])
        if not seen:
            return p(g[1:])
        total = sum(seen.values())
        kept = {b: x - cut[k][min(x, 3)] for b, x in seen.items() if k == 1 or x >= Q.LEAST}
        return (kept.get(g[-1:], 0) + (total - sum(kept.values())) * p(g[1:])) / total

    return p


def test_model_is_modified_kneser_ney(spark):
    texts = ["the cat sat on the mat and the dog sat on the log", "a cat and a dog", "mississippi missed the mission"]
    p = kneser_ney(texts)
    model = Q.train(docs_frame(spark, texts))["en"]
    for text in ("the cat missed a mat", "zebra", "é"):
        data = np.frombuffer(text.encode() + b" " * 8, np.uint8)
        got = model.log2_p(Q.packed_grams(data, np.array([0, len(data) - 8])))
        raw = b"\n\n\n" + text.encode()
        assert got == pytest.approx([math.log2(p(raw[i - 3 : i + 1])) for i in range(3, len(raw))], rel=1e-4)


def test_noise_is_rejected_and_prose_kept(spark):
    import random

    r = random.Random(8)
    vocabulary = ["".join(r.choice("etaoinshr") for _ in range(r.randrange(2, 8))) for _ in range(300)]
    prose = [" ".join(r.choice(vocabulary) for _ in range(150)) for _ in range(200)]
    noise = " ".join("".join(chr(r.randrange(33, 127)) for _ in range(6)) for _ in range(150))
    got = {x.doc_id: x for x in Q.quality_rules(docs_frame(spark, [*prose, noise])).collect()}
    assert not got[200].kept and not got[200].base_failed
    assert all(got[i].kept for i in range(200))


def test_odd_rows(spark):
    docs = docs_frame(spark, ODD + [(50, "plain words " * 9, None, None, None)])
    got = {r.doc_id: r for r in Q.quality_rules(docs).collect()}
    assert len(got) == len(ODD) + 1
    for i, text in enumerate(ODD):
        assert columns(got[i]) == brute(text)
    assert Q.quality_rules(docs_frame(spark, [])).count() == 0


def test_bands_by_brute_force(spark):
    r = np.random.default_rng(4)
    rows = [(lang, float(x), 100) for lang in ("a", "b") for x in r.normal(2, 0.3, 301)] + [("c", 1.5, 10), ("a", 9.0, 0)]
    got = Q.bands(spark.createDataFrame(rows, "lang__ string, bits double, bytes__ long"), 1.5)
    for lang in ("a", "b", "c"):
        x = sorted(math.floor(b * 1000) / 1000 for k, b, n in rows if k == lang and n)
        q1, q3 = (x[math.ceil(share * len(x)) - 1] for share in (0.25, 0.75))
        assert got[lang] == pytest.approx((q1 - 1.5 * (q3 - q1 + 0.02), q3 + 1.5 * (q3 - q1 + 0.02)))


def test_the_bands_reject_labelled_noise_and_keep_the_rest(spark):
    """Of labelled documents that pass the base rules: low quality against the others."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {q: (n, k) for q, n, k in op10_quality_rules(spark, sf).where("not base_failed").join(labels, "doc_id").selectExpr("quality", "int(kept) as k").groupBy("quality").agg({"*": "count", "k": "sum"}).select("quality", "count(1)", "sum(k)").collect()}
    assert kept[0][1] < 0.75 * kept[0][0] and kept[1][1] > 0.985 * kept[1][0]


def test_languages_in_groups_give_what_one_group_gives(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "text", "if(doc_id % 9 = 0, null, if(doc_id % 9 = 1, '', lang)) as lang")
    docs = docs.union(spark.createDataFrame([(900, None, "xx"), (901, "", "yy"), (902, None, None)], "doc_id long, text string, lang string"))
    rows = lambda: sorted((*(v for v in r if not isinstance(v, float)), round(r.perplexity, 9)) for r in Q.quality_rules(docs).collect())
    want = rows()
    assert len(Q.train(docs)) == 6  # four languages, '' and null
    monkeypatch.setattr(Q, "MOST_GRAMS", 30_000)
    assert len(Q._groups(Q.count_grams(docs))) > 1
    assert rows() == want
