"""The stored index and the hybrid search over it, against a search written out in plain Python."""

import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import queries as engine
from lodestone.functions import text as T
from lodestone.operators import retrieval, search

from .test_whole import brute_bm25

SF = "/root/testdata/sf0.001"


def fnv(s):
    h = 2166136261
    for c in s:
        h = (h ^ ord(c)) * 16777619 % 2**32
    return h


def vector(tokens):
    weights = {}
    for w, n in Counter(tokens).items():
        tf = 1 + math.log(n)
        weights[w] = tf
        if len(w) > 5:
            for i in range(len(w) - 3):
                weights["c:" + w[i : i + 4], i, w] = 0.3 * tf / math.sqrt(len(w) - 3)
    for p, n in Counter(f"b:{a}_{b}" for a, b in zip(tokens, tokens[1:], strict=False)).items():
        weights[p] = 0.55 * (1 + math.log(n))
    v = np.zeros(1536)
    for name, w in weights.items():
        name = name if isinstance(name, str) else name[0]
        v[fnv(name) % 1536] += w if fnv("sgn:" + name) % 2 else -w
    return v / (np.linalg.norm(v) or 1)


def steps(v):
    s = np.abs(v).max() / 127
    return (np.floor(v / s + 0.5), s) if s else (v, 0.0)


def best(scores, k):
    return sorted(scores, key=lambda d: (-round(scores[d], 12), d))[:k]


@pytest.fixture(scope="module")
def tables(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    asked = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.item_id % 50 == 0}
    return docs, asked


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    search.write_index(spark.read.parquet(f"{SF}/documents.parquet"), path)
    return search.Index(spark, path)


def test_vectors(tables):
    docs, _ = tables
    some = [T.content_words(docs[d]) for d in list(docs)[:20]] + [[], ["a-b"]]
    assert np.allclose(retrieval.dense(some), [vector(t) for t in some])


def test_hybrid_against_plain_python(spark, tables):
    docs, asked = tables
    tokens = {d: T.content_words(t) for d, t in docs.items()}
    vectors = {d: vector(t) for d, t in tokens.items()}
    got = {(r.query_id, r.doc_id): (r.rank, r.score) for r in engine.QUERIES["hybrid_search"](spark, SF).collect()}
    want = {}
    for q, text in asked.items():
        v = vector(T.content_words(text))
        words = [d for _, d in brute_bm25(tokens, {q: T.content_words(text)}, 60, lambda d: True)]
        (qq, qs), packed = steps(v), {d: steps(x) for d, x in vectors.items()}
        dots = {d: round(float(z @ qq * s * qs), 9) for d, (z, s) in packed.items() if s}
        near = best(dots, 60)
        fused = Counter()
        for weight, ids in ((1.0, words), (0.6, near)):
            for rank, d in enumerate(ids, 1):
                fused[d] += weight / (60 + rank)
        short = best(fused, 40)
        exact = {d: round(float(vectors[d] @ v), 9) for d in short}
        passage = {d: max((round(float(vector(T.content_words(docs[d][a:b])) @ v), 9) for a, b in T.chunk_spans(docs[d])), default=0.0) for d in short}
        final = Counter()
        for weight, ids in ((1.0, short), (1.0, best({d: s for d, s in exact.items() if s > 0}, 40)), (1.3, best({d: s for d, s in passage.items() if s > 0}, 40))):
            for rank, d in enumerate(ids, 1):
                final[d] += weight / (60 + rank)
        for rank, d in enumerate(best(final, 12), 1):
            want[q, d] = rank, pytest.approx(final[d], abs=1e-8)
    assert len(want) == 12 * len(asked) and got == want


def test_one_plan_without_a_job_before_its_action(spark, index, tables):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    asked = spark.createDataFrame([(1, "some words of a question")], "query_id long, query string")
    df = search.hybrid(index, docs, asked, diversify=False)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 1 or plan.count("ReadSchema: struct<doc_id:bigint,text:string>") == 1
    assert "In(term" in plan or "GreaterThanOrEqual(term" in plan or "PushedFilters: [In" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_rows_that_are_all_worse_than_those_held():
    held = retrieval.Best(2, 2)
    held.add(np.array([5, 6, 7]), np.array([[0.9, 0.8], [0.8, 0.9], [0.1, 0.2]]))
    held.add(np.array([8, 9]), np.array([[0.3, 0.3], [-np.inf, 0.1]]))
    held.add(np.array([], np.int64), np.zeros((0, 2)))
    assert held.rows(np.array([1, 2]), "doc_id").to_pydict() == {"query_id": [1, 1, 2, 2], "doc_id": [5, 6, 6, 5], "score": [0.9, 0.8, 0.9, 0.8]}


def test_copies_rank_by_id_whatever_the_order_of_the_sums(spark, tmp_path):
    words = ["alpha beta gamma delta epsilon zeta eta theta kappa sigma"[i % 7 :] for i in range(12)]
    docs = [(i, " ".join([words[i % 12]] * (1 + i % 3)) + " tail" * (i % 4)) for i in range(240)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame([(1, words[0])], "query_id long, query string")
    for files in (3, 7):
        search.write_index(table.repartition(5), str(tmp_path / str(files)), files=files)
        index = search.Index(spark, str(tmp_path / str(files)))
        rows = [(r.rank, r.doc_id, r.score) for k in (20, 65) for r in search.bm25(index, asked, k).orderBy("rank").collect()]
        text = dict(docs)
        for (a, i, s), (b, j, t) in zip(rows, rows[1:], strict=False):
            assert b < a or s > t + 1e-12 or (abs(s - t) < 1e-12 and i < j)
        for k in (20, 65):
            kept = [i for _, i, _ in (rows[:20] if k == 20 else rows[20:])]
            assert all({j for j in text if text[j] == text[i] and j < i} <= set(kept) for i in kept)


def test_options(spark, index):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    asked = spark.createDataFrame([(1, texts[3]), (2, "zzzz qqqq"), (3, None)], "query_id long, query string")
    found = search.hybrid(index, docs, asked, limit=5).collect()
    # words that no document has may share buckets of the hash with some, as in any hashed space; no words find nothing
    assert {r.query_id for r in found} == {1, 2} and sum(r.query_id == 1 for r in found) == 5
    top = next(r for r in found if (r.query_id, r.rank) == (1, 1))
    assert top.passage and texts[top.doc_id][top.start :].startswith(top.passage[:40].rstrip("…"))
    asked = asked.limit(1)
    few = search.hybrid(index, docs, asked, limit=5, allowed=docs.where("doc_id % 7 = 0")).collect()
    assert few and all(r.doc_id % 7 == 0 for r in few)
    words = search.hybrid(index, docs, asked, limit=5, space="other:3").collect()
    assert len(words) == 5 and all(r.passage is None and r.semantic is None for r in words)
    assert [r.doc_id for r in sorted(words, key=lambda r: r.rank)] == [r.doc_id for r in sorted(search.bm25(index, asked, 5).collect(), key=lambda r: r.rank)]
    related = search.semantic_search(index, asked, 3).where("query_id = 1").orderBy("rank").collect()
    assert related[0].doc_id in {d for d, t in texts.items() if t == texts[3]}


def test_scoped_questions_keep_the_statistics_of_all(spark, index):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    asked = spark.createDataFrame([(1, docs.where("doc_id = 6").first().text)], "query_id long, query string")
    every = {r.doc_id: r.score for r in search.bm25(index, asked, 10_000).collect()}
    some = {r.doc_id: r.score for r in search.bm25(index, asked, 10_000, docs.where("doc_id < 50").select("doc_id")).collect()}
    assert some == {d: s for d, s in every.items() if d < 50}


def test_many_terms_are_searched_by_documents(spark, index, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    asked = docs.where("doc_id % 30 = 0").select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 120).alias("query"))
    asked = asked.union(spark.createDataFrame([(1, None), (2, "zzzz qqqq"), (3, "the"), (5, "zzzz " + docs.where("doc_id = 6").first().text)], "query_id long, query string"))

    def rows(k, allowed):
        return sorted((r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in search.bm25(index, asked, k, allowed).collect())

    ways = [(k, allowed) for k in (3, 10_000) for allowed in (None, docs.where("doc_id % 2 = 0").select("doc_id"))]
    monkeypatch.setattr(search, "PRUNED_TERMS", 10_000)
    want = [rows(*way) for way in ways]
    near = sorted(map(tuple, search.semantic_search(index, asked, 5).collect()))
    assert all(len({r[0] for r in x}) >= 7 for x in want)
    monkeypatch.setattr(search, "PRUNED_TERMS", 0)
    for together, weights in ((500, 2**23), (2, 700)):  # the second holds a few documents at once
        monkeypatch.setattr(search, "_TOGETHER", together)
        monkeypatch.setattr(search, "_WEIGHTS", weights)
        assert [rows(*way) for way in ways] == want
        assert sorted(map(tuple, search.semantic_search(index, asked, 5).collect())) == near
    # what is shuffled are the best of each task, not the pairs of a question and a document that share a term
    plan = search.bm25(index, asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashAggregate" not in plan


def test_ambient_reads_a_page_once_and_asks_a_title_once(spark, monkeypatch):
    held, hybrid = [], search.hybrid

    def counted(index, docs, titles, **options):
        held.append(titles.count())
        return hybrid(index, docs, titles, **options)

    monkeypatch.setattr(search, "hybrid", counted)
    found = engine.QUERIES["ambient_related"](spark, SF)
    assert "regexp_replace" not in found._jdf.queryExecution().executedPlan().toString()
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40").withColumn("url", F.concat(F.lit("u"), "doc_id")).localCheckpoint()
    title = docs.where("doc_id = 6").first().text[:80]
    titles = spark.createDataFrame([(1, title, "u6"), (2, title, "elsewhere"), (3, None, "u6"), (4, title, None), (5, "", "u1")], "query_id long, query string, url string")
    related = search.ambient(engine._index(docs.select("doc_id", "text")), docs, titles).collect()
    assert held[-1] == 3
    by = {q: [(r.rank, r.doc_id) for r in sorted(related, key=lambda r: r.rank) if r.query_id == q] for q in range(1, 6)}
    assert by[2] and by[2] == by[4] and not by[3] and not by[5]
    assert 6 in {d for _, d in by[2]} and 6 not in {d for _, d in by[1]}


def test_an_index_that_is_searched_once_has_no_postings(spark, index):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    once = engine._index(docs, False)
    assert not os.path.exists(f"{once.path.removeprefix('file:')}/postings") and (once.n, once.tokens) == (index.n, index.tokens)
    asked = spark.createDataFrame([(1, docs.where("doc_id = 6").first().text[:300]), (2, "zzzz qqqq"), (3, None)], "query_id long, query string")
    for allowed in (None, docs.where("doc_id % 2 = 0").select("doc_id")):
        got, want = ([(r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in search.bm25(i, asked, 20, allowed).orderBy("query_id", "rank").collect()] for i in (once, index))
        assert got == want and len(got) > 10


def test_no_rows(spark, tmp_path, index):
    none = spark.createDataFrame([], "doc_id long, text string")
    search.write_index(none, str(tmp_path / "none"))
    empty = search.Index(spark, str(tmp_path / "none"))
    asked = spark.createDataFrame([(1, "a question of words")], "query_id long, query string")
    assert search.hybrid(empty, none, asked).count() == 0 and search.bm25(empty, asked).count() == 0
    assert search.hybrid(index, spark.read.parquet(f"{SF}/documents.parquet"), asked.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "word word other")], "doc_id long, text string")
    search.write_index(odd, str(tmp_path / "odd"), files=2)
    assert [r.doc_id for r in search.bm25(search.Index(spark, str(tmp_path / "odd")), asked.select("query_id", F.lit("word").alias("query"))).collect()] == [3]


def test_tokens_in_both_languages(spark):
    odd = ["It's Windows11の設定 o’k café a-b x", "字'ab 字' 字-x a字b 'tis --the the's the- a I x1 を・ん ー", "andy and a-n a an- -an ΣΑΣ", "the設 設the the'設 a設 設a", "", None, "é é 'a ·b b· b’ 12 1 1'"]
    rows = spark.createDataFrame([(t,) for t in odd], "text string").union(spark.read.parquet(f"{SF}/documents.parquet").select("text"))
    for r in rows.select("text", T.content_tokens(F.col("text")).alias("t")).collect():
        assert r.t == T.content_words(r.text)
