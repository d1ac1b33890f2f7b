"""Queries over all of their input, against brute force."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone import queries as engine
from lodestone.functions import text as T
from lodestone.operators import retrieval


def is_follow_up(text):
    s = text.strip(" ").lower()
    return len(s) < 30 or bool(re.search(T.FOLLOW_START, s, re.A) or re.search(T.FOLLOW_REFERENCE, s, re.A))


def test_follow_up_takes_every_turn(spark):
    sf_dir = "/root/testdata/sf0.01"
    want = {(r.conv_id, r.turn): is_follow_up(r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    rows = engine.QUERIES["follow_up"](spark, sf_dir).collect()
    assert len(rows) == len(want) == 536
    assert {(r.conv_id, r.turn): r.follow_up for r in rows} == want


def test_follow_up_beside_letters_beyond_ascii(spark):
    texts = ["Une question sur la qualité du vin de la région", "soße und noch viele weitere Wörter in dem Satz", "Über den Fluss gehen wir nach Hause, ité missa est", "Wir gehen heute Abend über den langen Fluss"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.follow_up(F.col("text")).alias("f")).collect()
    assert {r.text: r.f for r in got} == {t: is_follow_up(t) for t in texts} == dict(zip(texts, [False, True, True, False], strict=True))


def tokens(spark, table, key, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key, T.content_tokens(F.col("text")).alias("t")).collect()
    return {r[key]: r.t for r in rows}


def brute_bm25(docs, questions, k, allowed):
    tf = {d: Counter(ts) for d, ts in docs.items()}
    df = Counter(w for c in tf.values() for w in c)
    mean = sum(map(len, docs.values())) / len(docs)
    out = {}
    for q, words in questions.items():
        score = {}
        for d in filter(allowed, docs):
            s = sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[d][w] * 2.2 / (tf[d][w] + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean)) for w in set(words) if w in tf[d])
            if s > 0:
                score[d] = s
        out |= {(q, d): score[d] for d in sorted(score, key=lambda d: (-score[d], d))[:k]}
    return out


def test_the_question_set_is_whole(spark):
    bench = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    asked = engine._questions(lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet"))
    assert {tuple(r) for r in asked.collect()} == {(r.item_id, r.text) for r in bench.collect() if r.item_id % 50 == 0}


@pytest.mark.parametrize(("name", "allowed"), [("bm25", lambda d: True), ("filtered_search", lambda d: d % 2 == 0)])
def test_whole_questions_against_brute_force(spark, sf_dir, name, allowed):
    items = tokens(spark, "benchmark", "item_id", sf_dir)
    want = brute_bm25(tokens(spark, "documents", "doc_id", sf_dir), {q: t for q, t in items.items() if q % 50 == 0}, 60, allowed)
    got = {(r.query_id, r.doc_id): r.score for r in engine.QUERIES[name](spark, sf_dir).collect()}
    assert len(want) > 10
    assert got == pytest.approx(want, abs=2e-6)


def test_vector_search_takes_blocks_of_queries(spark, sf_dir, monkeypatch):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    want = [sorted(map(tuple, retrieval.vector_search(vectors, asked, 4, quantised=z, exclude_self=True).collect())) for z in (False, True)]
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 3)
    got = [sorted(map(tuple, retrieval.vector_search(vectors, asked, 4, quantised=z, exclude_self=True).collect())) for z in (False, True)]
    assert [[(r[:2], r[3]) for r in x] for x in got] == [[(r[:2], r[3]) for r in x] for x in want] and len(got[0]) == 40
    assert [r[2] for x in got for r in x] == pytest.approx([r[2] for x in want for r in x])
    assert retrieval.vector_search(vectors, asked.limit(0), 4).count() == 0


def test_vectors_are_multiplied_in_bounded_steps(spark, sf_dir, monkeypatch):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    want = sorted((r.query_id, r.vec_id, r.rank) for r in retrieval.vector_search(vectors, asked, 4).collect())
    for scores in (1, 70):
        monkeypatch.setattr(retrieval, "_SCORES", scores)
        assert sorted((r.query_id, r.vec_id, r.rank) for r in retrieval.vector_search(vectors, asked, 4).collect()) == want
