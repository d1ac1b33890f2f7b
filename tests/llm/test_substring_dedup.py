import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import substring_dedup as S
from lodestone.llm.common import packed_docs
from lodestone.llm.fm_index import FmIndex, WaveletMatrix
from lodestone.llm.queries import op3_substring_dedup

from .helpers import ODD, docs_frame, words


def brute(texts, window):
    """(n_words, n_removed, kept_sha256) of each text."""
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def check(got, texts, window):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got}
    assert [got[i] for i in range(len(texts))] == brute(texts, window)


def test_query_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    check(op3_substring_dedup(spark, "/root/testdata/sf0.01").collect(), [r.text for r in rows], 35)


def test_random_passages_and_periods(spark, monkeypatch):
    r = random.Random(5)
    passages = [" ".join(r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(r.randrange(20, 60))) for _ in range(6)]
    texts = []
    for _ in range(80):
        parts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(r.randrange(30))) for _ in range(3)]
        texts.append(f"{parts[0]} {r.choice(passages)}\n{parts[1]}  {r.choice(passages)} {parts[2]}")
    texts += ["a b c " * 40, "z " * 36, "y " * 35, None, ""]
    for hot, shard in ((500, 400_000), (3, 400)):
        monkeypatch.setattr(S, "HOT", hot)
        monkeypatch.setattr(S, "SHARD_WORDS", shard)
        check(S.substring_dedup(docs_frame(spark, texts), window=20).collect(), texts, 20)


def test_odd_rows(spark):
    docs = docs_frame(spark, ODD)
    check(S.substring_dedup(docs).collect(), ODD, 35)
    kept = {r.doc_id: r.text for r in S.remove_repeats(docs).collect()}
    assert kept[11] == "" and kept[2] == "  \n\t " and kept[10] == ODD[10] and kept[0] is None
    assert S.substring_dedup(docs_frame(spark, [])).count() == 0
    twice = spark.createDataFrame([(1, "q " * 5 + " ".join(map(str, range(40))))] * 2, "doc_id long, text string")
    assert [r.n_removed for r in S.substring_dedup(twice).collect()] == [45, 45]


def test_columns_of_any_name_and_type(spark):
    passage = " ".join(map(str, range(60)))
    rows = [(i, f"w{i} {passage} v{i}", 7, {"a": i}, "z", None, 5) for i in range(3)] + [(None, "alone", 1, {}, "y", [1], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key__ int, all_runs map<string,int>, z__ string, `check__` array<int>, `text__` int")
    docs = docs.withColumns({c: F.lit(1) for c in ("key", "row__", "id__", "a b", "check", "n_chars")})
    out = S.remove_repeats(docs, window=50)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].text for i in range(3)] == [f"w{i} v{i}" for i in range(3)] and got[None].text == "alone"
    assert got[2].all_runs == {"a": 2} and got[2].key__ == 7 and got[2].n_chars == 5


def test_a_window_that_is_common_everywhere(spark, monkeypatch):
    r = random.Random(9)
    common = " ".join(f"c{k}" for k in range(25))
    texts = [f"{common} " + " ".join(f"w{r.randrange(10**6)}" for _ in range(30)) for _ in range(300)]
    monkeypatch.setattr(S, "HOT", 5)
    monkeypatch.setattr(S, "SINGLES", 2)
    check(S.substring_dedup(docs_frame(spark, texts), window=20).collect(), texts, 20)


def test_equal_hashes_of_different_words(spark, monkeypatch):
    """With all segments' hashes equal, words and the second hash tell them apart."""
    r = random.Random(3)
    passages = [" ".join(f"p{k}x{j}" for j in range(25)) for k in range(5)]
    texts = [f"{passages[k % 5]} " + " ".join(f"w{r.randrange(10**6)}" for _ in range(25)) for k in range(20)]
    docs = docs_frame(spark, texts)
    packed = packed_docs(docs, "text", ("doc_id",))
    anchors = S._anchors(docs, "text", ("doc_id",), 20).groupBy("key", "check").agg(F.collect_set("anchor").alias("anchors"), F.array().cast("array<long>").alias("hot"))
    met = packed.join(anchors, S._own(packed)).drop("key", "check")
    segments = S._segments(met, 20).withColumn("segment", F.lit(1).cast("long")).withColumn("route", F.lit(1).cast("long")).coalesce(1)
    reports = S._reports(segments.select("route", "segment", "mark", "words", "n"), 20)
    runs = S._spread(segments.join(reports, ["segment", "mark"])).groupBy("key", "check").agg(F.collect_set("runs").alias("all_runs")).collect()
    assert len(runs) == 20
    for row in runs:
        covered = {w for x in row.all_runs for a, b in np.frombuffer(x, "<i8").reshape(-1, 2).tolist() for w in range(a, b)}
        assert covered == set(range(25))


def test_wavelet_ranks():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 37, 1000)
    w = WaveletMatrix(x, 37)
    base = w.locate(np.arange(37), np.zeros(37, np.int64))
    for at in (0, 1, 63, 64, 65, 500, 1000):
        got = w.locate(np.arange(37), np.full(37, at)) - base
        assert got.tolist() == [(x[:at] == c).sum() for c in range(37)]


def test_index_reports_weighted_repeats():
    segments = [b"a b c d e f".split(), b"x b c d e y".split(), b"q r s t u".split()]
    assert FmIndex(segments, np.array([1, 1, 1])).repeats(3) == [[(1, 5)], [(1, 5)], []]
    assert FmIndex(segments, np.array([1, 1, 2])).repeats(3)[2] == [(0, 5)]
