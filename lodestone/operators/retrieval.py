"""Retrieval: postings, exact and quantised vector search, rank fusion, hashed features, diversity. ``search`` has the stored index.

Queries are small relations (query_id, ...): a search serves one or a million of them with one plan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V

K1, B = 1.2, 0.75
RRF_K = 60
#: Queries that meet the vectors together, and scores of vectors with them that are held at once.
BROADCAST_ROWS, _SCORES = 1000, 2**19


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, doc_id, tf): the index in long form, best stored partitioned by term."""
    terms = docs.select(F.col(doc_id).alias("doc_id"), F.explode(T.content_tokens(F.col(text))).alias("term"))
    return terms.groupBy("term", "doc_id").agg(F.least(F.count(F.lit(1)), F.lit(65_535)).alias("tf"))


def doc_lengths(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.size(T.content_tokens(F.col(text))).cast("long").alias("doc_len"))


def top_k(scored: DataFrame, k: int, *ties: str, by: str = "score", per: str | None = "query_id") -> DataFrame:
    """The k best rows of each query with their rank; ties go by the given columns."""
    order = [F.col(by).desc(), *map(F.col, ties)]
    if per is None:
        return scored.orderBy(*order).limit(k)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(*order))).where(F.col("rank") <= k)


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 60, *, quantised: bool = False, exclude_self: bool = False) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest of vectors (vec_id, embedding) to each of queries
    (query_id, vector). Each task multiplies its rows with a block of queries and sends on its own k best,
    so the shuffle holds k rows a task and query. Queries are a stated set, taken in blocks of ``BROADCAST_ROWS``:
    each block meets all vectors, and the best of a query are those of all its blocks."""
    asked = ((r["query_id"], np.array(r["vector"], np.float64)) for r in queries.orderBy("query_id").select("query_id", "vector").toLocalIterator())
    found = None
    for rows in batched(asked, BROADCAST_ROWS):
        part = _scored(vectors, [q for q, _ in rows], np.array([v for _, v in rows]), k, quantised, exclude_self)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = _scored(vectors, [], np.zeros((0, 0)), k, quantised, exclude_self)
    return top_k(found.withColumn("key", F.round("score", 9)), k, "vec_id", by="key").drop("key")


class Best:
    """The k best rows of each query among those that were added: by score to so many digits, then the lower id."""

    def __init__(self, queries: int, k: int, digits: int = 9):
        self.k, self.digits = k, digits
        self.held = [(np.zeros(0), np.zeros(0, np.int64)) for _ in range(queries)]
        self.least = np.full(queries, -np.inf)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: a row for each id, a column for each query; -inf is never held."""
        # only what may be as good as those held is rounded
        near = (scores >= self.least - 10.0**-self.digits) & np.isfinite(scores)
        query, row = np.nonzero(np.ascontiguousarray(near.T))
        some = scores[row, query]
        good = np.round(some, self.digits) >= self.least[query]
        query, row, some = query[good], row[good], some[good]
        if not len(row):  # none is as good as those held
            return
        begin = np.flatnonzero(np.diff(query, prepend=-1))
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(query)], strict=True):
            j = int(query[a])
            score = np.concatenate([self.held[j][0], some[a:b]])
            number = np.concatenate([self.held[j][1], ids[row[a:b]]])
            best = np.lexsort((number, -np.round(score, self.digits)))[: self.k]
            self.held[j] = score[best], number[best]
            if len(best) == self.k:
                self.least[j] = np.round(score[best[-1]], self.digits)

    def rows(self, queries: np.ndarray, name: str, among: np.ndarray | None = None) -> pa.RecordBatch:
        held = [(q, s, n) for j, (q, (s, n)) in enumerate(zip(queries.tolist(), self.held, strict=True)) if among is None or among[j]]
        columns = [np.repeat(np.array([q for q, _, _ in held], np.int64), [len(s) for _, s, _ in held]), np.concatenate([np.zeros(0, np.int64), *(n for _, _, n in held)]), np.concatenate([np.zeros(0), *(s for _, s, _ in held)])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", name, "score"])


def _scored(vectors: DataFrame, ids: list[int], q: np.ndarray, k: int, quantised: bool, exclude_self: bool) -> DataFrame:
    """(query_id, vec_id, score): each task's k best for a block of queries with these ids and vectors."""
    asked = np.array(ids, np.int64)
    step = max(1, min(2048, _SCORES // max(1, len(ids))))  # so that memory does not grow with the queries of a block

    def steps_of(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scale = np.abs(m).max(1, initial=0) / 127
        return np.clip(np.floor(m / np.where(scale > 0, scale, 1)[:, None] + 0.5), -127, 127), scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        for batch in batches:
            for begin in range(0, len(batch) if ids else 0, step):
                some = batch.slice(begin, step)
                numbers = some.column("vec_id").to_numpy(zero_copy_only=False)
                m = some.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), -1)
                if quantised:
                    (a, sa), (b, sb) = steps_of(m), steps_of(q)
                    scores = (a @ b.T) * sa[:, None] * sb
                else:
                    scores = m @ q.T
                if exclude_self:
                    scores[numbers[:, None] == asked] = -np.inf
                best.add(numbers, scores)
        yield best.rows(asked, "vec_id")

    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "query_id long, vec_id long, score double")


def rrf(lists: list[tuple[DataFrame, float]], key: str = "doc_id", k: int = RRF_K) -> DataFrame:
    """(query_id, key, score) of ranked lists (query_id, key, rank), each with a weight."""
    union = None
    for ranked, weight in lists:
        part = ranked.select("query_id", key, (F.lit(weight) / (k + F.col("rank"))).alias("share"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy("query_id", key).agg(F.sum("share").alias("score"))


def ranked(scored: DataFrame, *ties: str, by: str = "score") -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(by).desc(), *map(F.col, ties))))


def fnv1a_all(texts: list[str]) -> np.ndarray:
    """FNV-1a, 32 bits, of each text's code points: one step for the k-th character of all."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    begin = np.cumsum(size) - size
    h = np.full(len(texts), 2166136261, np.uint64)
    live = np.flatnonzero(size)
    k = 0
    while len(live):
        h[live] = (h[live] ^ codes[begin[live] + k]) * np.uint64(16777619) & np.uint64(0xFFFFFFFF)
        k += 1
        live = live[size[live] > k]
    return h.astype(np.int64)


# What a run of characters and a pair of words weigh beside a word, and which words have runs.
_RUN, _PAIR, _RUNS_FROM = 0.30, 0.55, 6


class Counts:
    """The distinct words of documents, and (document, word, n) by document."""

    def __init__(self, token_lists: list[list[str]]):
        words: dict[str, int] = {}
        self.size = np.array([len(ts or []) for ts in token_lists], np.int64)
        self.flat = np.array([words.setdefault(t, len(words)) for ts in token_lists for t in ts or []], np.int64)
        self.owner = np.repeat(np.arange(len(token_lists)), self.size)
        self.words = list(words)
        many = max(1, len(words))
        key, self.n = np.unique(self.owner * many + self.flat, return_counts=True)
        self.doc, self.word = key // many, key % many


def hashed(token_lists: list[list[str]], dim: int, counts: Counts | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, weight) of each document's tokens, of unit length: signed feature hashing of words, of runs of
    four characters in long words, and of pairs of words. Each distinct feature is hashed once."""
    counts = counts or Counts(token_lists)
    words, flat, owner = counts.words, counts.flat, counts.owner
    if not len(flat):
        return flat, flat, np.zeros(0)
    many = len(words)
    # the features of each distinct word
    names: dict[str, int] = {}
    which, share, cut = [], [], [0]
    for word in words:
        runs = len(word) - 3 if len(word) >= _RUNS_FROM else 0
        which.append(names.setdefault(word, len(names)))
        which += [names.setdefault("c:" + word[i : i + 4], len(names)) for i in range(runs)]
        share += [1.0] + [_RUN / math.sqrt(runs)] * runs if runs else [1.0]
        cut.append(len(which))
    which, share, cut = np.array(which), np.array(share), np.array(cut)
    doc, word, tf = counts.doc, counts.word, 1 + np.log(counts.n)
    size = np.diff(cut)[word]
    upto = np.cumsum(size)
    at = np.repeat(cut[word] - upto + size, size) + np.arange(int(upto[-1]))
    follow = owner[1:] == owner[:-1]
    pair, inverse = np.unique(flat[:-1][follow] * many + flat[1:][follow], return_inverse=True)
    first = len(names)
    every = [*names, *(f"b:{words[a]}_{words[b]}" for a, b in zip((pair // many).tolist(), (pair % many).tolist(), strict=True))]
    key, n = np.unique(owner[1:][follow] * max(1, len(pair)) + inverse, return_counts=True)
    feature = np.concatenate([which[at], first + key % max(1, len(pair))])
    weight = np.concatenate([np.repeat(tf, size) * share[at], _PAIR * (1 + np.log(n))])
    document = np.concatenate([np.repeat(doc, size), key // max(1, len(pair))])
    bucket, sign = fnv1a_all(every) % dim, np.where(fnv1a_all(["sgn:" + x for x in every]) % 2 == 1, 1.0, -1.0)
    key, inverse = np.unique(document * dim + bucket[feature], return_inverse=True)
    total = np.bincount(inverse, weight * sign[feature], len(key))
    document = key // dim
    length = np.sqrt(np.bincount(document, total * total, len(token_lists)))
    return document, key % dim, np.divide(total, length[document], out=np.zeros(len(total)), where=length[document] > 0)


def dense(token_lists: list[list[str]], dim: int = 1536, counts: Counts | None = None) -> np.ndarray:
    """A unit vector for each document; zeros for one without tokens."""
    out = np.zeros((len(token_lists), dim))
    document, bucket, weight = hashed(token_lists, dim, counts)
    out[document, bucket] = weight
    return out


def features(docs: DataFrame, dim: int = 1536, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, bucket, weight) as by ``hashed``. A document's features are its own, so this is one map; as a relation of
    features it would be four shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 256):
                some = batch.slice(begin, 256)
                document, bucket, weight = hashed(some.column("tokens").to_pylist(), dim)
                yield pa.RecordBatch.from_arrays([some.column("doc_id").take(pa.array(document)), pa.array(bucket), pa.array(weight)], names=["doc_id", "bucket", "weight"])

    source = docs.select(F.col(doc_id).alias("doc_id"), T.content_tokens(F.col(text)).alias("tokens"))
    return source.mapInArrow(run, source.select("doc_id").schema.add("bucket", "long").add("weight", "double"))


def mmr_order(relevance: np.ndarray, vectors: np.ndarray, trade: float = 0.72) -> list[int]:
    """Greedy order: each next has the best of relevance against its likeness to those before."""
    n = len(relevance)
    r = np.maximum(0, relevance)
    r = r / r.max() if n and r.max() > 0 else 1 - np.arange(n) / max(1, n)
    left, out, like = list(range(n)), [], np.zeros(n)
    while left:
        value = [trade * r[i] - (1 - trade) * max(0.0, like[i]) for i in left]
        pick = left.pop(int(np.argmax(value)))
        out.append(pick)
        like = np.maximum(like, vectors @ vectors[pick]) if len(out) > 1 else vectors @ vectors[pick]
    return out


def mmr(candidates: DataFrame, limit: int = 12, trade: float = 0.72) -> DataFrame:
    """(query_id, vec_id, mmr_rank) of candidates (query_id, vec_id, score, embedding): a bounded list a query."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "vec_id"], ascending=[False, True]).reset_index(drop=True)
        order = mmr_order(group["score"].to_numpy(), np.array(group["embedding"].tolist(), np.float64), trade)[:limit]
        return pd.DataFrame({"query_id": group["query_id"].iloc[order].to_numpy(), "vec_id": group["vec_id"].iloc[order].to_numpy(), "mmr_rank": np.arange(1, len(order) + 1)})

    return candidates.groupBy("query_id").applyInPandas(run, "query_id long, vec_id long, mmr_rank int")


def best_passage(passages: DataFrame) -> DataFrame:
    """(query_id, doc_id, i, score): of passages with scores the best of each document, the first of equals."""
    order = Window.partitionBy("query_id", "doc_id").orderBy(F.col("score").desc(), "i")
    return passages.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def connections(vectors: DataFrame, anchors: DataFrame, *, least: float, gap: int, k: int = 6) -> DataFrame:
    """(a, b, similarity): of each anchor's k nearest those similar enough and ``gap`` apart in time (at), once a pair."""
    near = vector_search(vectors, anchors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), k, exclude_self=True)
    at = vectors.select("vec_id", "at")
    timed = near.join(at, "vec_id").join(anchors.select(F.col("vec_id").alias("query_id"), F.col("at").alias("other")), "query_id")
    kept = timed.where((F.round("score", 9) >= least) & (F.abs(F.col("at") - F.col("other")) >= gap))
    return kept.groupBy(F.least("query_id", "vec_id").alias("a"), F.greatest("query_id", "vec_id").alias("b")).agg(F.max("score").alias("similarity"))


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    """(by, i, mean) of each component."""
    return vectors.select(by, F.posexplode("embedding").alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def normalised(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", V.l2_normalize(F.col("embedding")).alias("v"))
