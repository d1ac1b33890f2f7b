"""Search over a stored index: postings, lengths and 8-bit vectors, written once and read by the terms asked for.

An index is a folder of three tables. ``docs`` has a row for each document: its length, its terms and its hashed vector in
8-bit steps. ``postings`` (term, doc_id, tf, doc_len) is dealt out by ranges of term and document and sorted, so that
a common term is spread over tasks and files and the least and greatest term of a row group rule out the rest. ``meta`` has
one row: the number of documents and of tokens, the version of the analyzer, the embedding space, whether there are postings.
An index that is searched once is written without them: to sort all postings takes longer than to read all terms twice.

Questions are a stated set, taken in blocks of ``BLOCK``: a block's texts are read to the driver and go to the tasks as
vectors and terms. From there on it is one plan for all of them. Where the terms are too many for a condition, or there are
no postings, each task weighs the terms of its documents for ``_TOGETHER`` questions at a time and sends on the best, so that
no pair of question and document is shuffled; one job before counts the documents of each term.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import retrieval
from .retrieval import B, K1

ANALYZER_VERSION = 3
SPACE, DIM = "local:1536", 1536
#: Questions that are searched by one plan, and those of them that a task compares with some documents at once.
BLOCK, _TOGETHER = 16_000, 500
#: Terms up to which the postings are read by a condition on the term; beyond it the terms of all documents are.
PRUNED_TERMS = 200
#: Characters of a passage that is given as evidence.
EVIDENCE = 1400
#: Documents whose vectors are computed together, and weights of documents' terms that are held at once.
_ROWS, _WEIGHTS = 256, 2**23


class Index:
    """An index as written by ``write_index``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        meta = spark.read.parquet(f"{path}/meta").first()
        if meta["analyzer"] != ANALYZER_VERSION:
            raise ValueError(f"the index has analyzer version {meta['analyzer']}, not {ANALYZER_VERSION}; write it anew")
        self.n, self.tokens, self.space = meta["n"], meta["tokens"], meta["space"]
        self.has_postings = meta.asDict().get("postings", True)

    @property
    def docs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/docs")

    def postings(self, terms: list[str]) -> DataFrame:
        """The postings of these terms only."""
        return _of_terms(self.spark.read.parquet(f"{self.path}/postings"), terms)


def _of_terms(rows: DataFrame, terms: list[str]) -> DataFrame:
    if len(terms) <= PRUNED_TERMS:
        return rows.where(F.col("term").isin(terms))
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame([(t,) for t in terms], "term string")), "term")


def write_index(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", files: int | None = None, vectors: bool = True, postings: bool = True) -> None:
    """Index docs, whose ids are distinct. Their texts are read and cut into tokens once. ``files``: how many the postings are
    dealt out to; by default as many as the session shuffles to. Without ``vectors`` it is searched by words, without
    ``postings`` by the terms of its documents."""
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = source.select("doc_id").schema.add("doc_len", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), _ROWS):
                some = batch.slice(begin, _ROWS)
                lists = [T.content_words(x) for x in some.column("text").to_pylist()]
                counts = retrieval.Counts(lists)
                q, scale = steps_of(retrieval.dense(lists, DIM, counts)) if vectors else (np.zeros((len(lists), 0)), np.zeros(len(lists)))
                packed = pa.array([x.tobytes() for x in q.astype(np.int8)], pa.binary())
                terms = pa.StructArray.from_arrays([pa.array(counts.words, pa.string()).take(pa.array(counts.word)), pa.array(np.minimum(counts.n, 65_535).astype(np.int32))], names=["term", "tf"])
                cut = pa.array(np.searchsorted(counts.doc, np.arange(len(lists) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(counts.size), pa.ListArray.from_arrays(cut, terms), packed, pa.array(scale)], names=["doc_id", "doc_len", "terms", "q", "scale"])

    kind = "array<struct<term:string,tf:int>>"
    table = source.mapInArrow(run, f"{schema['doc_id'].name} {schema['doc_id'].dataType.simpleString()}, doc_len long, terms {kind}, q binary, scale double")
    table.write.mode("overwrite").parquet(f"{path}/docs")
    table = spark.read.parquet(f"{path}/docs")
    if postings:
        rows = table.select("doc_id", "doc_len", F.explode("terms").alias("t")).select("t.term", "doc_id", "t.tf", "doc_len")
        rows.repartitionByRange(*([files] if files else []), "term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    sums = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("tokens"))
    sums.select("n", "tokens", F.lit(ANALYZER_VERSION).alias("analyzer"), F.lit(SPACE if vectors else "").alias("space"), F.lit(postings).alias("postings")).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def steps_of(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in 127 steps each way, and the size of a step."""
    scale = np.abs(m).max(1, initial=0) / 127
    return np.clip(np.floor(m / np.where(scale > 0, scale, 1)[:, None] + 0.5), -127, 127), scale


def length(steps: np.ndarray) -> np.ndarray:
    """The length of each row of 8-bit steps."""
    m = steps.astype(np.float32)
    return np.sqrt(np.einsum("ij,ij->i", m, m))


class Questions:
    """A block of questions: ids, terms, unit vectors by their buckets, and these in 8-bit steps."""

    def __init__(self, spark: SparkSession, rows: list):
        self.spark = spark
        self.ids = [r["query_id"] for r in rows]
        self.tokens = [T.content_words(r["query"]) for r in rows]
        self.terms = sorted({t for ts in self.tokens for t in ts})
        self.q, self.scale, self.vectors = np.zeros((len(rows), DIM), np.int8), np.zeros(len(rows)), {}
        for begin in range(0, len(rows), _TOGETHER):  # few are held in full
            full = retrieval.dense(self.tokens[begin : begin + _TOGETHER], DIM)
            self.q[begin : begin + _TOGETHER], self.scale[begin : begin + _TOGETHER] = steps_of(full)
            for i, v in zip(self.ids[begin : begin + _TOGETHER], full, strict=True):
                bucket = np.flatnonzero(v)
                self.vectors[i] = bucket, v[bucket]

    @property
    def pairs(self) -> DataFrame:
        pairs = [(i, t) for i, ts in zip(self.ids, self.tokens, strict=True) for t in dict.fromkeys(ts)]
        return self.spark.createDataFrame(pairs, "query_id long, term string")

    @classmethod
    def blocks(cls, queries: DataFrame) -> Iterator[Questions]:
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "query")
        for rows in batched(asked.orderBy("query_id").toLocalIterator(), BLOCK):
            yield cls(queries.sparkSession, list(rows))


def _united(parts: Iterator[DataFrame], empty: DataFrame) -> DataFrame:
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return empty if out is None else out


def _nothing(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def lexical(index: Index, asked: Questions, k: int = 60, allowed: DataFrame | None = None) -> DataFrame:
    """BM25: (query_id, doc_id, score, rank). ``allowed`` (doc_id) restricts the results, not the statistics."""
    if not index.has_postings or len(asked.terms) > PRUNED_TERMS:
        # a sum's last digits depend on the order of its terms, so equal texts are told apart by their ids only if those digits go
        return retrieval.top_k(_by_documents(index, asked, k, allowed).withColumn("key", F.round("score", 12)), k, "doc_id", by="key").drop("key")
    post = index.postings(asked.terms)
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = asked.pairs.join(df, "term").select("query_id", "term", F.log(1 + (F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    if allowed is not None:
        post = post.join(allowed.select("doc_id"), "doc_id", "left_semi")
    average = index.tokens / index.n if index.tokens else 1.0
    share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.lit(average)))
    # weighed has a row for each term of each question of the block
    total = post.join(F.broadcast(weighed), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * share).alias("score")).where("score > 0")
    return retrieval.top_k(total.withColumn("key", F.round("score", 12)), k, "doc_id", by="key").drop("key")


def _by_documents(index: Index, asked: Questions, k: int, allowed: DataFrame | None) -> DataFrame:
    """(query_id, doc_id, score): each task's k best by BM25, from the terms of its documents."""
    counted = _of_terms(index.docs.select(F.explode("terms.term").alias("term")), asked.terms).groupBy("term").count()
    df = {r["term"]: r["count"] for r in counted.collect()} if asked.terms else {}
    terms = sorted(df)
    place = {t: i for i, t in enumerate(terms)}
    n, average = index.n, index.tokens / index.n if index.tokens else 1.0
    idf = np.log(1 + (n - np.array([df[t] for t in terms], np.float64) + 0.5) / (np.array([df[t] for t in terms], np.float64) + 0.5))
    ids = np.array(asked.ids, np.int64)
    # of some questions: their ids, their terms, and of each question the places of its own among these
    blocks = []
    for begin in range(0, len(ids), _TOGETHER):
        own = [[place[t] for t in dict.fromkeys(ts) if t in place] for ts in asked.tokens[begin : begin + _TOGETHER]]
        among = np.unique(np.array([p for ps in own for p in ps], np.int64))
        blocks.append((ids[begin : begin + _TOGETHER], among, [np.searchsorted(among, np.array(sorted(ps), np.int64)) for ps in own]))
    # so that memory does not grow with the terms of the questions
    step = max(1, min(_ROWS * 8, _WEIGHTS // max([1, *(len(among) for _, among, _ in blocks)])))
    rows = index.docs.select("doc_id", "doc_len", "terms")
    if allowed is not None:
        rows = rows.join(allowed.select("doc_id"), "doc_id", "left_semi")
    if len(terms) <= PRUNED_TERMS:
        rows = rows.withColumn("terms", F.filter("terms", lambda t: t["term"].isin(terms))).where(F.size("terms") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, known = [retrieval.Best(len(q), k, 12) for q, _, _ in blocks], pa.array(terms, pa.string())
        local = np.full(len(terms), -1)
        for batch in batches:
            for begin in range(0, len(batch), step):
                some = batch.slice(begin, step)
                lists, numbers = some.column("terms"), some.column("doc_id").to_numpy(zero_copy_only=False)
                term, tf = lists.flatten().flatten()
                at = pc.fill_null(pc.index_in(term, known), -1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(some)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                asked_for = at >= 0
                at, row, tf = at[asked_for], row[asked_for], tf.to_numpy(zero_copy_only=False)[asked_for].astype(np.float64)
                size = some.column("doc_len").to_numpy(zero_copy_only=False)[row]
                weight = idf[at] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / average)))
                for (_, among, own), held in zip(blocks, best, strict=True):
                    local[among] = np.arange(len(among))
                    to = local[at]
                    local[among] = -1
                    here = to >= 0
                    weights = np.zeros((len(among), len(some)))
                    weights[to[here], row[here]] = weight[here]
                    # the terms of a question are added in one order for all documents
                    scores = np.array([weights[ps].sum(0) for ps in own]).reshape(len(own), len(some))
                    scores[scores <= 0] = -np.inf
                    held.add(numbers, scores.T)
        for (q, _, _), held in zip(blocks, best, strict=True):
            yield held.rows(q, "doc_id")

    return rows.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "query_id long, doc_id long, score double")


def semantic(index: Index, asked: Questions, k: int = 60, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the 8-bit vectors of all documents against those of the questions. Each
    task sends on its k best a question. Documents and questions without a vector are not found."""
    rows = index.docs.select("doc_id", "q", "scale").where("scale > 0")
    if allowed is not None:
        rows = rows.join(allowed.select("doc_id"), "doc_id", "left_semi")
    q, scale, ids = asked.q, asked.scale, np.array(asked.ids, np.int64)
    blocks = [slice(begin, begin + _TOGETHER) for begin in range(0, len(ids), _TOGETHER)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [retrieval.Best(len(ids[b]), k) for b in blocks]
        longest = max((float(length(q[b]).max(initial=0)) for b in blocks), default=0.0)
        for batch in batches:
            for begin in range(0, len(batch), _ROWS * 8):
                some = batch.slice(begin, _ROWS * 8)
                m = np.frombuffer(b"".join(some.column("q").to_pylist()), np.int8).reshape(len(some), DIM)
                # no partial sum is beyond the product of the lengths: below 2**24 whole numbers are exact in 32 bits
                kind = np.float32 if float(length(m).max(initial=0)) * longest < 2**23 else np.float64
                m, steps, numbers = m.astype(kind).T, some.column("scale").to_numpy(zero_copy_only=False), some.column("doc_id").to_numpy(zero_copy_only=False)
                for b, held in zip(blocks, best, strict=True):
                    dots = (q[b].astype(kind) @ m).astype(np.float64)
                    dots *= steps
                    dots *= scale[b, None]
                    held.add(numbers, dots.T)
        for b, held in zip(blocks, best, strict=True):
            yield held.rows(ids[b], "doc_id", scale[b] > 0)  # a question without a vector finds nothing

    found = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "q", "scale").mapInArrow(run, "query_id long, doc_id long, score double")
    return retrieval.top_k(found.withColumn("key", F.round("score", 9)), k, "doc_id", by="key").drop("key")


def _rescored(docs: DataFrame, fused: DataFrame, asked: Questions, vectors: bool) -> DataFrame:
    """The rows of fused (query_id, doc_id, rank, lexical, semantic) with the exact score of the document, and its best passage:
    exact, i, start, passage, best. Each candidate's text is read and cut once, whatever number of questions it is one for."""
    wanted = fused.groupBy("doc_id").agg(F.collect_list(F.struct("query_id", "rank", "lexical", "semantic")).alias("asked"))
    # few questions have at most _TOGETHER times the number of candidates of one
    parts = docs.select("doc_id", "text").join(F.broadcast(wanted) if len(asked.ids) <= _TOGETHER else wanted, "doc_id")
    questions = asked.vectors
    kinds = [("query_id", pa.int64()), ("doc_id", pa.int64()), ("rank", pa.int64()), ("lexical", pa.float64()), ("semantic", pa.float64()), ("exact", pa.float64()), ("i", pa.int32()), ("start", pa.int32()), ("passage", pa.string()), ("best", pa.float64()), ("vec", pa.binary())]

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in (r for begin in range(0, len(batch), _ROWS) for r in batch.slice(begin, _ROWS).to_pylist()):
                cuts = T.chunk_spans(row["text"] or "")
                hashed = retrieval.dense([T.content_words(x) for x in (row["text"], *(row["text"][a:b] for a, b in cuts))], DIM)
                vec = hashed[0].astype(np.float32).tobytes() if vectors else None
                for a in row["asked"]:
                    bucket, weight = questions[a["query_id"]]
                    s = np.round(hashed[:, bucket] @ weight, 9)
                    i = int(s[1:].argmax()) if len(s) > 1 else None
                    begin, end = cuts[i] if i is not None else (None, 0)
                    out.append((a["query_id"], row["doc_id"], a["rank"], a["lexical"], a["semantic"], float(s[0]), i, begin, row["text"][begin:end] if i is not None else None, float(s[1 + i]) if i is not None else 0.0, vec))
                    if len(out) == _ROWS * 4:
                        yield packed(out)
                        out = []
            if out:
                yield packed(out)

    found = parts.mapInArrow(run, "query_id long, doc_id long, rank long, lexical double, semantic double, exact double, i int, start int, passage string, best double, vec binary")
    return found.withColumn("passage", T.clip_passage(F.col("passage"), EVIDENCE))


def _ranked(rows: DataFrame, by: str, name: str) -> DataFrame:
    """Adds the rank by a column among the rows of a question where it is above 0; null elsewhere."""
    order = Window.partitionBy("query_id").orderBy(F.col(by).desc_nulls_last(), "doc_id")
    return rows.withColumn(name, F.when(F.col(by) > 0, F.row_number().over(order)))


FOUND = "query_id long, doc_id long, score double, rank int, lexical double, semantic double, passage string, start int, i int"
_COLUMNS = [c.split()[0] for c in FOUND.split(", ")]


def is_lexical_space(space: str) -> bool:
    """Whether vectors of a space come from words by a rule, and so say again what words say."""
    return space.startswith("local:")


def hybrid(
    index: Index, docs: DataFrame, queries: DataFrame, *, limit: int = 12, arm: int = 60, rescored: int = 40, allowed: DataFrame | None = None,
    recency: DataFrame | None = None, scoped: bool = False, lexical_only: bool = False, diversify: bool = True, pool: int = 24, space: str = SPACE,
) -> DataFrame:
    """(query_id, doc_id, score, rank, lexical, semantic, passage, start, i): words and vectors fused, then the best fused again with the
    exact scores of the documents and of their best passages, which are the evidence.

    queries: (query_id, query). ``allowed`` (doc_id): what may be found; statistics are those of the whole index.
    ``recency`` (doc_id, created_at): a list of its own in the second fusion, which decides if the question is ``scoped`` to a time.
    Vectors of different embedding spaces are never compared: an index of another ``space`` is searched by words, without evidence, and
    so is any with ``lexical_only``, if vectors of its space have to be asked for. ``diversify``: where more than ``limit`` are found,
    the best of ``pool`` that differ from those above them come first.
    """
    plain = index.space != space or (lexical_only and not is_lexical_space(space))

    def block(asked: Questions) -> DataFrame:
        arms = [("lexical", lexical(index, asked, arm, allowed), 1.0)]
        if not plain:
            arms.append(("semantic", semantic(index, asked, arm, allowed), 0.6 if is_lexical_space(space) else 1.0))
        both = None
        for name, found, weight in arms:
            columns = [F.col("score").alias(n) if n == name else F.lit(None).cast("double").alias(n) for n in ("lexical", "semantic")]
            part = found.select("query_id", "doc_id", (F.lit(weight) / (retrieval.RRF_K + F.col("rank"))).alias("share"), *columns)
            both = part if both is None else both.unionByName(part)
        fused = both.groupBy("query_id", "doc_id").agg(F.round(F.sum("share"), 12).alias("score"), F.max("lexical").alias("lexical"), F.max("semantic").alias("semantic"))
        fused = retrieval.top_k(fused, rescored, "doc_id").select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), "lexical", "semantic")
        if plain:
            none = {"exact": "double", "i": "int", "start": "int", "passage": "string", "best": "double"}
            rows = fused.select("*", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
        else:
            rows = _rescored(docs, fused, asked, diversify)
        rows = _ranked(_ranked(rows, "exact", "exact_rank"), "best", "best_rank")
        shares = [(F.col("rank"), 0.5 if scoped else 1.0), (F.col("exact_rank"), 1.0), (F.col("best_rank"), 1.3)]
        if recency is not None:
            newest = Window.partitionBy("query_id").orderBy(F.col("created_at").desc_nulls_last(), "doc_id")
            rows = rows.join(recency.select("doc_id", "created_at"), "doc_id", "left").withColumn("newest", F.row_number().over(newest))
            shares.append((F.col("newest"), 2.5 if scoped else 0.25))
        score = reduce(lambda a, b: a + b, [F.coalesce(F.lit(w) / (retrieval.RRF_K + r), F.lit(0.0)) for r, w in shares])
        rows = rows.withColumn("score", F.round(score, 12)).drop("rank")
        rows = rows.withColumn("semantic", F.coalesce("semantic", "exact")).withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))
        evident = F.col("best") > 0
        rows = rows.select("*", *[F.when(evident, F.col(c)).alias(f"{c}_") for c in ("passage", "start", "i")]).drop("passage", "start", "i").withColumnsRenamed({f"{c}_": c for c in ("passage", "start", "i")})
        if diversify and not plain:
            return _diverse(retrieval.top_k(rows, max(pool, limit), "doc_id"), limit, pool)
        return retrieval.top_k(rows, limit, "doc_id").withColumn("rank", F.col("rank").cast("int")).select(*_COLUMNS)

    return _united(map(block, Questions.blocks(queries)), _nothing(index.spark, FOUND))


def _diverse(found: DataFrame, limit: int, pool: int) -> DataFrame:
    """The rows of each question, those of the pool in an order that trades their score against their likeness to those before."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank").reset_index(drop=True)
        order = list(range(len(group)))
        if len(group) > limit:
            vectors = np.array([np.frombuffer(v, np.float32) for v in group["vec"][:pool]]).reshape(-1, DIM)
            order = [*retrieval.mmr_order(group["score"].to_numpy()[:pool], vectors)[:limit], *order[pool:]]
        order = order[:limit]
        return group.iloc[order].assign(rank=np.arange(1, len(order) + 1, dtype=np.int32))[_COLUMNS]

    return found.groupBy("query_id").applyInPandas(run, FOUND)


def bm25(index: Index, queries: DataFrame, k: int = 60, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) of queries (query_id, query)."""
    return _united((lexical(index, q, k, allowed) for q in Questions.blocks(queries)), _nothing(index.spark, "query_id long, doc_id long, score double, rank int"))


def semantic_search(index: Index, queries: DataFrame, k: int = 60, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) by 8-bit vectors alone: what is related to a text."""
    return _united((semantic(index, q, k, allowed) for q in Questions.blocks(queries)), _nothing(index.spark, "query_id long, doc_id long, score double, rank int"))


def ambient(index: Index, docs: DataFrame, titles: DataFrame, *, limit: int = 4, keep: int = 3, least: float = 0.12) -> DataFrame:
    """(query_id, doc_id, score, rank): what is related to the page that is looked at, titles (query_id, query, url) against docs
    with a url: the best found that share words with the title and are not the page itself."""
    # pages with the same title ask the same, once; one without a title finds nothing
    asked = titles.groupBy("query").agg(F.min(F.col("query_id").cast("long")).alias("query_id"))
    every = titles.select(F.col("query_id").cast("long").alias("query_id"), "query", F.col("url").alias("own_url"))
    own = every.join(asked.withColumnRenamed("query_id", "asked_id"), "query")
    found = hybrid(index, docs, asked, limit=limit, lexical_only=True).withColumnRenamed("query_id", "asked_id")
    other = found.where(F.col("lexical") > least).join(docs.select("doc_id", "url"), "doc_id").join(own, "asked_id").where(~F.col("url").eqNullSafe(F.col("own_url")))
    other = other.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return other.where(F.col("place") <= keep).select("query_id", "doc_id", "score", F.col("place").alias("rank"))


def passages(docs: DataFrame, hits: DataFrame, query: str) -> DataFrame:
    """(doc_id, i, start, passage, score): of each hit (doc_id) the passage that is most like the question."""
    spark = docs.sparkSession
    none = F.lit(None).cast("double")
    candidates = hits.select(F.lit(1).cast("long").alias("query_id"), "doc_id", F.lit(0).cast("long").alias("rank"), none.alias("lexical"), none.alias("semantic"))
    parts = [_rescored(docs, candidates, q, False) for q in Questions.blocks(spark.createDataFrame([(1, query)], "query_id long, query string"))]
    return parts[0].where("best > 0").select("doc_id", "i", "start", "passage", F.col("best").alias("score"))
