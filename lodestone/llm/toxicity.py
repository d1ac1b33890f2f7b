"""Toxicity by a classifier chain of linear models.

The categories are label columns in a given order. Each has a logistic regression whose inputs are the
presence of words and word beginnings (three to seven bytes, so that inflected forms count together)
and the log odds of the earlier categories. In training those come out of fold: the rows of a fold get
the probabilities of a model that has not seen them, for in use the earlier models have not seen the
text either. Features are hashed into 2 ** 20 buckets, of which each category uses the ``FEATURES``
with the largest chi-square against its labels.

Fitting takes a bounded sample of labelled rows (``sample`` of them on average, by a hash of the
id; all if there are fewer); buckets are counted on the executors, and the driver gets the chosen
features of the sample alone. Prediction is one map over all rows and whole texts, without a shuffle.

The decision threshold is the one with the best F1 on the out-of-fold probabilities. Rows without
a label of a category are not used for it; several labels of one id count as the largest, and of several texts of
one id the least is learned from. A category with one class only has its smoothed share as probability, and nothing is
flagged if that is the last. Null and empty texts have no features. Repeated rows give repeated results. Of features with
equal chi-square the lower bucket is taken. Very long texts are a step of their own. Empty input gives empty output, and
without labels nothing is flagged. Only ``keep`` and the text are read of other columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _MASK, hash_words, map_arrow, steps, text_bytes

BUCKETS = 1 << 20
FEATURES = 400
FOLDS = 5
_BEGIN = range(3, 8)
# letters of any script: ASCII letters in lower case and all bytes of longer characters
_FOLD = np.zeros(256, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of all words and word beginnings, repeats included."""
    n = int(offsets[-1])
    folded = np.concatenate([_FOLD[data[:n]], np.zeros(8, np.uint8)])
    solid = folded[: n + 1] > 0
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    at = offsets[1:-1]
    start[at] = solid[at]
    end[at[at > 0] - 1] = solid[at[at > 0] - 1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    if not len(start):
        return doc, doc
    size = end - start
    eights = np.ndarray((len(folded) - 7,), "<u8", folded, 0, (1,))[start]
    bucket, owner = [hash_words(folded, start, end) >> np.uint64(44)], [doc]
    for k in _BEGIN:
        some = np.flatnonzero(size > k)
        h = (eights[some] & _MASK[k]) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
        h ^= h >> np.uint64(29)
        bucket.append(h * np.uint64(0xA0761D6478BD642F) >> np.uint64(44))
        owner.append(doc[some])
    return np.concatenate(owner), np.concatenate(bucket).astype(np.int64)


def _chosen(data: np.ndarray, offsets: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, column) of the chosen features present, each once."""
    doc, bucket = features(data, offsets)
    column = place[bucket]
    some = column >= 0
    pair = np.unique(doc[some] * (1 << 32) + column[some])
    return pair >> 32, pair & (1 << 32) - 1


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights by Newton's method; the last column of x is the constant and is not penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        gradient = x.T @ (y - p) - penalty * w
        step = np.linalg.solve((x * s[:, None]).T @ x + np.diag(penalty), gradient)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _p(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


@dataclass
class Chain:
    categories: list[str]
    place: np.ndarray  # of each bucket, its column or -1
    columns: list[np.ndarray]  # by category, the columns it uses
    weights: list[np.ndarray]  # of those, of the earlier log odds, and the constant
    threshold: float

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities, documents by categories."""
        n = len(offsets) - 1
        doc, column = _chosen(data, offsets, self.place)
        return self.of_pairs(n, doc, column)

    def of_pairs(self, n: int, doc: np.ndarray, column: np.ndarray) -> np.ndarray:
        out = np.zeros((n, len(self.categories)))
        for k, (own, w) in enumerate(zip(self.columns, self.weights, strict=True)):
            by_column = np.zeros(int(self.place.max()) + 2)
            by_column[own] = w[: len(own)]
            z = np.bincount(doc, by_column[column], n) + w[-1]
            for earlier in range(k):
                z += w[len(own) + earlier] * _odds(out[:, earlier])
            out[:, k] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], *, sample: int = 12_000) -> Chain:
    """A chain over label columns ``categories`` (0 or 1) of labels (doc_id), for texts of docs."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(F.col(c).cast("int")).alias(c) for c in categories])
    total = known.count()
    share = int(min(1.0, sample / max(1, total)) * (1 << 20))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) < share)
    # the sample's size is bounded, so the labels go to the texts; an id that several rows have has one text
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *categories).agg(F.min("text").alias("text"))
    rows = found.select(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"), "text", *categories)
    kinds = len(categories)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((BUCKETS + 1, 2 * kinds), np.int64)  # the last row counts documents
        for batch in steps(batches):
            doc, bucket = features(*text_bytes(batch.column("text")))
            pair = np.unique(doc * BUCKETS + bucket)
            doc, bucket = pair // BUCKETS, pair % BUCKETS
            for k, c in enumerate(categories):
                y = batch.column(c).to_pylist()
                for value in (0, 1):
                    is_value = np.array([v == value for v in y], bool)
                    n[:BUCKETS, 2 * k + value] += np.bincount(bucket[is_value[doc]], minlength=BUCKETS)
                    n[BUCKETS, 2 * k + value] += is_value.sum()
        some = np.flatnonzero(n.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some)] + [pa.array(n[some, j]) for j in range(2 * kinds)], names=["bucket", *(f"n{j}" for j in range(2 * kinds))])

    schema = "bucket long, " + ", ".join(f"n{j} long" for j in range(2 * kinds))
    counted = map_arrow(rows, count, schema).groupBy("bucket").agg(*[F.sum(f"n{j}").alias(f"n{j}") for j in range(2 * kinds)]).toPandas()
    n = np.zeros((BUCKETS + 1, 2 * kinds))
    n[counted["bucket"].to_numpy(np.int64)] = counted[[f"n{j}" for j in range(2 * kinds)]].to_numpy()
    buckets = [_best(n[:BUCKETS, 2 * k : 2 * k + 2], n[BUCKETS, 2 * k : 2 * k + 2]) for k in range(kinds)]
    every = np.unique(np.concatenate(buckets)) if kinds else np.zeros(0, np.int64)
    place = np.full(BUCKETS, -1, np.int32)
    place[every] = np.arange(len(every))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            doc, column = _chosen(*text_bytes(batch.column("text")), place)
            at = np.searchsorted(doc, np.arange(len(batch) + 1))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(column.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("fold", *categories)] + [lists], names=["fold", *categories, "columns"])

    taken = map_arrow(rows, take, "fold int, " + ", ".join(f"`{c}` int" for c in categories) + ", columns array<int>").toPandas()
    taken = taken.assign(order=[tuple(c) for c in taken["columns"]]).sort_values(["fold", *categories, "order"], kind="stable")
    x = np.zeros((len(taken), len(every)), np.float64)
    for i, columns in enumerate(taken["columns"]):
        x[i, np.asarray(columns, np.int64)] = 1
    fold = taken["fold"].to_numpy(np.int64)
    return _chain(categories, place, [place[b].astype(np.int64) for b in buckets], x, {c: taken[c].to_numpy(np.float64) for c in categories}, fold)


def _best(n: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The FEATURES buckets with the largest chi-square, of those in three documents or more."""
    have = n.sum(1)
    total = docs.sum()
    if not docs.all():
        return np.zeros(0, np.int64)
    expected = have * docs[1] / total
    chi = (n[:, 1] - expected) ** 2 / np.maximum(expected * (1 - docs[1] / total) * np.maximum(1 - have / total, 1 / total), 1e-9)
    chi[have < 3] = 0
    best = np.argsort(-chi, kind="stable")[:FEATURES]
    return np.sort(best[chi[best] > 4])


def _chain(categories, place, columns, x, labels, fold) -> Chain:
    odds: list[np.ndarray] = []
    weights, out_of_fold = [], np.zeros(len(x))
    y = np.zeros(0)
    for c, own in zip(categories, columns, strict=True):
        y = labels[c]
        full = np.column_stack([x[:, own], *odds, np.ones(len(x))])
        known = ~np.isnan(y)
        if not known.any() or y[known].min() == y[known].max():
            share = (np.nansum(y) + 0.5) / (known.sum() + 1)
            weights.append(np.append(np.zeros(full.shape[1] - 1), _odds(np.array(share))))
            out_of_fold = np.full(len(x), share)
        else:
            weights.append(logistic(full[known], y[known]))
            out_of_fold = _p(full, weights[-1])
            for k in range(FOLDS):
                others = known & (fold != k)
                if others.any() and y[others].min() < y[others].max():
                    out_of_fold[fold == k] = _p(full[fold == k], logistic(full[others], y[others]))
        odds.append(_odds(out_of_fold))
    known = ~np.isnan(y)
    return Chain(list(categories), place, columns, weights, _threshold(out_of_fold[known], y[known]))


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap below the cut with the best F1."""
    if not len(y) or y.min() == y.max():
        return 1.0
    order = np.argsort(-p, kind="stable")
    p, hit = p[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = 0  # equal probabilities are not parted
    cut = int(f1.argmax())
    return float((p[cut] + p[min(cut + 1, len(p) - 1)]) / 2)


def classify(docs: DataFrame, chain: Chain, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """p_<category> of each category, and ``toxic``: the last one's decision."""
    source = docs.select(*keep, F.col(text).alias("text__"))
    schema = source.drop("text__").schema
    for c in chain.categories:
        schema = schema.add(f"p_{c}", "double")
    schema = schema.add("toxic", "boolean")
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # of fixed size: 2 ** 20 places and the weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in steps(batches, "text__", 2 << 20):
            p = c.predict(*text_bytes(batch.column("text__")))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(keep))] + [pa.array(p[:, k]) for k in range(p.shape[1])] + [pa.array(p[:, -1] >= c.threshold)], names=schema.names)

    return map_arrow(source, run, schema)
