"""Questions over a corpus: time scope, hybrid search, evidence, context, conversation."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import time as D
from ..operators import retrieval, search, tables
from ..sources import store


class Embedder(Protocol):
    """A source of vectors. Vectors of different spaces are never compared."""

    space: str

    def embed(self, docs: DataFrame) -> DataFrame: ...


class HashedEmbedder:
    """The one that needs no service."""

    space = "local:1536"

    def embed(self, docs: DataFrame) -> DataFrame:
        return retrieval.features(docs)


def recall(docs: DataFrame, query: str, now: Column, *, limit: int = 12, index: search.Index | None = None) -> DataFrame:
    """(doc_id, score, rank) of docs (doc_id, text, created_at) for one question.

    An empty question gives the newest documents. One that names a time is answered from that window, by the statistics of
    all documents; an empty window gives nothing. ``index``: of docs; without it one is written for this call.
    """
    spark = docs.sparkSession
    asked = spark.createDataFrame([(1, query or "")], "query_id long, query string")
    scope = asked.select(D.time_scope(F.col("query"), now).alias("s")).first()["s"]
    inside = docs if scope is None else docs.where((F.col("created_at") >= F.lit(scope["from"])) & (F.col("created_at") < F.lit(scope["to"])))
    newest = tables.recent(inside.select("doc_id", "created_at"), limit, "created_at", "doc_id")
    recent = newest.select("doc_id", F.lit(0.0).alias("score"), F.row_number().over(retrieval.Window.orderBy(F.col("created_at").desc(), F.col("doc_id").desc())).alias("rank"))
    if not (query or "").strip():
        return recent
    if index is None:
        path = store.scratch(spark, "index")
        search.write_index(docs, path)
        index = search.Index(spark, path)
    found = search.hybrid(index, docs, asked, limit=limit, recency=docs.select("doc_id", "created_at"), scoped=scope is not None, allowed=None if scope is None else inside.select("doc_id"))
    found = store.written(found.select("doc_id", "score", "rank"), "found")
    return recent if found.isEmpty() else found


def evidence(docs: DataFrame, hits: DataFrame, query: str) -> DataFrame:
    """(doc_id, i, start, passage, score): of each hit the passage that is most like the question."""
    return search.passages(docs, hits, query)


def context_block(rows: list[dict], budget: int = 9000) -> str:
    """Numbered sources for an answer, evidence before text, each within its share of the budget."""
    share = max(400, budget // max(1, len(rows)))
    parts = []
    for n, r in enumerate(rows, 1):
        body = (r.get("passage") or r.get("text") or "")[:share]
        parts.append(f"[#{n}] {r.get('title') or 'Untitled'} ({r.get('site_name') or 'unknown'})\n{body}")
    return "\n\n".join(parts)[: max(budget, share)]


def citations(answer: str, rows: list[dict]) -> list[dict]:
    """The sources that an answer cites as [#n], in order."""
    import re

    numbers = dict.fromkeys(int(n) for n in re.findall(r"\[#(\d+)\]", answer))
    return [rows[n - 1] for n in numbers if 1 <= n <= len(rows)]


def first_json(text: str) -> dict | None:
    """The first JSON object in prose or a fence."""
    decoder = json.JSONDecoder()
    at = text.find("{")
    while at >= 0:
        try:
            return decoder.raw_decode(text, at)[0]
        except ValueError:
            at = text.find("{", at + 1)
    return None


class Conversation:
    """Turns of questions and answers; a follow-up is rewritten before it is searched."""

    def __init__(self, ask: Callable[[str], str], rewrite: Callable[[str, list[tuple[str, str]]], str] | None = None, turns: int = 6):
        self.answer, self.rewrite, self.most = ask, rewrite, turns
        self.turns: list[tuple[str, str]] = []

    @staticmethod
    def follows(question: str) -> bool:
        import re

        s = question.strip().lower()
        return len(s) < 30 or bool(re.search(T.FOLLOW_START, s, re.A) or re.search(T.FOLLOW_REFERENCE, s, re.A))

    def ask(self, question: str) -> str:
        """Only a turn that succeeds is remembered."""
        alone = self.rewrite(question, self.turns) if self.turns and self.rewrite and self.follows(question) else question
        said = self.answer(alone)
        self.turns = [*self.turns, (question, said)][-self.most :]
        return said


class Recent:
    """A few recent results, so that an equal question within the time is not asked again."""

    def __init__(self, size: int = 20, seconds: float = 300):
        self.size, self.seconds, self.held = size, seconds, OrderedDict()

    def get(self, key, make: Callable, now: float):
        if key in self.held and now - self.held[key][0] <= self.seconds:
            self.held.move_to_end(key)
            return self.held[key][1]
        value = make()
        self.held[key] = now, value
        self.held.move_to_end(key)
        while len(self.held) > self.size:
            self.held.popitem(last=False)
        return value
