"""Sinks: the search index, passages, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search

def write_index(docs: DataFrame, path: str, files: int | None = None) -> None:
    """The search index of docs; ``files``: how many the postings are dealt out to."""
    search.write_index(docs, path, files=files)


def write_chunks(docs: DataFrame, path: str) -> None:
    chunks = docs.select("doc_id", F.explode(T.chunk_text(F.col("text"))).alias("c")).select("doc_id", "c.*")
    chunks.write.mode("overwrite").parquet(path)


def export_json(memories: DataFrame, path: str) -> None:
    """One JSON object a row, without vectors."""
    memories.drop("vec", "embedding").write.mode("overwrite").json(path)
