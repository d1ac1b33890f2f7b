"""Record access and table maintenance over plain Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def get_many(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """One row for each of ids (ord, key), with nulls for the missing."""
    return ids.join(table, key, "left")


def exists_flags(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    known = table.select(key, F.lit(True).alias("found__")).distinct()
    return ids.join(known, key, "left").withColumn("exists", F.col("found__").isNotNull()).drop("found__")


def recent(table: DataFrame, n: int, at: str, key: str) -> DataFrame:
    return table.orderBy(F.col(at).desc(), F.col(key).desc()).limit(n)


def between(table: DataFrame, at: str, start, end, key: str, limit: int = 5000) -> DataFrame:
    """Newest first, from start (inclusive) to end (exclusive)."""
    return recent(table.where((F.col(at) >= start) & (F.col(at) < end)), limit, at, key)


def first_of_each(rows: DataFrame, key: str, *order: str) -> DataFrame:
    return rows.withColumn("n__", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("n__ = 1").drop("n__")


def new_rows(incoming: DataFrame, existing: DataFrame, key: str, *order: str) -> DataFrame:
    """incoming rows whose key is not known yet, the first of each."""
    return first_of_each(incoming.join(existing.select(key), key, "left_anti"), key, *order)


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with the rows of changes in place of those with their key; write it elsewhere, then swap."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def remove(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def reconcile(records: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """(key, state): orphans have no index entry, stale entries no record."""
    orphans = records.select(key).distinct().join(index.select(key), key, "left_anti").withColumn("state", F.lit("orphan"))
    return orphans.unionByName(index.select(key).distinct().join(records.select(key), key, "left_anti").withColumn("state", F.lit("stale")))


def pending_vectors(docs: DataFrame, vectors: DataFrame, space: str) -> DataFrame:
    """Documents (doc_id) without a non-zero vector in a space; vectors: doc_id, space, vec."""
    done = vectors.where((F.col("space") == space) & F.exists("vec", lambda x: x != 0)).select("doc_id")
    return docs.join(done, "doc_id", "left_anti")


def switch_space(vectors: DataFrame, space: str) -> DataFrame:
    """vectors of another space lose their values and keep their rows."""
    return vectors.withColumn("vec", F.when(F.col("space") == space, F.col("vec"))).withColumn("searchable", F.col("vec").isNotNull())


def compact(table: DataFrame, path: str, files: int) -> None:
    table.repartition(files).write.mode("overwrite").parquet(path)
