"""From raw documents to token ids, in five stages.

Each stage works on all documents that the one before kept. The first four return the columns of
``documents``, whatever others there are and however they are named; the last encodes what is left.

Null, empty and blank texts are in no language and go in the first stage; so do texts that no language's model
foresees. Null ids are ids like any other, but one never names a group that has another. Of a group of near
duplicates those rows stay whose id is the least, and one row of a group without ids; repeated rows are near
duplicates of each other. Texts of any length are read whole. A text that loses all its words stays as an empty
one. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import byte_bpe, decontaminate, language_id, similar_texts, substring_dedup
from lodestone.llm.common import doc_mod5, table, written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in one of the languages of the corpus: those with a letter whose bits a byte are not far beyond what
    their language's texts of that size need."""
    model = language_id.train(docs, where=doc_mod5() != 0)
    return language_id.keep_identified(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: SimHash fingerprints of five-word shingles that share a block and are
    within 20 of 64 bits, and then an exact similarity of 0.8."""
    return similar_texts.one_of_each(docs, words=5, similarity=0.8)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take passages of 50 words or more that stand anywhere else out of the texts."""
    return substring_dedup.remove_repeats(docs, window=50)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that have a benchmark item's passage."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each text, and digests of the ids and of what they decode to."""
    return byte_bpe.bpe_encode(docs, TOKENIZER, public_tokenizers.PATTERN, with_ids=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("decontaminate", drop_benchmark_leaks),
    ("byte_bpe", encode),
]

#: None: no stage but the first filters of it can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
