"""The thin queries of the training-data operators, and the SQL for those that SQL can express."""

from __future__ import annotations

import importlib.util

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language_id, lm_score, quality_rules, simhash_dedup, substring_dedup, token_files, toxicity, warc
from .byte_bpe import bpe_encode
from .common import doc_mod5, scratch, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, where=doc_mod5() != 0)
    held = docs.select("doc_id", "text", (doc_mod5() == 0).alias("held_out"))
    return language_id.identify(held, model, keep=("doc_id", "held_out"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), window=35)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "ids")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_files.token_digests(spark, path)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chain = toxicity.fit(docs, labels.withColumn("low_quality", 1 - labels["quality"]), ["low_quality", "toxic"])
    return toxicity.classify(docs, chain)


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"), doc_mod5() == 1, doc_mod5() == 0, order=3)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path, min_revisit_bytes=0)
    return warc.read_warc(spark, path).drop("url", "payload")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_files": op4_token_files,
    "op5_toxicity": op5_toxicity,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_lm_score": op8_lm_score,
    "op9_warc": op9_warc,
    "op10_quality_rules": op10_quality_rules,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_BITS = "array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', substr(sha1(payload), i, 1)) - 1), 4, '0')), '')"
_FIVE = " + ".join(f"{16 >> j} * substr(bits, 5 * k + {j + 1}, 1)::INT" for j in range(5))

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 win AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d), keyed AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM win),
 hits AS (SELECT doc_id, i FROM keyed WHERE s IN (SELECT s FROM keyed GROUP BY s HAVING count(*) > 1)),
 gone AS (SELECT DISTINCT doc_id, i + o AS p FROM hits, range(0, 35) r(o)),
 word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
 kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
 SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id)""",
    "op9_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages), b AS (SELECT *, {_BITS} AS bits, max(page_id) OVER (PARTITION BY payload) AS last FROM p)
 SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM b""",
}

if importlib.util.find_spec("corpus_pipeline"):

    def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
        import corpus_pipeline

        return corpus_pipeline.run(spark, sf_dir)

    QUERIES["pipeline"] = pipeline
