"""Every operator over a table with more columns, some of them named as its own inner ones, null ids, and repeated rows."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe, decontaminate, language_id, lm_score, quality_rules, similar_texts, simhash_dedup, substring_dedup, token_files, toxicity, warc
from lodestone.llm.common import doc_mod5

NAMES = ["key", "key__", "text__", "z__", "id", "id__", "part__", "lang__", "chunk", "chunk__", "rows", "held_out", "fold", "least", "root", "set", "keys", "row", "row__", "first", "text_key", "tie__", "node", "size__", "score", "n", "bits", "fingerprint", "component_id", "item_id", "doc", "all_runs", "check__", "none"]


@pytest.fixture(scope="module")
def docs(spark):
    prose = "the thing and other words of a text that goes on for a while with number {} in the middle of it and an end "
    rows = [(i, prose.format(i) * 3, "en" if i % 2 else "de") for i in range(24)] + [(3, prose.format(3) * 3, "en"), (None, None, None), (None, "", "en"), (40, prose.format(1) * 3, None)]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return base.select("*", *[F.lit(7).alias(n) for n in NAMES], F.create_map(F.lit("a"), F.lit(1)).alias("a map")).cache()


def test_maps_over_documents(docs):
    model = language_id.train(docs, where=doc_mod5() != 0)
    assert language_id.identify(docs, model).count() == 28
    assert language_id.keep_identified(docs, model).columns == docs.columns
    assert byte_bpe.bpe_encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 28
    assert quality_rules.quality_rules(docs).count() == 28
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), F.lit(1).alias("text"), F.lit(1).alias("fold"))
    assert toxicity.classify(docs, toxicity.fit(docs, labels, ["toxic"])).count() == 28


def test_groups_of_documents(docs):
    assert simhash_dedup.near_duplicates(docs).count() == 28
    assert similar_texts.similar_groups(docs).count() == 28
    kept = similar_texts.one_of_each(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < 28
    assert substring_dedup.substring_dedup(docs).count() == 28
    out = substring_dedup.remove_repeats(docs, window=50)
    assert out.columns == docs.columns and out.count() == 28


def test_models_and_files(spark, docs, tmp_path):
    assert lm_score.lm_scores(docs, doc_mod5() == 1, doc_mod5() == 0, order=3).count() == 28
    bench = spark.createDataFrame([(1, docs.where("doc_id = 5").first().text, 1)], "item_id long, text string, doc_id int")
    assert {r.doc_id for r in decontaminate.find_contamination(docs, bench).collect()} >= {5}
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and 5 not in {r.doc_id for r in clean.collect()}
    token_files.write_token_files(docs, str(tmp_path / "ids"), P.path("word_bpe_49k.json"))
    assert token_files.token_digests(spark, str(tmp_path / "ids")).count() == 28
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("https://a.org").alias("url"), F.col("text").alias("html"), "*").drop("text")
    warc.write_warc(pages, str(tmp_path / "warc"))
    assert warc.read_warc(spark, str(tmp_path / "warc")).count() == 28
