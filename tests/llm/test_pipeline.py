"""Each stage against a brute-force version on its own input."""

from collections import Counter

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from lodestone.llm import byte_bpe

from .helpers import words
from .test_decontaminate import brute as leaks
from .test_similar_texts import brute as groups

SF = "/root/testdata/sf0.001"


def without_repeats(texts, window):
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for text, w in zip(texts, split, strict=True):
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append(" ".join(x for i, x in enumerate(w) if i not in gone) if gone else text)
    return out


def test_stages(spark):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(corpus_pipeline.TOKENIZER), special_tokens={})
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "substring_dedup", "decontaminate", "byte_bpe"]
    before = docs.orderBy("doc_id").collect()
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, SF), name)
        after = out.orderBy("doc_id").collect()
        ids, texts = [r.doc_id for r in before], [r.text for r in before]
        if name == "language_id":
            lettered = {r.doc_id for r in before if any(map(str.isalpha, r.text or ""))}
            assert {r.doc_id for r in after} == lettered
        elif name == "simhash_dedup":
            assert [r.doc_id for r in after] == sorted({ids[k] for k in groups(texts).values()})
        elif name == "substring_dedup":
            assert [(r.doc_id, r.text) for r in after] == list(zip(ids, without_repeats(texts, 50), strict=True))
        elif name == "decontaminate":
            hit = {ids[d] for d, _ in leaks(texts, bench)}
            assert [r.doc_id for r in after] == [i for i in ids if i not in hit]
        else:
            assert {r.doc_id: r.ids for r in after} == {i: library.encode_ordinary(t) for i, t in zip(ids, texts, strict=True)}
        if name != "byte_bpe":
            assert out.columns == columns
        docs, before = out, after
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == {r.doc_id for r in before}
