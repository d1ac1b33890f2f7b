from datetime import datetime

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.plans import ingest, recall

FILLER = "Planning notes for the garden and the house went on for many lines about ordinary things. "
NEEDLE = "The vault combination is seventeen twenty nine marmalade."


def test_a_buried_fact_is_found_with_its_passage(spark):
    rows = [(1, FILLER * 160 + NEEDLE + " " + FILLER * 20), (2, "Marmalade recipes with oranges. " * 20), (3, FILLER * 30)]
    docs = spark.createDataFrame([(i, t, datetime(2026, 8, 4, i)) for i, t in rows], "doc_id long, text string, created_at timestamp")
    now = F.lit("2026-08-04 09:00:00").cast("timestamp")
    hits = recall.recall(docs, "vault combination marmalade", now)
    assert 1 in {r.doc_id for r in hits.collect()}
    (found,) = [r for r in recall.evidence(docs, hits, "vault combination marmalade").collect() if r.doc_id == 1]
    assert "seventeen" in found.passage and found.start > 10_000


def test_scopes(spark):
    docs = spark.createDataFrame([(1, "apples pears", datetime(2026, 8, 3, 12)), (2, "apples plums", datetime(2026, 8, 1, 12))], "doc_id long, text string, created_at timestamp")
    now = F.lit("2026-08-04 09:00:00").cast("timestamp")
    assert [r.doc_id for r in recall.recall(docs, "apples yesterday", now).collect()] == [1]
    assert recall.recall(docs, "apples today", now).count() == 0
    assert [r.doc_id for r in recall.recall(docs, "", now).orderBy("rank").collect()] == [1, 2]


def test_ingest_skips_what_is_unchanged(spark):
    page = "<html><title>T</title><body><nav>menu menu</nav><article><p>" + "A real sentence about something. " * 80 + "</p></article><div>other</div></body></html>"
    pages = spark.createDataFrame([("https://www.a.org/x", page), ("https://a.org/y", "<p>short</p>")], "url string, html string")
    none = ingest.records(pages).limit(0)
    stored, parts = ingest.ingest(pages, none)
    (row,) = stored.collect()
    assert row.site_name == "a.org" and "menu" not in row.text and row.text.startswith("A real sentence") and parts.count() > 1
    again, parts = ingest.ingest(pages, stored)
    assert again.count() == 1 and parts.count() == 0


def test_context_citations_and_json():
    rows = [{"title": "A", "site_name": "a.org", "passage": "x" * 9000}, {"title": "B", "text": "y"}]
    block = recall.context_block(rows, 2000)
    assert block.startswith("[#1] A (a.org)") and "[#2] B" in block and len(block) <= 2100
    assert recall.citations("see [#2], [#9] and [#2]", rows) == [rows[1]]
    assert recall.first_json('so {not} ```{"a": {"b": 1}}```') == {"a": {"b": 1}}


def test_conversation_and_cache():
    asked = []
    c = recall.Conversation(lambda q: asked.append(q) or f"re {q}", lambda q, turns: f"{turns[-1][0]} / {q}", turns=2)
    c.ask("which projects ran over budget in the last quarter")
    c.ask("why?")
    assert asked[1].endswith("/ why?") and len(c.turns) == 2
    r = recall.Recent(size=1, seconds=5)
    assert r.get("a", lambda: 1, 0) == 1 and r.get("a", lambda: 2, 4) == 1 and r.get("a", lambda: 3, 10) == 3


def test_pages_are_read_a_few_at_a_time(monkeypatch):
    pages = [None, "", *(f"<html><body><main>{'word ' * (10 + 7 * k)}</main><p>side</p></body></html>" for k in range(40)), "<p>" + "long " * 5000 + "</p>"]
    whole = ingest.read_pages(pa.array(pages, pa.string()), 300).to_pylist()
    sizes = []
    assert whole[0] is None and whole[2] == "word " * 9 + "word" and len(whole[-1]) == 300
    monkeypatch.setattr(ingest, "_AT_ONCE", 400)
    monkeypatch.setattr(ingest, "_content", lambda page, f=ingest._content: (sizes.append(page), f(page))[1])
    assert ingest.read_pages(pa.array(pages, pa.string()), 300).to_pylist() == whole and sizes == pages
    assert ingest.read_pages(pa.array([], pa.string()), 300).to_pylist() == []
