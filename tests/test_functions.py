"""Functions and operators against values worked out by hand, on the cases the standard tables lack."""

import html
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import queries as engine
from lodestone.functions import commitments as C
from lodestone.functions import text as T
from lodestone.functions import time as D
from lodestone.functions import vector as V
from lodestone.functions.time import parse_when
from lodestone.operators import activity, retrieval, tables
from lodestone.sources import readers, sinks
from lodestone.streaming import streams

WEDNESDAY = datetime(2026, 3, 4, 10, 0)


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("It's Windows11の設定 o’k café a-b x", ["it's", "windows11", "の", "設", "定", "o’k", "café", "a-b"]),
        ("Привет мир", ["привет", "мир"]),
        ("Ελλάδα 2 a", ["ελλάδα"]),
        (None, []),
        ("한국어", ["한", "국", "어"]),
    ],
)
def test_tokens_of_scripts(spark, text, tokens):
    assert one(spark, T.tokenize(F.col("t")), t=("string", text)) == tokens


def test_hash_is_fnv1a(spark):
    assert one(spark, T.fnv1a(F.col("t")), t=("string", "abc")) == 0x1A47E90B


def test_vectors(spark):
    assert one(spark, V.l2_normalize(F.col("v")), v=("array<double>", [3.0, 4.0])) == pytest.approx([0.6, 0.8])
    assert one(spark, V.l2_normalize(F.col("v")), v=("array<double>", [0.0, 0.0])) == [0, 0]
    assert one(spark, V.dot(F.col("v"), F.array(F.lit(1.0))), v=("array<double>", [3.0, 4.0])) == 0
    v = [float(np.sin(i * 0.11)) for i in range(64)]
    got = one(spark, V.quantize(F.col("v")), v=("array<double>", v))
    assert np.abs(np.array(got.q) * got.scale - v).max() <= got.scale / 2 + 1e-12
    assert one(spark, V.quantize(F.col("v")), v=("array<double>", [-127.0, 2.5, -2.5])).q == [-127, 3, -2]


def test_names(spark):
    assert one(spark, T.norm_name(F.col("t")), t=("string", "Dr. Ada O'Neil Jr.")) == "ada oneil"
    assert one(spark, T.name_from_email(F.col("t")), t=("string", '"Lee, Ann" <a@b.c>')) == "Lee, Ann"
    assert one(spark, T.name_from_email(F.col("t")), t=("string", "x y@z")) is None


def test_html(spark):
    page = "<html><head><title> A &amp; B</title><script>x<p></script></head><body><nav>menu</nav><p>One&nbsp;two &#233; &#x41;</p><p>Three<br/>four</p></body></html>"
    text = one(spark, T.character_references(T.html_to_text(F.col("t"))), t=("string", page))
    assert [line.strip() for line in text.splitlines()][-3:] == ["A & B One two é A", "Three", "four"] and "menu" not in text and "x<p>" not in text


def test_chunks_cover_the_text():
    sentence = "The quick brown fox jumps over the lazy dog again. "
    for text in (sentence * 100, "x" * 5000, ("line\n" * 500), sentence * 22 + "End.", "", "short"):
        spans = T.chunk_spans(text)
        assert (spans == []) == (text == "")
        if spans:
            assert spans[0][0] == 0 and spans[-1][1] == len(text)
            assert all(b[0] <= a[1] and b[1] > a[1] for a, b in zip(spans, spans[1:], strict=False))
            assert all(b - a <= 1800 + 180 + 260 for a, b in spans)


@pytest.mark.parametrize(
    ("text", "at"),
    [
        ("tomorrow at 3pm", datetime(2026, 3, 5, 15)),
        ("day after tomorrow", datetime(2026, 3, 6, 9)),
        ("tonight", datetime(2026, 3, 4, 20)),
        ("by eod", datetime(2026, 3, 4, 17)),
        ("end of the week", datetime(2026, 3, 6, 17)),
        ("2026-04-01 at noon", datetime(2026, 4, 1, 12)),
        ("3/2", datetime(2027, 3, 2, 9)),
        ("March 10th 14:30", datetime(2026, 3, 10, 14, 30)),
        ("on friday at 5", datetime(2026, 3, 6, 17)),
        ("wednesday", datetime(2026, 3, 11, 9)),
        ("next friday", datetime(2026, 3, 13, 9)),
        ("this weekend", datetime(2026, 3, 7, 9)),
        ("in 2 hours", datetime(2026, 3, 4, 12)),
        ("at 9am", datetime(2026, 3, 5, 9)),
        ("nothing here", None),
    ],
)
def test_times(text, at):
    found = parse_when(text, WEDNESDAY)
    assert (found and found["at"]) == at


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("don't forget the essay is due tomorrow at 5pm", True),
        ("hackathon ending tmrw at 12pm", True),
        ("the meeting was moved to friday at 3pm", True),
        ("did you see the game last night", False),
        ("I might go to the game on saturday", False),
        ("the 3pm showing felt great", False),
        ("https://x.y tomorrow at 3pm submit", False),
        ("we went home on monday", False),
    ],
)
def test_commitments(text, found):
    assert (C.detect(text, WEDNESDAY) is not None) == found


def test_aliases_fold_in_order_only_when_one_person_fits(spark):
    rows = [(1, 0, "ann", "person"), (2, 0, "ann lee", "person"), (3, 0, "ann", "person"), (4, 0, "ann ray", "person"), (5, 0, "ann", "person"), (6, 0, "ann", "concept")]
    got = {r.mem_id: r.entity for r in activity.fold_aliases(spark.createDataFrame(rows, "mem_id long, ord int, norm string, kind string")).collect()}
    assert got == {1: "ann", 2: "ann lee", 3: "ann lee", 4: "ann ray", 5: "ann", 6: "ann"}


def test_topics_part_a_session(spark):
    rows = [(1, k, k, [1.0, 0.0] if k < 5 else [0.0, 1.0]) for k in range(10)] + [(2, k, 100 + k, None) for k in range(9)]
    got = {r.item: r.part for r in activity.split_by_topic(spark.createDataFrame(rows, "session long, pos long, item long, vec array<double>")).collect()}
    assert [got[k] for k in range(10)] == [0] * 5 + [1] * 5 and {got[100 + k] for k in range(9)} == {0}


def test_references_are_read_without_python(spark):
    number = re.compile(r"&#([0-9]+|[xX][0-9a-fA-F]+);")
    codes = [*range(0, 300), 0x3B1, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000, 9_999_999, 10_000_000, 2**40]
    texts = [f"a&#{c};b &#x{c:x};&#X{c:X};&#000{c};" for c in codes] + [None, "", "no reference", "&#;", "&#x;", "&#12", "&&#65;&#66;", "&#65;", "&#xg;", "&#٣;", "&amp;#65;", "&#38;#65;"]
    table = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.character_references(F.col("t")).alias("got"))
    assert "Python" not in table._jdf.queryExecution().executedPlan().toString()
    for r in table.collect():
        assert r.got == (r.t if r.t is None else number.sub(lambda m: html.unescape(m[0]), r.t))
    long = f"a&#{'9' * 5000};b&#{'0' * 5000}65;"  # Python would not read such a number
    assert spark.createDataFrame([(long,)], "t string").select(T.character_references(F.col("t"))).first()[0] == "a\ufffdbA"


def test_shared_values_without_a_group_for_each_value(spark):
    sets = {1: ["x"], 2: ["x", "y"], 3: ["y", "z"], 4: [], 5: ["x"], 6: ["z"], 50: ["x", "z"], 100: ["x"], 150: [], 200: ["q"]}
    e = spark.createDataFrame(list(sets.items()), "user_id long, s array<string>").repartition(3)
    asked = e.where("user_id % 50 = 0").select(F.col("user_id").alias("a"), "s")
    df = activity.shared(e.select(F.col("user_id").alias("b"), "s"), asked, block=1)
    assert "SortMergeJoin" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "BroadcastNestedLoopJoin" in plan
    got = [tuple(r) for r in df.collect()]
    want = {(a, b, len(set(sets[a]) & set(sets[b]))) for a in (50, 100, 150, 200) for b in sets if a != b and set(sets[a]) & set(sets[b])}
    assert len(got) == len(want) and set(got) == want


def test_bigrams_compute_their_tokens_once(spark):
    texts = ["alpha beta gamma alpha", "alpha", "", None, "日本 alpha"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.bigrams(T.content_tokens(F.col("t"))).alias("b"))
    for r in df.collect():
        words = T.content_words(r.t)
        assert r.b == [f"{a}_{b}" for a, b in zip(words, words[1:], strict=False)]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 2


def test_what_to_revisit_is_scored_once_and_limited_before_it_is_dealt_out(spark):
    kinds = [None, "", "a", "b", "b", "a", "", None]
    rows = [(k, datetime(2024, 1, 1 + k % 20), "web", kinds[k % 8], 9.0 + k % 13, None) for k in range(300)]
    table = spark.createDataFrame(rows, "mem_id long, created_at timestamp, source_kind string, site string, stability double, last_resurfaced_at timestamp").repartition(5)
    now = F.lit("2024-01-25 00:00:00").cast("timestamp")
    age = D.days_between(F.col("created_at"), now)
    scored = [(-r.x, r.mem_id, r.site) for r in table.select("mem_id", "site", F.round(activity.resurface_score(age, F.col("stability")), 9).alias("x")).collect() if r.x > 0]
    best = {s: min(r for r in scored if r[2] == s) for s in "ab"}
    want = sorted([r for r in scored if not r[2]] + list(best.values()))
    df = activity.due_for_resurface(table, now, limit=len(want) + 5)
    assert [(-r.score, r.mem_id, r.site) for r in df.collect()] == want and len(want) > 50
    plan = df._jdf.queryExecution()
    assert "WindowGroupLimit" in plan.optimizedPlan().toString()
    df = engine.QUERIES["resurface"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") < 10


def split_in_memory(vectors, cut=0.42, run=3, least=8):
    part, parts, total, size = 0, [], None, 0
    for k, v in enumerate(vectors):
        x = None if v is None else np.asarray(v, np.float64)
        length = 0.0 if total is None else float(np.linalg.norm(total))
        alike = 1.0 if x is None or length == 0 else float(x @ total) / length
        if len(vectors) >= least and size >= run and len(vectors) - k >= run and alike < cut:
            part, total, size = part + 1, None, 0
        if x is not None:
            total = x if total is None else total + x
        size += 1
        parts.append(part)
    return parts


def test_topics_are_split_as_a_stream_of_batches(spark):
    random = np.random.default_rng(5)
    sessions = {s: [None if random.random() < 0.1 else random.normal(size=4).tolist() for _ in range(n)] for s, n in enumerate([1, 2, 3, 7, 8, 9, 10, 11, 40, 5, 200, 8])}
    rows = [(s, k, 1000 * s + k, v) for s, vs in sessions.items() for k, v in enumerate(vs)]
    want = {1000 * s + k: p for s, vs in sessions.items() for k, p in enumerate(split_in_memory(vs))}
    assert max(want.values()) > 10
    table = spark.createDataFrame(rows, "session long, pos long, item long, vec array<double>").repartition(3)
    plan = activity.split_by_topic(table)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for batch in (1, 2, 7, 50, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        try:
            assert {r.item: r.part for r in activity.split_by_topic(table).collect()} == want
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_diversity_moves_a_near_copy_down():
    order = retrieval.mmr_order(np.array([1.0, 0.99, 0.8]), np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]]), 0.5)
    assert order == [0, 2, 1] and retrieval.mmr_order(np.array([]), np.zeros((0, 2))) == []


def test_vectors_of_other_spaces_are_not_searched(spark):
    v = spark.createDataFrame([(1, "a:2", [1.0, 0.0]), (2, "b:2", [1.0, 0.0]), (3, "a:2", [0.0, 0.0])], "doc_id long, space string, vec array<double>")
    docs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc_id long")
    assert sorted(r.doc_id for r in tables.pending_vectors(docs, v, "a:2").collect()) == [2, 3, 4]
    assert [r.searchable for r in tables.switch_space(v, "a:2").orderBy("doc_id").collect()] == [True, False, True]


def test_upsert_and_remove(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    assert sorted(map(tuple, tables.upsert(t, spark.createDataFrame([(2, "c"), (3, "d")], "id long, x string"), "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert tables.remove(t, t.where("id = 1"), "id").count() == 1


def test_bookmarks_and_history(spark):
    tree = [{"title": "Bar", "children": [{"title": "Dev", "children": [{"title": "Spark", "url": "https://spark.apache.org/", "dateAdded": 5}]}, {"title": "js", "url": "javascript:1"}]}]
    nodes = spark.createDataFrame(list(readers.bookmark_nodes(tree)), readers.BOOKMARK_NODE)
    (row,) = readers.bookmarks(nodes).collect()
    assert row.site_name == "spark.apache.org" and '"folder":"Bar / Dev"' in row.extra
    visits = [("https://a.org/x", "A page", 1, 2, 0), ("https://a.org/x", "Again", 2, 1, 0), ("https://a.org/login", "Log in", 1, 1, 0), ("http://localhost/", "local", 1, 1, 0), ("https://b.org", "abc", 1, 1, 0)]
    got = readers.history(spark.createDataFrame(visits, "url string, title string, last_visit_ms long, visit_count int, typed_count int")).collect()
    assert [(r.url, r.title) for r in got] == [("https://a.org/x", "A page")]


def test_local_files_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# hello")
    (tmp_path / "in" / "b.html").write_text("<title>T</title><p>body</p>")
    (tmp_path / "in" / "c.docx").write_text("no")
    got = {r.title: r.text for r in readers.local_files(spark, str(tmp_path / "in")).collect()}
    assert set(got) == {"a.md", "T"} and "body" in got["T"]
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, None)], "doc_id long, text string")
    sinks.write_index(docs, str(tmp_path / "index"), 2)
    assert {(r.term, r.tf) for r in spark.read.parquet(str(tmp_path / "index/postings")).collect()} == {("alpha", 1), ("beta", 2)}
    sinks.write_chunks(docs, str(tmp_path / "chunks"))
    sinks.export_json(docs, str(tmp_path / "json"))
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 1 and spark.read.json(str(tmp_path / "json")).count() == 2


def test_streams(spark, tmp_path):
    source = str(tmp_path / "messages")
    rows = [("don't forget the essay is due tomorrow at 5pm", WEDNESDAY), ("don't forget the essay is due tomorrow at 5pm", WEDNESDAY), ("hello there my friend", WEDNESDAY)]
    spark.createDataFrame(rows, "text string, at timestamp").write.parquet(source)
    stream = spark.readStream.schema("text string, at timestamp").parquet(source)
    q = streams.reminders(streams.commitments(stream)).writeStream.format("memory").queryName("reminders_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r.due for r in spark.table("reminders_out").collect()] == [datetime(2026, 3, 5, 17)]
    events = str(tmp_path / "events")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(events)
    stream = spark.readStream.schema(spark.read.parquet(events).schema).parquet(events)
    q = streams.stream_sessions(stream.withColumn("ts", F.col("ts").cast("timestamp"))).writeStream.format("memory").queryName("sessions_out").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("sessions_out").agg(F.sum("n")).first()[0] == 1000


def test_reminder_table(spark):
    now = F.lit("2026-03-04 10:00:00").cast("timestamp")
    t = spark.createDataFrame([(1, datetime(2026, 3, 4, 9), None), (2, datetime(2026, 3, 5), None), (3, datetime(2026, 2, 1), datetime(2026, 2, 1))], "id long, at timestamp, fired_at timestamp")
    assert [r.id for r in streams.due_reminders(t, now).collect()] == [1]
    assert sorted(r.id for r in streams.prune_reminders(t, now).collect()) == [1, 2]
    assert streams.snooze(t, t.where("id = 1").select("id"), now).where("id = 1").first().at == datetime(2026, 3, 4, 10, 10)


@pytest.mark.parametrize(
    ("text", "at"),
    [
        ("please submit by 0000-01-01", None),
        ("submit on 9999-99-01", None),
        ("due 9999-12-31", datetime(9999, 12, 31, 9)),
        ("5 of march or april 3", datetime(2026, 4, 3, 9)),
        ("13/40 is no date, but friday is", datetime(2026, 3, 6, 9)),
        ("2/31", datetime(2027, 3, 3, 9)),
        ("sept. 5th at midnight", datetime(2026, 9, 5, 0)),
        ("due 12/5/26 3.30 p.m.", datetime(2026, 12, 5, 15, 30)),
        ("in an hour", datetime(2026, 3, 4, 11)),
    ],
)
def test_dates_of_the_calendar_and_others(spark, text, at):
    found = parse_when(text, WEDNESDAY)
    assert (found and found["at"]) == at
    C.detect(f"please submit {text}", WEDNESDAY)


def test_captures_and_candidates_of_a_table(spark):
    day = lambda h, m=0: datetime(2026, 3, 4, h, m)
    visits = spark.createDataFrame([("a", day(1)), ("a", day(1, 5)), ("a", day(6)), ("b", day(1)), ("b", day(1))], "url string, at timestamp")
    assert sorted((r.url, r.at) for r in streams.captures(visits).collect()) == [("a", day(1)), ("a", day(6)), ("b", day(1))]
    said = spark.createDataFrame([("hello there my friend", day(1)), ("hello there my friend", day(1, 30)), ("hello there my friend", day(9)), ("short", day(1))], "text string, at timestamp")
    assert [r.at for r in streams.message_candidates(said).orderBy("at").collect()] == [day(1), day(9)]


def test_impossible_dates_do_not_stop_a_job(spark):
    said = spark.createDataFrame([("please submit by 0000-01-01", WEDNESDAY), ("please submit by 9999-99-01", WEDNESDAY), ("please submit by friday at 5pm", WEDNESDAY)], "text string, at timestamp")
    assert [r.due for r in streams.commitments(said).collect()] == [datetime(2026, 3, 6, 17)]


def test_engagement_by_visits(spark):
    at = lambda h: datetime(2026, 3, 4, h)
    rows = [("a", at(1), 3000, 0.2), ("a", at(1), 2000, 0.9), ("a", at(5), 100, 1.0), ("b", at(1), 50, 0.1)]
    got = streams.engagement(spark.createDataFrame(rows, "url string, at timestamp, active_ms long, scroll_pct double")).collect()
    assert [(r.url, r.dwell_ms, r.scroll_pct) for r in got] == [("a", 5000, 0.9)]


def test_reminder_timers(spark, tmp_path):
    at = lambda h, m=0: datetime(2026, 3, 4, h, m)
    schema = "id long, action string, what string, due timestamp, seen timestamp"
    batches = [
        [(1, "set", "essay", at(12), at(10)), (2, "set", "call", at(12), at(10)), (3, "set", "late", at(9), at(10))],
        [(2, "cancel", None, None, at(11)), (1, "snooze", None, None, at(11, 55))],
        [(9, "set", "far", at(23), at(12, 30))],
        [(8, "set", "far", at(23), at(12, 40))],
    ]
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = str(tmp_path / "requests")
        found = streams.fired(spark.readStream.schema(schema).parquet(source + "*"))
        q = None
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}{k}")
            q = q or found.writeStream.format("memory").queryName("fired_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
            q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.unset(key)
    assert sorted((r.id, r.what, r["at"]) for r in spark.table("fired_out").collect()) == [(1, "essay", at(12, 5)), (3, "late", at(9))]


def one(spark, value, kind, *columns):
    return tuple(spark.createDataFrame([(value,)], f"v {kind}").select(*columns).first())


def test_labels_and_names(spark):
    v = F.col("v")
    said = "Jamie: the essay   is due. Bring it on friday at noon, with all of the notes that we made together in the library, please."
    assert one(spark, said, "string", T.reminder_label(v, F.lit("friday")))[0] == "Bring it on friday at noon, with all of the notes that we made together in the library,…"
    assert one(spark, "Ann: short one", "string", T.reminder_label(v, F.lit("x")))[0] == "short one"
    assert [one(spark, x, "string", T.short_name(v))[0] for x in ('"Lee, Ann" <ann@lee.org>', "ann.lee@x.org", " ", None)] == ["Lee, Ann", "ann.lee", "Someone", "Someone"]
    assert [one(spark, x, "string", T.chat_host(v))[0] for x in ("https://app.slack.com/a", "https://www.x.com/", "https://box.com", None)] == [True, True, False, False]
    assert one(spark, "abcdefghij" * 10, "string", F.length(T.clip_middle(v, 50, 0.5, "--", 2)))[0] == 50
    assert [one(spark, x, "string", D.summary_scope(v))[0] for x in ("Give me a daily summary", "what did I do yesterday", "yesterday's recap please", "apples")] == [0, 1, 1, None]
    assert [one(spark, x, "string", T.safe_link(v))[0] for x in ("javascript:alert(1)", " HTTPS://a.org ", None)] == [None, "HTTPS://a.org", None]


def test_times_as_text(spark):
    v, at = F.col("v"), F.lit("2026-03-04 10:00:00").cast("timestamp")
    both = lambda ts: one(spark, ts, "timestamp", D.countdown(v, at), D.ago_or_in(v, at), D.ago_or_in(v, at, weeks=30), D.day_ago(v, at), D.how_far(v, at))
    assert both(datetime(2026, 3, 4, 10, 20)) == ("in 20 min", "in 20 min", "in 20 min", "today", "in 20 mins")
    assert both(datetime(2026, 3, 4, 11, 10))[0] == "in 1 hour"
    assert [both(datetime(2026, 3, d, 10))[0] for d in (5, 7, 13)] == ["tomorrow", "in 3 days", "Fri, Mar 13"]
    assert both(datetime(2026, 2, 17, 10)) == ("now", "Feb 17, 2026", "2w ago", "15 days ago", "15 days ago")
    assert both(datetime(2025, 3, 4, 10))[3:] == ("1 years ago", "12 months ago")
    assert one(spark, datetime(2026, 3, 4, 9, 58, 30), "timestamp", D.ago_or_in(v, at, minute="m"))[0] == "1m ago"
    assert one(spark, 17, "int", D.spoken_clock(v, F.lit(5)), D.spoken_clock(F.lit(0), F.lit(0))) == ("5:05pm", "12am")


def test_exports_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, "alpha", [0.5]), (2, None, None)], "id long, text string, vec array<double>")
    sinks.export_json(rows, str(tmp_path / "out"))
    assert sorted((r.id, r.text) for r in readers.exported(spark, str(tmp_path / "out")).collect()) == [(1, "alpha"), (2, None)]
    (tmp_path / "one.json").write_text('{"version": 2,\n "memories": [{"id": 7, "text": "x"}]}')
    assert [(r.id, r.text) for r in readers.exported(spark, str(tmp_path / "one.json")).collect()] == [(7, "x")]


def test_episodes_and_entities_from_items(spark):
    at = lambda h, m=0: datetime(2026, 3, 4, h, m)
    now = F.lit("2026-03-04 20:00:00").cast("timestamp")
    near, far = [1.0, 0.0], [0.0, 1.0]
    rows = [(k, 1, at(9, 3 * k), "garden notes", "a.org", "web", None, near if k < 5 else far) for k in range(10)] + [(20 + k, 1, at(15, k), "x", "b.org", "web", "tag", None) for k in range(3)]
    rows += [(30, 1, at(23), "later", "b.org", "web", None, None), (31, 1, at(18), "alone", "b.org", "web", None, None)]
    items = spark.createDataFrame(rows, "mem_id long, user_id long, created_at timestamp, title string, site string, kind string, tag string, vec array<double>")
    episodes, members = activity.rebuild_episodes(items, now)
    assert sorted((r.n, r.name) for r in episodes.collect()) == [(3, "tag"), (5, "garden · a.org"), (5, "garden · a.org")]
    assert sorted(r.mem_id for r in members.collect()) == [*range(10), 20, 21, 22]
    assert [r.n for r in activity.latest_episodes(episodes, 1).collect()] == [3]
    people = [(1, "Ann Lee"), (2, "Ann"), (3, "Bob Ray"), (4, "Bob Fox"), (5, "Bob")]
    mentions = spark.createDataFrame([(i, at(1, i), "web", n, [], None, None, "", ["news"] if i < 3 else []) for i, n in people], "mem_id long, ts timestamp, source_kind string, author string, attendees array<string>, channel string, course string, site_name string, tags array<string>")
    entities, links = activity.rebuild_entities(mentions)
    got = {(r.kind, r.norm): (r.aliases, r.n) for r in entities.collect()}
    assert got == {("person", "ann lee"): (["ann"], 2), ("person", "bob ray"): ([], 1), ("person", "bob fox"): ([], 1), ("person", "bob"): ([], 1), ("concept", "news"): ([], 2)}
    assert links.where("norm = 'ann lee'").count() == 2
    asked = spark.createDataFrame([(1, "Ann"), (2, "Bob Ray"), (3, "none")], "query_id long, name string")
    assert sorted((r.query_id, r.norm, r.how) for r in activity.find_entity(entities, asked).collect()) == [(1, "ann lee", 1), (2, "bob ray", 0)]
    shown = spark.createDataFrame([(1,)], "mem_id long")
    marked = activity.mark_resurfaced(mentions.select("mem_id", F.lit(None).cast("timestamp").alias("last_resurfaced_at")), shown, now)
    assert [r.mem_id for r in marked.where("last_resurfaced_at is not null").collect()] == [1]
