import random
from collections import Counter

from lodestone.llm import decontaminate as D

from .helpers import ODD, docs_frame, lower, words


def brute(texts, items, threshold=0.8):
    """All (document, item) with a window of weighted similarity ``threshold`` or more, and the best similarity."""
    out = {}
    for n, item in items:
        iw = words(lower(item))
        if not iw:
            continue
        m, k = len(iw), min(5, len(iw))
        a = Counter(tuple(iw[i : i + k]) for i in range(m - k + 1))
        for d, text in enumerate(texts):
            w = words(lower(text))
            for s in range(len(w) - m + 1):
                b = Counter(tuple(w[i : i + k]) for i in range(s, s + m - k + 1))
                j = sum((a & b).values()) / sum((a | b).values())
                if j >= threshold:
                    out[d, n] = max(j, out.get((d, n), 0))
    return out


def test_exact_and_edited_passages(spark):
    r = random.Random(7)
    word = lambda: f"w{r.randrange(5000)}"
    items = [(n, " ".join(word() for _ in range(r.randrange(12, 70)))) for n in range(12)] + [(50, "two words"), (51, ""), (52, None), (53, "A b C d e f")]
    texts = []
    for _ in range(60):
        passage = words(items[r.randrange(12)][1])
        for _ in range(r.randrange(3)):
            k = r.randrange(len(passage))
            passage[k : k + 1] = r.choice(([], [word()], [word(), word()]))
        text = [word() for _ in range(r.randrange(60))]
        k = r.randrange(len(text) + 1)
        texts.append(" ".join(text[:k] + [p.upper() for p in passage] + text[k:]))
    texts += ["here two WORDS stand", "a b c d e f", None, ""]
    docs = docs_frame(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for row in D.find_contamination(docs, bench).collect():
        got[row.doc_id, row.item_id] = max(row.similarity, got.get((row.doc_id, row.item_id), 0))
        assert words(texts[row.doc_id])[row.start_word : row.end_word]
    want = brute(texts, items)
    assert got == want and len(want) > 25
    kept = {r.doc_id for r in D.decontaminate(docs, bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in want}


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs = docs_frame(spark, ["one two three four five six seven", "x y z", *ODD])
    bench = spark.createDataFrame([(1, "one two three four five"), (2, "x y z"), (3, "x y z")], "item_id long, text string")
    rows = sorted(map(tuple, D.find_contamination(docs, bench).collect()))
    assert [x[:2] for x in rows] == [(0, 1), (1, 2), (1, 3)]
    monkeypatch.setattr(D, "MOST_ITEMS", 1)
    assert sorted(map(tuple, D.find_contamination(docs, bench).collect())) == rows
    assert D.find_contamination(docs, bench.limit(0)).count() == 0
    assert D.find_contamination(docs_frame(spark, []), bench).count() == 0
    assert D.decontaminate(docs, bench.limit(0)).count() == docs.count()


def brute_short(texts, items, threshold=0.8):
    """As brute, for documents shorter than the item: the whole document against it."""
    out = {}
    for n, item in items:
        iw = words(lower(item))
        k = min(5, len(iw))
        for d, text in enumerate(texts):
            w = words(lower(text))
            if k <= len(w) < len(iw):
                a, b = (Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1)) for x in (iw, w))
                j = sum((a & b).values()) / sum((a | b).values())
                if j >= threshold:
                    out[d, n] = j
    return out


def test_documents_shorter_than_the_item(spark):
    r = random.Random(11)
    items = [(n, " ".join(f"w{r.randrange(5000)}" for _ in range(size))) for n, size in enumerate((59, 59, 40, 24, 9, 9, 6, 5, 3))]
    texts = [" ".join(w for i, w in enumerate(words(items[0][1])) if i != 29)]  # 0.847
    for _, item in items:
        for cut in (1, 2, 5, 9):
            texts += [" ".join(words(item)[cut:]).upper(), " ".join(words(item)[:-cut]), " ".join(words(item)[:cut])]
    texts += [*ODD, items[2][1]]
    docs, bench = docs_frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    rows = D.find_contamination(docs, bench).collect()
    want = brute(texts, items) | brute_short(texts, items)
    assert {(x.doc_id, x.item_id): x.similarity for x in rows} == want
    assert len(brute_short(texts, items)) > 10 and round(want[0, 0], 3) == 0.847
    assert next((x.start_word, x.end_word) for x in rows if x.doc_id == 0) == (0, 58)
    assert {x.doc_id for x in D.decontaminate(docs, bench).collect()} == set(range(len(texts))) - {d for d, _ in want}
