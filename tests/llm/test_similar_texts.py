import random

import numpy as np

from lodestone.llm import similar_texts as S

from .helpers import ODD, docs_frame, lower, words


def shingles(text, k=5):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(texts, t=0.8):
    sets = [shingles(x) for x in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if root[a] != root[b] and both >= t * either:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return dict(enumerate(root))


def corpus(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    texts = []
    for size in (6, 9, 14, 30, 60, 120, 250, 700):
        for _ in range(4):
            base = [word() for _ in range(size)]
            for _ in range(5):
                copy = list(base)
                for _ in range(r.randrange(1 + size // 30)):
                    copy[r.randrange(size)] = word()
                texts.append(" ".join(copy))
    return texts


def test_groups_against_brute_force(spark, monkeypatch):
    texts = [*corpus(1), *ODD]
    want = brute(texts)
    for most in (4096, 3):
        monkeypatch.setattr(S, "MOST", most)
        got = {r.doc_id: r.component_id for r in S.similar_groups(docs_frame(spark, texts)).collect()}
        assert got == want
    kept = {r.doc_id for r in S.one_of_each(docs_frame(spark, texts)).collect()}
    assert kept == set(want.values())


def test_the_standard_table_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r.component_id for r in S.similar_groups(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    assert got == brute([r.text for r in rows])


def test_no_rows_and_null_ids(spark):
    assert S.similar_groups(docs_frame(spark, [])).count() == 0
    docs = spark.createDataFrame([(None, "a b c"), (7, "A b c"), (7, "a b c")], "doc_id long, text string")
    assert [r.component_id for r in S.similar_groups(docs).collect()] == [7] * 3
    assert [r.doc_id for r in S.one_of_each(docs).collect()] .count(7) == 2


def joined(n, links):
    root = list(range(n))
    for a, b in links:
        root = [root[a] if r == root[b] else r for r in root]
    return {frozenset(k for k in range(n) if root[k] == r) for r in root}


def test_forest_is_exact_when_the_largest_component_changes():
    # a1, b1, a2, a3, b2, b3, b4: a3 and a2 are near a1, the b near b1, and only a2 and b2 link the two
    drift = [np.arange(s, s + 100, dtype="<u4") for s in (50, 80, 60, 49, 70, 81, 82)]
    links = S.forest(drift, 0.8)
    assert len(links) == 6 and joined(7, links) == {frozenset(range(7))}
    r = random.Random(5)
    for _ in range(300):
        sets = [np.arange(s, s + 100, dtype="<u4") for s in (r.randrange(200) for _ in range(r.randrange(2, 14)))]
        near = [(a, b) for a in range(len(sets)) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) - 1e-9]
        links = S.forest(sets, 0.8)
        assert joined(len(sets), links) == joined(len(sets), near)
        assert len(links) == len(sets) - len(joined(len(sets), near))


def test_one_of_each_with_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (3, "A b c d e f"), (5, "one two three four five six"), (9, "A B c d e f"), (9, "clean text of its own here"), (None, "x y z q r s"), (None, "X y z q r s"), (None, "x y z q r s"), (4, None)]
    kept = S.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    named = sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None)
    assert named == [(3, "A b c d e f"), (4, None), (5, "one two three four five six"), (9, "clean text of its own here")]
    assert [r.text.lower() for r in kept if r.doc_id is None] == ["x y z q r s"]


def test_blocks_are_simhashes():
    h = np.random.default_rng(3).integers(0, 2**63, 400, dtype=np.uint64)
    for n in (1, 2, 7, 30, 400):
        level = S.size_class(n, 0.8)
        groups, want = S.groups_of(level, 0.8), []
        for parting in range(-(-S.KEYS // groups)):
            group, bits = (x.tolist() for x in S.parted(h[:n], parting, groups))
            for g in range(min(groups, S.KEYS)):
                some = [b for b, k in zip(bits, group, strict=True) if k == g]
                want.append(sum(1 << k for k in range(64) if 2 * sum(b >> k & 1 for b in some) > len(some)))
        assert S.fingerprint(h[:n], level, 0.8).tolist() == want
        assert [k for k, _ in S.by_class(S.both_fingerprints(h[:n], 0.8), 0.8)] == [level, level + 1]


def test_near_groups_against_all_distances():
    r = random.Random(4)
    for _ in range(100):
        base = [r.getrandbits(192) for _ in range(3)]
        prints = [r.choice(base) ^ sum(1 << r.randrange(192) for _ in range(r.randrange(9))) for _ in range(r.randrange(2, 30))]
        near = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 6]
        rows = np.array([[p >> 64 * k & 2**64 - 1 for k in range(3)] for p in prints], np.uint64)
        got = {frozenset(g.tolist()) for g in S.near_groups(rows, 2)}
        assert got == {g for g in joined(len(prints), near) if len(g) > 1}


def test_similar_texts_are_within_the_radius():
    r, furthest = np.random.default_rng(6), 0
    for n in [*range(4, 60), 80, 150, 400, 1000] * 5:
        more = int(n / 4)
        x = int(r.integers(0, more + 1))
        h = r.integers(0, 2**63, n + more, dtype=np.uint64)
        a, b = (dict(S.by_class(S.both_fingerprints(s, 0.8), 0.8)) for s in (h[: n + x], np.concatenate([h[:n], h[n + x :]])))
        assert a.keys() & b.keys()
        for level in a.keys() & b.keys():
            assert ((a[level] == b[level]) & (a[level] != 0)).any()
            furthest = max(furthest, np.bitwise_count(a[level] ^ b[level]).sum() / len(a[level]))
    assert 6 < furthest <= S.RADIUS


def test_fingerprints_decide_what_is_compared(spark):
    r = random.Random(8)
    texts = []
    for size in (9, 14, 25, 40):
        base = [f"w{r.randrange(3000)}" for _ in range(size)]
        texts += [" ".join(base), " ".join(base).upper(), " ".join([*base, "more"])]
    at = lambda radius: {x.doc_id: x.component_id for x in S.similar_groups(docs_frame(spark, texts), radius=radius).collect()}
    assert at(0) == brute(texts, 1.0) != brute(texts)
    assert at(S.RADIUS) == brute(texts)
