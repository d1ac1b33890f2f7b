import random

import xxhash

from lodestone.llm import simhash_dedup as S
from lodestone.llm.queries import op6_simhash_dedup

from .helpers import ODD, docs_frame, lower, words


def brute_fingerprint(text, n=3):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] * bool(w)
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(ids, fps, radius=3):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((root(ids[a]), root(ids[b])))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_query_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = brute_components([r.doc_id for r in rows], fps)
    got = {r.doc_id: r for r in op6_simhash_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[r.doc_id].fingerprint == f"{fp:016x}" for r, fp in zip(rows, fps, strict=True))


def test_large_buckets_are_dealt_again_without_losing_links(spark, monkeypatch):
    r = random.Random(3)
    fps = set()
    for _ in range(6):
        base = r.getrandbits(64)
        for _ in range(60):
            x = base
            for _ in range(r.randrange(8)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    frame = spark.createDataFrame([(S._signed(x),) for x in fps], "fp long")
    want = brute_components(fps, fps)
    for most in (2048, 5):
        monkeypatch.setattr(S, "MOST", most)
        roots = {r.node % 2**64: r.root for r in S.components(S.links(frame)).collect()}
        groups = {}
        for x in fps:
            groups.setdefault(roots.get(x, x), set()).add(x)
        expected = {}
        for x, c in want.items():
            expected.setdefault(c, set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_blocks_cover_all_pairs_within_the_radius():
    masks, r = S.block_masks(), random.Random(4)
    for mask in (0, masks[7]):
        some = masks if not mask else S.finer_masks(mask)
        free = [b for b in range(64) if not mask >> b & 1]
        for _ in range(300):
            flips = sum(1 << b for b in r.sample(free, 3))
            assert any(not flips & m for m in some)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.root for r in S.components(edges).collect()} == {0}


def test_odd_rows(spark):
    docs = docs_frame(spark, ODD + [(None, "same text here", "en", "s", 1), (4, "same text here", "en", "s", 1)])
    got = S.near_duplicates(docs).collect()
    assert len(got) == len(ODD) + 2
    by = {r.doc_id: r for r in got}
    assert by[0].fingerprint == "0" * 16 and by[1].component_id == 0 and by[None].component_id == 4
    kept = S.one_of_each(docs).collect()
    assert {r.doc_id for r in kept} >= {0, 3, 4, None} and 5 not in {r.doc_id for r in kept}
    assert S.near_duplicates(docs_frame(spark, [])).count() == 0
