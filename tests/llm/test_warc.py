import base64
import hashlib

import zstandard

from lodestone.llm import warc
from lodestone.llm.queries import op9_warc


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, least=0):
    """By page id: the contract's columns."""
    out = {}
    for page, _, html in rows:
        size = len((html or "").encode())
        same = [p for p, _, h in rows if (h or "") == (html or "")]
        target = max(same, key=lambda p: (p is not None, p or 0))
        again = size >= least and page != target
        out[page] = (size, digest(html), "revisit" if again else "response", target if again else None)
    return out


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    got = {r.page_id: tuple(r)[1:] for r in op9_warc(spark, "/root/testdata/sf0.01").collect()}
    assert got == expected(rows)


def test_copies_nulls_and_sizes(spark, tmp_path):
    rows = [(1, "http://a", "x"), (2, None, "x"), (3, "u v\r\nw", None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1"), (None, "u", "x"), (7, "u", "long " * 100_000), (8, "u", "long " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for least in (0, 1, 10):
        path = str(tmp_path / f"w{least}")
        warc.write_warc(pages, path, min_revisit_bytes=least)
        back = warc.read_warc(spark, path).collect()
        assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back} == expected(rows, least)
        for r in back:
            if r.record_type == "response":
                assert bytes(r.payload).decode() == ({p: h for p, _, h in rows}[r.page_id] or "")
    assert len(back) == len(rows)


def test_a_record_is_found_by_its_frame_alone(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"{i} " * 20_000) for i in range(30)]
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    (bundle,) = (bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect())
    fields, block = warc.read_record(bundle, warc.record_urn(17, digest(rows[17][2])))
    assert fields["X-Page-ID"] == "17" and block.decode() == rows[17][2]
    assert len(warc.read_seek_table(bundle)) > 3
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(bundle, read_across_frames=True).read(1 << 30) for _ in range(1))
    assert whole.count(b"WARC/1.1\r\n") == 30


def test_no_rows_and_repeated_rows(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(none, str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0
    twice = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (0, "u", "x")], "page_id long, url string, html string")
    warc.write_warc(twice, str(tmp_path / "twice"))
    assert sorted((r.page_id, r.record_type) for r in warc.read_warc(spark, str(tmp_path / "twice")).collect()) == [(0, "revisit"), (1, "response"), (1, "response")]
