import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def docs_frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    full = [(i, t, "en", "s", len(t or "")) if not isinstance(t, tuple) else t for i, t in enumerate(rows)]
    return spark.createDataFrame(full, schema)


#: Texts that every operator must take: null, empty, blank, no letters, ties, very long, odd bytes.
ODD = [None, "", "  \n\t ", "1234 5678", "same text here", "same text here", "é" * 3, "日本語 テスト です", "\x1c\x85\xa0x", "a", "x" * 50_000, "word " * 3_000, "😀 😀 😀 ok"]
