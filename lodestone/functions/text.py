"""Text functions as column expressions; those that need a procedure are Arrow-batched."""

from __future__ import annotations

import html as html_entities
import re

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# Words without weight in retrieval.
STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "if", "of", "at", "by", "for", "with",
    "to", "from", "in", "on", "is", "are", "was", "were", "be", "been", "being",
    "it", "its", "this", "that", "these", "those", "as", "so", "than", "then",
    "there", "here", "i", "you", "we", "they", "he", "she", "my", "your", "our",
    "do", "does", "did", "have", "has", "had", "will", "would", "can", "could",
    "should", "about", "into", "over", "up", "out", "no", "not",
]
# Scripts in which each character is a token (kana, Han, Hangul).
CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿가-힯"
WORD = r"[\p{L}\p{N}][\p{L}\p{N}'’·-]*"
# Phrases that ask for something, and the beginnings and references of a follow-up.
REQUEST = r"(?i)\b(can you|could you|would you|please (send|share|confirm|review|let me know)|let me know|any update|following up|reminder|deadline|rsvp|confirm)\b"
FOLLOW_START = r"^(why|how|when|where|who|what about|and|but|so|then|ok|okay)\b"
FOLLOW_REFERENCE = r"\b(it|that|this|those|these|they|them|its|their|the same|the second|the first|the other|instead|more about|tell me more|go on|elaborate|expand)\b"
# Honorifics and suffixes that names are compared without.
HONORIFIC = r"(?i)^(mr|mrs|ms|miss|dr|prof|professor|sir|madam|rev|hon)\.?\s+"
NAME_SUFFIX = r"(?i)\s+(jr|sr|ii|iii|iv|phd|md|esq)\.?$"
# Hosts that give a login wall, hosts and paths that a history is not kept of.
SKIP_HOSTS = [
    "mail.google.com", "drive.google.com", "docs.google.com", "calendar.google.com",
    "accounts.google.com", "classroom.google.com", "youtube.com", "youtu.be",
    "twitter.com", "x.com", "instagram.com", "facebook.com", "linkedin.com",
    "reddit.com", "netflix.com", "localhost",
]
# Pages of the browser itself, and hosts where people write to each other.
OWN_PAGES = "^(chrome://|chrome-extension://|edge://|about:|file://)"
CHAT_HOSTS = [
    "discord.com", "slack.com", "web.whatsapp.com", "teams.microsoft.com", "teams.live.com", "messenger.com", "web.telegram.org", "telegram.org",
    "mail.google.com", "chat.google.com", "outlook.office.com", "outlook.live.com", "signal.org", "element.io", "matrix.org", "groupme.com",
    "instagram.com", "twitter.com", "x.com", "linkedin.com",
]
JUNK_HOSTS = ["localhost", "newtab", "google.com", "duckduckgo.com", "bing.com"]
JUNK_PATH = r"(?i)/(login|signin|signup|logout|verify|otp|2fa|search|results)\b"
# Blocks without content, elements that end a line, named characters.
DROPPED_BLOCKS = ["script", "style", "noscript", "nav", "footer", "header", "aside", "svg", "form", "iframe"]
LINE_ENDS = r"(?i)</(p|div|li|h[1-6]|blockquote|article|section|tr)>"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&#x27;", "'")]


# A token is a CJK character of a word, or a run of two or more other characters of it; a run begins with a letter or
# digit, or right after a CJK character. A text without CJK characters has runs only.
_CJK = rf"[{CJK}&&[\p{{L}}\p{{N}}]]"
_REST = r"[\p{L}\p{N}'’·\-]"
_REST_CJK = rf"[\p{{L}}\p{{N}}'’·\-&&[^{CJK}]]"
TOKEN = rf"([\p{{L}}\p{{N}}]{_REST}+)"
TOKEN_CJK = rf"({_CJK}|(?:[\p{{L}}\p{{N}}&&[^{CJK}]]|(?<={_CJK})['’·-]){_REST_CJK}+)"


def _passed_over(rest: str) -> str:
    """What is a stopword as a whole matches without a group; a look at its length first, as most words are longer."""
    by_first: dict[str, list[str]] = {}
    for w in STOPWORDS:
        by_first.setdefault(w[0], []).append(w[1:])
    words = "|".join(f"{first}(?:{'|'.join(ends)})" for first, ends in by_first.items())
    return rf"(?=[a-z]{{1,{max(map(len, STOPWORDS))}}}(?!{rest}))(?:{words})(?!{rest})"


def _tokens(text: Column, plain: str, cjk: str) -> Column:
    s = F.lower(F.coalesce(text, F.lit("")))
    return F.when(s.rlike(f"[{CJK}]"), F.regexp_extract_all(s, F.lit(cjk), F.lit(1))).otherwise(F.regexp_extract_all(s, F.lit(plain), F.lit(1)))


def tokenize(text: Column) -> Column:
    """Lower-case words of two characters or more; each character of a CJK script is a word."""
    return _tokens(text, TOKEN, TOKEN_CJK)


def content_tokens(text: Column) -> Column:
    """Tokens that are no stopwords, repeats included."""
    return F.array_remove(_tokens(text, f"{_passed_over(_REST)}|{TOKEN}", f"{_passed_over(_REST_CJK)}|{TOKEN_CJK}"), "")


_WORDS, _HAS_CJK, _PARTS = regex.compile(WORD), regex.compile(f"[{CJK}]"), regex.compile(f"[{CJK}]|[^{CJK}]+")
_STOP = frozenset(STOPWORDS)


def content_words(text: str | None) -> list[str]:
    """``content_tokens`` of one text, for what is in Python already."""
    s = (text or "").lower()
    words = _WORDS.findall(s)
    if _HAS_CJK.search(s):
        words = [p for w in words for p in _PARTS.findall(w)]
        return [w for w in words if w not in _STOP and (len(w) > 1 or _HAS_CJK.match(w))]
    return [w for w in words if len(w) > 1 and w not in _STOP]


def bigrams(tokens: Column) -> Column:
    """Each token with the next. The tokens are a variable, so that they are computed once however often they are named."""
    n = lambda t: F.greatest(F.size(t) - 1, F.lit(0))
    pairs = F.transform(F.array(tokens), lambda t: F.zip_with(F.slice(t, F.lit(1), n(t)), F.slice(t, F.lit(2), n(t)), lambda a, b: F.concat(a, F.lit("_"), b)))
    return F.coalesce(pairs[0], F.array().cast("array<string>"))


def char_ngrams(token: Column, n: int = 4) -> Column:
    """All runs of n characters; the whole token if it has no more."""
    return F.when(F.length(token) <= n, F.array(token)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(token) - n + 1, F.lit(1))), lambda i: F.substr(token, i, F.lit(n))))


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits, over code points."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c.cast("long")) * 16777619, F.lit(4294967296)))


def clip_passage(text: Column, most: int = 900) -> Column:
    """The trimmed text, cut at its last space within ``most`` characters if that keeps 60 % of them."""
    s = F.trim(text)
    head = F.substring(s, 1, most + 1)
    last = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (last > 0.6 * most), last).otherwise(most)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.substr(s, F.lit(1), cut), F.lit("…")))


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", "")


def in_hosts(host: Column, hosts: list[str]) -> Column:
    """Whether host is one of hosts or below one."""
    out = F.lit(False)
    for h in hosts:
        out = out | (host == h) | host.endswith("." + h)
    return out


def fetchable(url: Column, kind: Column) -> Column:
    return url.rlike("(?i)^https?:") & ~kind.isin("gmail", "calendar", "classroom", "youtube") & ~in_hosts(host_of(url), SKIP_HOSTS)


def history_worthy(url: Column, title: Column) -> Column:
    host = host_of(url)
    return F.coalesce((F.length(title) >= 4) & url.rlike("(?i)^https?:") & (host != "") & ~host.isin(*JUNK_HOSTS) & ~url.rlike(JUNK_PATH), F.lit(False))


def is_trivial(title: Column, text: Column) -> Column:
    s = F.trim(text)
    return (F.length(s) < 500) | (s.startswith(F.trim(title)) & (F.length(s) < 3 * F.length(F.trim(title))))


def is_title_only(title: Column, summary: Column, light: Column) -> Column:
    return F.coalesce(light, F.lit(False)) | F.coalesce(summary == "", F.lit(True)) | (summary == title) | (F.length(summary) < 40)


def question_like(title: Column, summary: Column) -> Column:
    hay = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit("")))
    return hay.contains("?") | hay.rlike(REQUEST)


def has_content(title: Column, summary: Column) -> Column:
    """A summary that says more than the title: 40 characters or more."""
    said, named = F.trim(F.coalesce(summary, F.lit(""))), F.trim(F.coalesce(title, F.lit("")))
    return (F.length(said) >= 40) & (F.lower(said) != F.lower(named))


def capturable(url: Column, blocked: list[str] | None = None) -> Column:
    """A page of its own right, on no host that ends as one of those blocked."""
    host, out = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#:]+)", 1), ~url.rlike(OWN_PAGES)
    for suffix in blocked or []:
        out = out & ~host.endswith(suffix.strip())
    return F.coalesce(out & (url != ""), F.lit(False))


def chat_host(url: Column) -> Column:
    return F.coalesce(in_hosts(host_of(url), CHAT_HOSTS), F.lit(False))


def safe_link(url: Column) -> Column:
    """The url if it is one of the web, else null."""
    return F.when(F.trim(url).rlike("(?i)^https?://"), F.trim(url))


def short_name(author: Column) -> Column:
    """The name before an address in angles, else what is before the @."""
    s = F.trim(F.coalesce(author, F.lit("")))
    angled = F.regexp_extract(s, r'^"?([^"<]+?)"?\s*<', 1)
    name = F.trim(F.when(angled != "", angled).otherwise(F.substring_index(s, "@", 1)))
    return F.when(name == "", "Someone").otherwise(name)


def clip_middle(text: Column, most: int, head_share: float, mark: str, spare: int) -> Column:
    """The head and the tail of a long text with a mark between them; ``spare`` characters are left for it."""
    s, head = F.coalesce(text, F.lit("")), int(most * head_share)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, head), F.lit(mark), F.right(s, F.lit(most - head - spare))))


def clip_for_model(text: Column, most: int = 8000) -> Column:
    return clip_middle(text, most, 0.75, "\n\n…[content truncated]…\n\n", 32)


def clip_for_local(text: Column, most: int = 6000) -> Column:
    return clip_middle(text, most, 0.70, "\n…\n", 3)


def reminder_label(text: Column, key: Column, most: int = 90) -> Column:
    """A message in its own words: the whole, or the first clause that has the word ``key``, or the first; cut at a space."""
    s = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"^[A-Z][\w .'-]{0,28}:\s+", "")
    parts = F.split(s, r"(?<=[.!?])\s+")
    named = F.filter(parts, lambda p: F.contains(F.lower(p), F.lower(key)))
    chosen = F.coalesce(F.try_element_at(named, F.lit(1)), parts[0])
    head = F.substring(chosen, 1, most + 1)
    cut = F.when(F.instr(head, " ") > 0, F.length(head) - F.instr(F.reverse(head), " ")).otherwise(F.lit(0))
    shown = F.trim(F.substr(chosen, F.lit(1), F.when(cut > 40, cut).otherwise(most)))
    return F.when(F.length(s) <= most, s).when(F.length(chosen) <= most, F.trim(chosen)).otherwise(F.concat(shown, F.lit("…")))


def follow_up(query: Column) -> Column:
    """Short, or with the beginning or a reference of a follow-up; words end at all but ASCII letters, digits and _,
    which Java's own word boundary does not say beside other letters."""
    s = F.lower(F.trim(query))
    start, reference = (p.replace(r"\b", r"(?:(?<=[a-z0-9_])(?![a-z0-9_])|(?<![a-z0-9_])(?=[a-z0-9_]))") for p in (FOLLOW_START, FOLLOW_REFERENCE))
    return (F.length(s) < 30) | s.rlike(start) | s.rlike(reference)


def norm_name(name: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.trim(name), HONORIFIC, ""), NAME_SUFFIX, "")
    s = F.regexp_replace(F.regexp_replace(F.lower(s), "[‘’']", ""), r"[^a-z0-9\s-]", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def name_from_email(value: Column) -> Column:
    s = F.trim(value)
    angled = F.trim(F.regexp_extract(s, r'^"?([^"<]+?)"?\s*<[^>]+>$', 1))
    bare = F.regexp_extract(s, r"^([^@\s]+)@[^@\s]+$", 1)
    spoken = F.trim(F.regexp_replace(F.regexp_replace(bare, "[._-]+", " "), r"\d+", ""))
    return F.when(angled != "", angled).when(bare != "", spoken).when(s.contains("@") | (s == ""), None).otherwise(s)


def content_hash(title: Column, text: Column) -> Column:
    return F.sha1(F.concat(F.trim(title), F.lit("\n"), F.substring(F.trim(text), 1, 8000)).cast("binary"))


def html_title(page: Column) -> Column:
    return F.trim(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_to_text(page: Column) -> Column:
    """Readable text: blocks without content and tags go, block ends become line ends."""
    s = page
    for tag in DROPPED_BLOCKS:
        s = F.regexp_replace(s, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    s = F.regexp_replace(F.regexp_replace(s, LINE_ENDS, "\n"), r"(?i)<br\s*/?>", "\n")
    s = F.regexp_replace(s, "<[^>]+>", " ")
    for name, char in ENTITIES:
        s = F.replace(s, F.lit(name), F.lit(char))
    s = F.replace(s, F.lit("&amp;"), F.lit("&"))
    s = F.regexp_replace(F.regexp_replace(s, r"[\t\f\x0B ]+", " "), r"\n\s*\n\s*\n+", "\n\n")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"(?m)^[ \t]+", ""), r"(?m)[ \t]+$", ""))


# What a number of a character reference stands for where it is not the character of that number.
_REFERENCE = r"&#(?:[0-9]+|[xX][0-9a-fA-F]+);"
_BEYOND = 0x110000
_MEANT = {**html_entities._invalid_charrefs, **dict.fromkeys(html_entities._invalid_codepoints - html_entities._invalid_charrefs.keys(), ""), _BEYOND: "\ufffd"}


def _character(reference: Column) -> Column:
    """The character of a numeric reference such as &#233; or &#xe9;, as HTML reads it."""
    hexadecimal = reference.substr(F.lit(3), F.lit(1)).isin("x", "X")
    digits = F.regexp_replace(F.regexp_extract(reference, "^&#[xX]?0*([0-9a-fA-F]*);$", 1), "^$", "0")
    # more digits than any character's number has, whatever they are
    fits = F.length(digits) <= F.when(hexadecimal, 6).otherwise(7)
    number = F.conv(F.when(fits, digits).otherwise("0"), 16, 10).cast("int")
    number = F.when(~fits, _BEYOND).when(hexadecimal, number).otherwise(F.when(fits & ~hexadecimal, digits).otherwise("0").cast("int"))
    number = F.when((number > 0x10FFFF) | number.between(0xD800, 0xDFFF), _BEYOND).otherwise(number)
    meant = F.create_map(*[F.lit(x) for pair in _MEANT.items() for x in pair])
    drawn = F.decode(F.unhex(F.lpad(F.hex(F.when(number < _BEYOND, number).otherwise(0)), 8, "0")), "UTF-32")
    return F.coalesce(F.try_element_at(meant, number), drawn)


def character_references(text: Column) -> Column:
    """text with the characters that its decimal and hexadecimal references stand for."""
    between, found = F.split(text, _REFERENCE), F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    # the text before the first reference, then each character with the text after it
    parts = F.zip_with(found, F.slice(between, F.lit(2), F.greatest(F.size(found), F.lit(0))), lambda r, t: F.concat(_character(r), t))
    return F.when(text.rlike(_REFERENCE), F.concat(between[0], F.array_join(parts, ""))).otherwise(text)


def embed_text(title: Column, summary: Column, tags: Column, text: Column) -> Column:
    """Non-empty parts with blank lines between them."""
    part = lambda c: F.when(F.trim(c) != "", c)
    return F.concat_ws("\n\n", part(title), part(summary), part(F.concat_ws(", ", tags)), part(F.substring(text, 1, 2000)))


_BREAK = re.compile(r"\n[ \t]*\n|(?P<after>[.!?…][)\"'”’\]]*)\s+|\n")


def chunk_spans(text: str, target: int = 1100, most: int = 1800, least: int = 260, overlap: int = 180) -> list[tuple[int, int]]:
    """(start, end) of overlapping passages that cover the text and end where sentences or lines do.

    Pieces between breaks gather until ``target``; a passage begins with the pieces of the one
    before that fit into ``overlap``. A last passage under ``least`` joins its neighbour.
    """
    n = len(text or "")
    if n <= target:
        return [(0, n)] if n else []
    ends, at = [], 0
    while m := _BREAK.search(text, at):
        ends.append(m.end())
        at = m.end()
    pieces, begin = [], 0
    for end in [e for e in ends if e < n] + [n]:
        while end - begin > most:
            space = text.rfind(" ", begin, begin + most + 1)
            cut = space + 1 if space > begin else begin + most
            pieces.append((begin, cut))
            begin = cut
        if end > begin:
            pieces.append((begin, end))
            begin = end
    out, first, size = [], 0, 0
    for k, (a, b) in enumerate(pieces):
        if size and size + b - a > target:
            out.append([pieces[first][0], a])
            carried, back = 0, k
            while back > first and carried + pieces[back - 1][1] - pieces[back - 1][0] <= overlap:
                back -= 1
                carried += pieces[back][1] - pieces[back][0]
            first, size = back, carried
        size += b - a
    out.append([pieces[first][0], n])
    if len(out) > 1 and out[-1][1] - out[-1][0] < least:
        last = out.pop()
        out[-1][1] = last[1]
    return [tuple(x) for x in out]


_CHUNKS = ArrayType(StructType([StructField("i", IntegerType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("text", StringType())]))


@F.pandas_udf(_CHUNKS)
def chunk_text(text: pd.Series) -> pd.Series:
    return text.map(lambda s: [{"i": i, "start": a, "end": b, "text": s[a:b]} for i, (a, b) in enumerate(chunk_spans(s or ""))])
