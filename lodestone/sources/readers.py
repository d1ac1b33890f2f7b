"""Sources: each gives items (mem_id, url, title, text, source_kind, site_name, created_at, extra) from files.

Web services are not called here: their adapters take the listings that an export or a collector wrote
as JSON lines, so the same plan reads a folder once or as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import text as T
from ..operators.tables import first_of_each

TEXT_FILES = r"(?i)\.(txt|md|markdown|mdown|mdx|rst|log|csv|tsv)$"
HTML_FILES = r"(?i)\.html?$"


def items(df: DataFrame, kind: str, url, title, text, created_at, **extra) -> DataFrame:
    """The common columns; the id is the SHA-1 of the url."""
    bag = F.to_json(F.struct(*[v.alias(k) for k, v in extra.items()])) if extra else F.lit(None).cast("string")
    return df.select(
        F.sha1(url.cast("binary")).alias("mem_id"),
        url.alias("url"),
        title.alias("title"),
        text.alias("text"),
        F.lit(kind).alias("source_kind"),
        T.host_of(url).alias("site_name"),
        created_at.cast("timestamp").alias("created_at"),
        bag.alias("extra"),
    )


def millis(column):
    return F.timestamp_millis(column.cast("long"))


def history(visits: DataFrame) -> DataFrame:
    """visits (url, title, last_visit_ms, visit_count, typed_count): one item a url, without junk."""
    kept = first_of_each(visits.where(T.history_worthy(F.col("url"), F.col("title"))), "url", "last_visit_ms", "title")
    return items(kept, "history", F.col("url"), F.col("title"), F.lit(""), millis(F.col("last_visit_ms")), visitCount=F.col("visit_count"), typedCount=F.col("typed_count"))


def bookmarks(nodes: DataFrame) -> DataFrame:
    """nodes (id, parent_id, title, url, added_ms) of a bookmark tree: its pages with their folders' path."""
    spark = nodes.sparkSession
    nodes.createOrReplaceTempView("bookmark_nodes__")
    walked = spark.sql(
        """WITH RECURSIVE walk (id, title, url, added_ms, folder) AS (
             SELECT id, title, url, added_ms, CAST('' AS STRING) FROM bookmark_nodes__ WHERE parent_id IS NULL
             UNION ALL
             SELECT n.id, n.title, n.url, n.added_ms, concat_ws(' / ', nullif(w.folder, ''), nullif(w.title, ''))
             FROM bookmark_nodes__ n JOIN walk w ON n.parent_id = w.id)
           SELECT * FROM walk"""
    )
    pages = walked.where(F.col("url").rlike("(?i)^https?:") & (F.length("title") > 1))
    return items(pages, "bookmark", F.col("url"), F.col("title"), F.lit(""), millis(F.col("added_ms")), folder=F.col("folder"))


def mail(messages: DataFrame) -> DataFrame:
    """messages (id, subject, sender, date_ms, snippet, labels)."""
    url = F.concat(F.lit("https://mail.google.com/mail/u/0/#all/"), F.col("id"))
    return items(messages, "gmail", url, F.coalesce("subject", F.lit("(no subject)")), F.col("snippet"), millis(F.col("date_ms")), gmailId=F.col("id"), labels=F.col("labels"), **{"from": F.col("sender")})


def videos(listed: DataFrame, details: DataFrame) -> DataFrame:
    """listed (video_id, title, channel, playlist, added_ms), details (video_id, description, duration, tags)."""
    full = first_of_each(listed, "video_id", "added_ms").join(details, "video_id", "left")
    url = F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("video_id"))
    return items(full, "youtube", url, F.col("title"), F.substring("description", 1, 800), millis(F.col("added_ms")), videoId=F.col("video_id"), channel=F.col("channel"), playlist=F.col("playlist"), duration=F.col("duration"), tags=F.slice("tags", 1, 8))


def calendar(events: DataFrame, start, end) -> DataFrame:
    """events (event_id, url, title, description, location, attendees, start_ms) within [start, end)."""
    at = millis(F.col("start_ms"))
    who = F.array_join(F.slice("attendees", 1, 8), ", ")
    lines = F.concat_ws("\n", F.nullif(F.col("location"), F.lit("")), F.nullif(who, F.lit("")), F.nullif(F.col("description"), F.lit("")))
    return items(events.where((at >= start) & (at < end)), "calendar", F.col("url"), F.col("title"), lines, at, eventId=F.col("event_id"), location=F.col("location"), attendees=who)


def coursework(works: DataFrame) -> DataFrame:
    """works (course_id, course, work_id, title, url, description, due_date struct, due_time struct, states, created_ms).

    A due date without a time is 23:59 UTC; turned in or returned in any submission counts as submitted.
    """
    d, t = F.col("due_date"), F.col("due_time")
    hour, minute = F.coalesce(t["hours"], F.when(t.isNull(), 23).otherwise(0)), F.coalesce(t["minutes"], F.when(t.isNull(), 59).otherwise(0))
    due = F.make_timestamp(d["year"], d["month"], d["day"], hour, minute, F.lit(0))
    submitted = F.exists("states", lambda s: s.isin("TURNED_IN", "RETURNED"))
    return items(works, "classroom", F.col("url"), F.col("title"), F.col("description"), millis(F.col("created_ms")), courseId=F.col("course_id"), courseName=F.col("course"), workId=F.col("work_id"), due=F.unix_millis(due), submitted=submitted)


def drive(files: DataFrame) -> DataFrame:
    """files (file_id, name, url, text, viewed_ms): those with 40 characters of text or more."""
    return items(files.where(F.length(F.trim("text")) >= 40), "drive", F.col("url"), F.col("name"), F.col("text"), millis(F.col("viewed_ms")), driveId=F.col("file_id"))


def local_files(spark: SparkSession, path: str) -> DataFrame:
    """Text and HTML files of a folder tree; a file is known by name, size and time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.where(F.col("path").rlike(TEXT_FILES) | F.col("path").rlike(HTML_FILES)).withColumn("raw", F.decode("content", "UTF-8"))
    html = F.col("path").rlike(HTML_FILES)
    url = F.concat_ws("|", F.concat(F.lit("file:"), name), F.col("length"), F.unix_millis("modificationTime"))
    title = F.when(html, F.coalesce(F.nullif(T.html_title(F.col("raw")), F.lit("")), name)).otherwise(name)
    return items(files, "file", url, title, F.when(html, T.html_to_text(F.col("raw"))).otherwise(F.col("raw")), F.col("modificationTime"), name=name, size=F.col("length"))


def exported(spark: SparkSession, path: str) -> DataFrame:
    """The memories of an export: a row a line, as ``sinks.export_json`` writes them, or one object with all of them."""
    found = spark.read.json(path)
    if "_corrupt_record" in found.columns:
        found = spark.read.json(path, multiLine=True)
    return found.select(F.explode("memories").alias("m")).select("m.*") if "memories" in found.columns else found


def bookmark_nodes(tree: list[dict]) -> Iterator[tuple]:
    """Rows for ``bookmarks`` of a nested bookmark export."""
    stack = [(node, None) for node in reversed(tree)]
    number = 0
    while stack:
        node, parent = stack.pop()
        number += 1
        yield number, parent, node.get("title"), node.get("url"), node.get("dateAdded")
        stack.extend((child, number) for child in reversed(node.get("children", [])))


BOOKMARK_NODE = Ty.StructType().add("id", "long").add("parent_id", "long").add("title", "string").add("url", "string").add("added_ms", "long")
