"""Activity analytics: sessions, entities, open items, what to revisit, summaries."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import time as D

# Names that are no one's.
NOISE_NAMES = ["me", "you", "us", "them", "no reply", "noreply", "no-reply", "support", "info", "admin", "notifications", "team", "the team", "newsletter", "unknown", "n a", "untitled", "google", "gmail"]


def sessionize(events: DataFrame, *, gap_minutes: int = 45, key: str = "user_id", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """events with ``session``: a new one where more than the gap lies between; equality stays together."""
    w = Window.partitionBy(key).orderBy(at, tie)
    apart = D.micros(F.col(at)) - D.micros(F.lag(at).over(w)) > gap_minutes * 60_000_000
    return events.withColumn("new__", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("session", F.sum("new__").over(w)).drop("new__")


def sessions(events: DataFrame, *, gap_minutes: int = 45, least: int = 3, key: str = "user_id", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """Roll-up of sessions with ``least`` events or more."""
    cut = sessionize(events, gap_minutes=gap_minutes, key=key, at=at, tie=tie)
    rolled = cut.groupBy(key, "session").agg(
        F.min(at).alias("started_at"),
        F.max(at).alias("ended_at"),
        F.count(F.lit(1)).alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct(at, tie))), lambda s: s[tie]).alias("members"),
    )
    return rolled.where(F.col("n") >= least).withColumn("duration_ms", F.floor((D.micros(F.col("ended_at")) - D.micros(F.col("started_at"))) / 1000))


class _Topics:
    """Parts of a session whose rows arrive in order, in batches: a part ends where a vector is far from the running mean, if it has ``run`` items
    and as many are left. Of what went before it holds the sum of the part at hand."""

    def __init__(self, cut: float, run: int, least: int):
        self.cut, self.run, self.least = cut, run, least
        self.begin()

    def begin(self) -> None:
        self.done, self.part, self.total, self.size = 0, 0, None, 0

    def judge(self, vectors: pa.Array, ended: bool) -> list[tuple[int, int]]:
        """(part, place in it) of the next rows of the session, of so many as can be told: whether it has ``least`` items, and a row ``run`` from
        the end, is not known before as many are there, or it has ended."""
        known = self.done + len(vectors)
        if known < self.least:
            return [(0, k) for k in range(len(vectors))] if ended else []
        some = vectors.slice(0, len(vectors) if ended else max(0, len(vectors) - self.run + 1))
        flat = some.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum(some.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        told = []
        for a, b, there in zip([0, *ends[:-1]], ends, some.is_valid().to_pylist(), strict=False):
            x = flat[a:b] if there else None
            length = 0.0 if self.total is None else float(np.linalg.norm(self.total))
            alike = 1.0 if x is None or length == 0 else float(x @ self.total) / length
            if self.size >= self.run and known - self.done >= self.run and alike < self.cut:
                self.part, self.total, self.size = self.part + 1, None, 0
            if x is not None:
                self.total = x if self.total is None else self.total + x
            told.append((self.part, self.size))
            self.size += 1
            self.done += 1
        return told


def _changes(column: pa.Array) -> np.ndarray:
    """Whether a value differs from the one before; null is a value."""
    ids = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([np.zeros(min(1, len(ids)), bool), ids[1:] != ids[:-1]])


def with_parts(rows: DataFrame, *keys: str, cut: float = 0.42, run: int = 3, least: int = 8) -> DataFrame:
    """rows with ``part``, and ``place`` in it, in place of vec. The rows of a session (keys) lie in one partition and follow each other in order;
    they are read as a stream, so that a session of any length takes the memory of a batch. The vectors of sessions under ``least`` are not looked at."""
    kept = [c for c in rows.columns if c != "vec"]
    schema = rows.select(*kept).schema.add("part", "integer").add("place", "integer")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topics, held, last = _Topics(cut, run, least), None, None
        for batch in chain(batches, [None]):
            some = batch if held is None else held if batch is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if some is None or not len(some):
                continue
            at = lambda row: tuple(some.column(k)[row].as_py() for k in keys)  # noqa: B023, E731
            begins = np.flatnonzero(np.any([_changes(some.column(k)) for k in keys], axis=0)).tolist()
            if at(0) != last:
                topics.begin()
            told: list[tuple[int, int]] = []
            for a, b in zip([0, *begins], [*begins, len(some)], strict=True):
                if a:
                    topics.begin()
                told += topics.judge(some.column("vec").slice(a, b - a), batch is None or b < len(some))
            last, n = at(len(some) - 1), len(told)
            part, place = np.array(told, np.int32).reshape(-1, 2).T
            columns = [some.column(c).slice(0, n) for c in kept] + [pa.array(part), pa.array(place)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "part", "place"])
            held = some.slice(n) if n < len(some) else None

    return rows.mapInArrow(split, schema)


def split_by_topic(items: DataFrame, *, cut: float = 0.42, run: int = 3, least: int = 8) -> DataFrame:
    """(session, item, part) of items (session, pos, item, vec): a part ends where a vector is far from the
    running mean, if it has ``run`` items and as many are left. Sequential within a session, which is a stream of batches."""
    dealt = items.select(F.col("session").cast("long").alias("session"), "pos", F.col("item").cast("long").alias("item"), "vec").repartition("session")
    return with_parts(dealt.sortWithinPartitions("session", "pos", "item"), "session", cut=cut, run=run, least=least).select("session", "item", "part")


def top_counts(values: DataFrame, key: str, value: str, position: str, n: int) -> DataFrame:
    """(key, value, n, rank): the most frequent values of each key, ties by first position."""
    counted = values.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    w = Window.partitionBy(key).orderBy(F.col("n").desc(), "first", value)
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("first")


def recurring_words(titles: DataFrame, key: str, title: str, n: int = 5) -> DataFrame:
    """(key, word, df, rank): words of four letters or more in several titles of a key (in one, if it has under four)."""
    words = titles.select(key, F.explode(F.array_distinct(T.content_tokens(F.col(title)))).alias("word")).where(F.length("word") >= 4)
    size = titles.groupBy(key).agg(F.count(F.lit(1)).alias("items"))
    df = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("df")).join(size, key).where(F.col("df") >= F.when(F.col("items") >= 4, 2).otherwise(1))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("df").desc(), "word"))).where(F.col("rank") <= n).drop("items")


def session_name(tag: Column, word: Column, site: Column, kind: Column) -> Column:
    """The first that there is: tag, title word with its site, site, kind."""
    return F.coalesce(tag, F.concat(word, F.lit(" · "), site), word, F.concat(F.lit("Browsing "), site), F.concat(kind, F.lit(" session")))


def usable_name(norm: Column, kind: Column) -> Column:
    return (F.length(norm) >= 2) & ~norm.isin(*NOISE_NAMES) & ~norm.rlike(r"^\d+$") & ~((kind == "person") & (F.length(norm) > 60))


def shared(every: DataFrame, asked: DataFrame, block: int = 1000) -> DataFrame:
    """(a, b, shared) of asked (a, s) and every (b, s): how many values the sorted sets of two of them have in common, where there are any. Those asked
    that have the same set are compared once, in blocks of ``block``, and go to all tasks; a row of every meets them as it passes, so that a common value
    is no large group and pairs are neither dealt out nor held."""
    tasks = int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by a stated number: the sets are small, what is made of them is not
    order = Window.partitionBy("s").orderBy("a")
    groups = asked.where(F.size("s") > 0).withColumn("k", F.floor((F.row_number().over(order) - 1) / block)).groupBy("s", "k").agg(F.collect_list("a").alias("ids"))
    met = every.select("b", F.col("s").alias("own")).repartition(tasks).join(F.broadcast(groups), F.arrays_overlap("s", "own"))
    return met.select(F.explode("ids").alias("a"), "b", F.size(F.array_intersect("s", "own")).cast("long").alias("shared")).where("a <> b")


def implicit_entities(items: DataFrame) -> DataFrame:
    """(mem_id, ts, ord, name, kind) from metadata columns mem_id, ts, source_kind, author, attendees, channel, course, site_name."""
    named = lambda c, kind: F.struct(c.alias("name"), kind.alias("kind"))
    who = F.when(F.col("source_kind") == "youtube", "org").otherwise("person")
    people = F.transform(F.coalesce("attendees", F.array().cast("array<string>")), lambda a: named(a, F.lit("person")))
    drive = F.when((F.col("source_kind") == "drive") & (F.col("site_name") != "Google Drive"), F.col("site_name"))
    every = F.concat(F.array(named(F.col("author"), who)), people, F.array(named(F.col("channel"), F.lit("org")), named(F.col("course"), F.lit("event")), named(drive, F.lit("org"))))
    return items.select("mem_id", "ts", F.posexplode(every).alias("ord", "e")).select("mem_id", "ts", "ord", F.col("e.name").alias("name"), F.col("e.kind").alias("kind")).where("name is not null and name <> ''")


def fold_aliases(mentions: DataFrame) -> DataFrame:
    """mentions (mem_id, ord, norm, kind) with ``entity``: a person's bare first name is the one person seen before
    who has it as the first of several names; with two such it stays by itself. One pass in order over each first name, which
    holds two names of it, however common it is."""
    full = F.when((F.col("kind") == "person") & F.contains("norm", F.lit(" ")), F.col("norm"))
    # the first of several names, so that other kinds are not one large group
    before = Window.partitionBy("kind", F.split("norm", " ")[0]).orderBy("mem_id", "ord").rowsBetween(Window.unboundedPreceding, -1)
    seen = mentions.withColumns({"low__": F.min(full).over(before), "high__": F.max(full).over(before)})
    alone = ~F.contains("norm", F.lit(" ")) & (F.col("low__") == F.col("high__"))
    return seen.select("mem_id", "ord", "norm", "kind", F.when(alone, F.col("low__")).otherwise(F.col("norm")).alias("entity"))


def entity_graph(edges: DataFrame) -> DataFrame:
    """Roll-up of edges (kind, norm, mem_id, ts): those of two items or more, and all people."""
    rolled = edges.select("kind", "norm", "mem_id", "ts").groupBy("kind", "norm").agg(F.countDistinct("mem_id").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return rolled.where("n >= 2 or kind = 'person'")


def open_loops(items: DataFrame, now: Column, dismissed: DataFrame | None = None) -> DataFrame:
    """(mem_id, kind, due, urgency) by the first rule that matches an item.

    items: mem_id, source_kind, created_at, title, summary, text_length, due, submitted, unread, dwell_ms,
    scroll_pct, modified_by_me, revisited, modified_at.
    """
    age = D.days_between(F.col("created_at"), now)
    untouched = D.days_between(F.coalesce("modified_at", "created_at"), now)
    owed = (F.col("source_kind") == "classroom") & F.col("due").isNotNull() & ~F.col("submitted")
    unread = (F.col("source_kind") == "gmail") & F.col("unread") & (age > 1) & T.question_like(F.col("title"), F.col("summary"))
    left = (F.col("text_length") >= 6000) & (F.col("dwell_ms") >= 20_000) & (F.col("scroll_pct") < 0.4) & (age > 2)
    stale = (F.col("source_kind") == "drive") & F.col("modified_by_me") & ~F.coalesce("revisited", F.lit(False)) & (untouched > 7) & (untouched < 120)
    kind = F.when(owed & (F.col("due") < now), "assignment-overdue").when(owed, "assignment-due").when(unread, "unread-email").when(left, "abandoned-read").when(stale, "stale-doc")
    urgency = (
        F.when(F.col("kind").isin("assignment-overdue", "assignment-due"), D.due_urgency(F.col("due"), now))
        .when(F.col("kind") == "unread-email", F.when(age > 21, 0.25).otherwise(F.least(F.lit(0.75), 0.3 + age / 14 * 0.45)))
        .when(F.col("kind") == "abandoned-read", 0.2 + F.col("scroll_pct") * 0.5)
        .otherwise(0.25)
    )
    found = items.withColumn("kind", kind).where("kind is not null").withColumn("urgency", urgency)
    found = found.select("mem_id", "kind", F.when(F.col("kind").startswith("assignment"), F.col("due")).alias("due"), "urgency")
    return found if dismissed is None else found.join(dismissed, ["mem_id", "kind"], "left_anti")


def by_urgency(loops: DataFrame, limit: int = 25) -> DataFrame:
    """The most urgent first, then the earlier due; those without a date last."""
    return loops.orderBy(F.col("urgency").desc(), F.col("due").asc_nulls_last(), "mem_id").limit(limit)


def latest_episodes(episodes: DataFrame, limit: int = 40, least: int = 3) -> DataFrame:
    """Episodes (started_at, n) of ``least`` items or more, newest first."""
    return episodes.where(F.col("n") >= least).orderBy(F.col("started_at").desc()).limit(limit)


def find_entity(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, kind, norm, how): of entities (kind, norm, aliases) the one that a name of asked (query_id, name) means: by its name, else by an
    alias, else one whose name begins with that word; the first by name and kind. Each way is a join on equal names."""
    q = asked.select("query_id", T.norm_name(F.col("name")).alias("asked")).where("asked <> ''")
    words = F.split("norm", " ")
    # all beginnings of a name that end before a space
    begins = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    keys = F.concat(
        F.array(F.struct(F.lit(0).alias("how"), F.col("norm").alias("asked"))),
        F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lit(1).alias("how"), a.alias("asked"))),
        F.when(F.size(words) > 1, F.transform(begins, lambda b: F.struct(F.lit(2).alias("how"), b.alias("asked")))).otherwise(F.array().cast("array<struct<how:int,asked:string>>")),
    )
    met = entities.select("kind", "norm", F.explode(keys).alias("k")).select("kind", "norm", "k.*").join(q, "asked")
    order = Window.partitionBy("query_id").orderBy("how", "norm", "kind")
    return met.withColumn("n__", F.row_number().over(order)).where("n__ = 1").select("query_id", "kind", "norm", "how")


def rebuild_entities(items: DataFrame, tags: int = 6) -> tuple[DataFrame, DataFrame]:
    """(entities, links) of items (mem_id, ts, source_kind, author, attendees, channel, course, site_name, tags): entities (kind, norm, aliases, n,
    first_seen, last_seen) with two items or more and all people; links (mem_id, kind, norm) from each item to those."""
    none = F.array().cast("array<string>")
    tagged = items.select("mem_id", "ts", F.posexplode(F.slice(F.coalesce("tags", none), 1, tags)).alias("ord", "name"))
    named = implicit_entities(items).unionByName(tagged.select("mem_id", "ts", (F.col("ord") + 1_000).alias("ord"), "name", F.lit("concept").alias("kind")))
    named = named.withColumn("norm", T.norm_name(F.col("name"))).where(usable_name(F.col("norm"), F.col("kind")))
    folded = fold_aliases(named.select("mem_id", "ord", "norm", "kind"))
    links = folded.join(items.select("mem_id", "ts"), "mem_id").select("mem_id", "kind", "ts", F.col("entity").alias("norm"), F.when(F.col("norm") != F.col("entity"), F.col("norm")).alias("alias"))
    rolled = links.groupBy("kind", "norm").agg(
        F.array_sort(F.collect_set("alias")).alias("aliases"), F.countDistinct("mem_id").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    ).where("n >= 2 or kind = 'person'")
    return rolled, links.join(rolled.select("kind", "norm"), ["kind", "norm"], "left_semi").select("mem_id", "kind", "norm").distinct()


def rebuild_episodes(items: DataFrame, now: Column, *, gap_minutes: int = 45, least: int = 3, key: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """(episodes, members) of items (mem_id, key, created_at, title, site, kind, tag, vec): what has happened by now, cut at pauses and, where an episode
    is long, at changes of topic. An episode has its name; members (mem_id, episode_id) refer back."""
    past = items.where(F.col("created_at") <= now)
    # sessionize leaves the rows of a key in one partition, in this order
    cut = sessionize(past, gap_minutes=gap_minutes, key=key, at="created_at", tie="mem_id").sortWithinPartitions(key, "created_at", "mem_id")
    placed = with_parts(cut, key, "session").withColumn("episode_id", F.sha1(F.concat_ws("/", F.col(key).cast("string"), "session", "part").cast("binary")))
    # what an episode and its name need, in one pass: what occurs in it how often, then the best of each kind
    said = lambda what, value: F.struct(F.lit(what).alias("what"), value.alias("value"))
    none = F.lit(None).cast("string")
    words = F.filter(F.array_distinct(T.content_tokens(F.col("title"))), lambda w: F.length(w) >= 4)
    every = F.concat(
        F.array(said("item", none), said("kind", F.when(F.col("place") == 0, F.col("kind"))), said("tag", F.col("tag").cast("string")), said("site", F.col("site").cast("string"))),
        F.coalesce(F.transform(words, lambda w: said("word", w)), F.array().cast("array<struct<what:string,value:string>>")),
    )
    named = placed.select("episode_id", key, "created_at", F.explode(every).alias("x")).where("x.what = 'item' or x.value <> ''").groupBy("episode_id", key, "x.what", "x.value")
    counted = named.agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    of = lambda what, c: F.when(F.col("what") == what, c)
    often = lambda what, *order: F.min_by("value", of(what, F.struct(-F.col("n"), *order)))
    rolled = counted.groupBy("episode_id", key).agg(
        F.min(of("item", F.col("first"))).alias("started_at"), F.max(of("item", F.col("last"))).alias("ended_at"), F.max(of("item", F.col("n"))).alias("n"), F.max(of("kind", F.col("value"))).alias("kind"),
        often("tag", "first", "value").alias("tag"), often("word", "value").alias("word"), F.max(of("word", F.col("n"))).alias("df"), often("site", "first", "value").alias("site"),
    )
    rolled = rolled.where(F.col("n") >= least).withColumn("word", F.when(F.col("df") >= F.when(F.col("n") >= 4, 2).otherwise(1), F.col("word")))
    named = rolled.withColumn("name", session_name(F.col("tag"), F.col("word"), F.col("site"), F.col("kind"))).drop("tag", "word", "df", "site")
    members = placed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("episode_id"))).where(F.col("n") >= least)
    return named, members.select("mem_id", "episode_id")


def mark_resurfaced(items: DataFrame, shown: DataFrame, now: Column) -> DataFrame:
    """items with last_resurfaced_at as of now for those of shown (mem_id)."""
    marks = shown.select("mem_id", F.lit(True).alias("shown__")).distinct()
    return items.join(marks, "mem_id", "left").withColumn("last_resurfaced_at", F.when(F.col("shown__"), now).otherwise(F.col("last_resurfaced_at"))).drop("shown__")


def upcoming(items: DataFrame, now: Column) -> DataFrame:
    """items (mem_id, source_kind, created_at, due, submitted) that are ahead, the nearest first: calendar entries, and coursework not handed in."""
    ahead = ((F.col("source_kind") == "calendar") & (F.col("created_at") > now)) | ((F.col("source_kind") == "classroom") & (F.col("due") > now) & ~F.coalesce("submitted", F.lit(False)))
    return items.where(ahead).select("mem_id", "source_kind", F.coalesce("due", "created_at").alias("at")).orderBy("at", "mem_id")


def stability_days(kind: Column, visits: Column, scroll: Column, dwell_ms: Column, facts: Column, content_type: Column, light: Column, selected: Column) -> Column:
    """Days until an item fades to 1/e."""
    factor = lambda when, by: F.when(when, F.lit(by)).otherwise(F.lit(1.0))
    seen = F.when(visits > 1, 1 + F.least(F.lit(1.8), F.log2(visits.cast("double")))).otherwise(F.lit(1.0))
    return (
        F.lit(9.0) * factor(kind == "bookmark", 3.0) * factor(selected, 2.4) * factor(kind.isin("file", "drive"), 1.8) * seen
        * factor(scroll > 0.7, 1.5) * factor(dwell_ms > 180_000, 1.4) * factor(facts >= 3, 1.3) * factor(content_type.isin("paper", "tutorial"), 1.2) * factor(light, 0.45)
    )


def retention(age_days: Column, stability: Column) -> Column:
    return F.when(stability > 0, F.exp(-age_days / stability)).otherwise(0.0)


def resurface_score(age_days: Column, stability: Column) -> Column:
    """Highest where an item is half forgotten; durable ones count for more."""
    r = retention(age_days, stability)
    peak = F.greatest(F.lit(0.0), 1 - F.abs(r - 0.42) / 0.30)
    return F.when((age_days < 3) | (r < 0.12) | (r > 0.72), 0.0).otherwise(peak * (0.45 + 0.55 * F.least(F.lit(1.0), stability / 36)))


def due_for_resurface(items: DataFrame, now: Column, *, limit: int = 8, cooldown_days: int = 30) -> DataFrame:
    """items (mem_id, created_at, source_kind, site, stability, last_resurfaced_at) that slip, the best of each site."""
    age = D.days_between(F.col("created_at"), now)
    rested = F.coalesce(F.col("last_resurfaced_at") <= now - F.expr(f"INTERVAL {cooldown_days} DAY"), F.lit(True))
    due = items.where((F.col("created_at") <= now) & (F.col("source_kind") != "calendar") & rested)
    # an item without a site is a group of its own; its number also keeps the condition on the score above what computes it, so that this is done once
    own = F.when(F.coalesce("site", F.lit("")) == "", F.monotonically_increasing_id())
    scored = due.withColumns({"score": F.round(resurface_score(age, F.col("stability")), 9), "own__": own}).where("score > 0")
    w = Window.partitionBy("site", "own__").orderBy(F.col("score").desc(), "mem_id")
    first = scored.withColumn("n__", F.row_number().over(w)).where("n__ = 1")
    return first.orderBy(F.col("score").desc(), "mem_id").limit(limit).select("mem_id", "site", "score")


def deepen_priority(visits: Column, kind: Column, typed: Column, dwell_ms: Column, scroll: Column, age_days: Column, url: Column) -> Column:
    """How much a page that is known by its title alone is worth fetching."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*(/[^?#]*)?", 1), "/+$", "")
    depth = F.size(F.filter(F.split(path, "/"), lambda p: p != ""))
    return (
        2.2 * F.least(F.lit(4.0), F.log2(zero(visits) + 1)) + F.when(kind == "bookmark", 3.5).otherwise(0.0) + F.when(zero(typed) > 0, 1.2).otherwise(0.0)
        + F.least(F.lit(2.5), zero(dwell_ms) / 120_000) + 1.5 * zero(scroll) + F.greatest(F.lit(0.0), 3 - age_days / 14) + F.when(depth == 0, -2.5).when(depth >= 2, 0.6).otherwise(0.0)
    )


def grouped_panel(items: DataFrame, caps: dict[str, int]) -> DataFrame:
    """items (mem_id, category, at): the newest of each category up to its cap, with the category's total."""
    cap = F.lit(0)
    for name, n in caps.items():
        cap = F.when(F.col("category") == name, n).otherwise(cap)
    w = Window.partitionBy("category")
    once = items.withColumn("n__", F.row_number().over(Window.partitionBy("mem_id").orderBy("category", F.col("at").desc()))).where("n__ = 1").drop("n__")
    out = once.withColumn("total", F.count(F.lit(1)).over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.col("at").desc(), "mem_id")))
    return out.where(F.col("rank") <= cap)
