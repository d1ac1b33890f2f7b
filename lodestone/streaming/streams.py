"""Structured Streaming forms: messages to commitments, reminders, engagement, captures, sessions."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.streaming import StatefulProcessor

from ..functions.commitments import detect_commitment

#: Minutes of a snooze, and days for which a reminder that rang is known.
SNOOZE, KEPT_DAYS = 10, 7


def _first_within(rows: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """rows without those that follow another of their key within so many seconds; of equal times one is kept.

    A stream is held against what its watermark still knows; a table against the row before, in time.
    """
    if rows.isStreaming:
        return rows.withWatermark(at, f"{seconds} seconds").dropDuplicatesWithinWatermark([key])
    order = Window.partitionBy(key).orderBy(at)
    before = F.lag(F.unix_micros(F.col(at).cast("timestamp"))).over(order)
    gap = F.unix_micros(F.col(at).cast("timestamp")) - before
    return rows.withColumn("gap__", gap).where(F.col("gap__").isNull() | (F.col("gap__") > seconds * 1_000_000)).drop("gap__")


def message_candidates(messages: DataFrame, *, delay: int = 3600) -> DataFrame:
    """messages (text, at) of 10 to 600 characters, without those that begin with the same 160 characters as one within ``delay`` seconds before."""
    kept = messages.where(F.length(F.trim("text")).between(10, 600)).withColumn("key", F.substring(F.trim("text"), 1, 160))
    return _first_within(kept, "key", "at", delay)


def commitments(messages: DataFrame, *, least: float = 0.45, delay: int = 3600) -> DataFrame:
    """(text, at, due, confidence, cue) of messages that owe something; ``at`` is each one's now."""
    found = message_candidates(messages, delay=delay).withColumn("c", detect_commitment(F.col("text"), F.col("at"), least))
    return found.where("c.at is not null").select("text", "at", F.col("c.at").alias("due"), "c.confidence", "c.cue")


def reminders(found: DataFrame) -> DataFrame:
    """found (a stream has its watermark on at) with what and the minute it is due, one each."""
    made = found.select(F.substring("text", 1, 90).alias("what"), F.date_trunc("minute", F.col("due") + F.expr("INTERVAL 30 SECONDS")).alias("due_minute"), "due", "at")
    if made.isStreaming:
        return made.dropDuplicatesWithinWatermark(["what", "due_minute"])
    return made.dropDuplicates(["what", "due_minute"])


def due_reminders(table: DataFrame, now: Column) -> DataFrame:
    """Reminders (at, fired_at) to fire now; those fired more than seven days ago may go."""
    return table.where((F.col("at") <= now) & F.col("fired_at").isNull())


def prune_reminders(table: DataFrame, now: Column) -> DataFrame:
    return table.where(F.col("fired_at").isNull() | (F.col("fired_at") >= now - F.expr("INTERVAL 7 DAYS")))


def snooze(table: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """The reminders (id) of ids ring again in ten minutes."""
    again = ids.select("id", F.lit(True).alias("again__"))
    moved = table.join(again, "id", "left")
    return moved.withColumn("at", F.when(F.col("again__"), now + F.expr("INTERVAL 10 MINUTES")).otherwise(F.col("at"))).withColumn("fired_at", F.when(~F.coalesce("again__", F.lit(False)), F.col("fired_at"))).drop("again__")


def engagement(signals: DataFrame, *, least_ms: int = 4000, per: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Active time and farthest scroll of each url of signals (url, at, active_ms, scroll_pct), by visits: signals of a url with no longer pause than
    ``per`` between them. A visit is done, and its state goes, once the watermark has passed its pause."""
    visit = F.session_window("at", per)
    rolled = signals.withWatermark("at", delay).groupBy("url", visit).agg(F.sum("active_ms").alias("dwell_ms"), F.max("scroll_pct").alias("scroll_pct"))
    return rolled.select("url", F.col("session_window.start").alias("started_at"), "dwell_ms", "scroll_pct").where(F.col("dwell_ms") >= least_ms)


def captures(visits: DataFrame, *, within: int = 600) -> DataFrame:
    """visits (url, at) without those of a url within so many seconds of the visit before."""
    return _first_within(visits, "url", "at", within)


def stream_sessions(events: DataFrame, *, gap: str = "45 minutes", key: str = "user_id", at: str = "ts") -> DataFrame:
    """(key, started_at, ended_at, n): session windows; late events are waited for twice the gap."""
    n, unit = gap.split()
    window = F.session_window(at, gap)
    rolled = events.withWatermark(at, f"{2 * int(n)} {unit}").groupBy(key, window).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("ended_at"))
    return rolled.select(key, F.col("session_window.start").alias("started_at"), "ended_at", "n")


class _Timers(StatefulProcessor):
    """A reminder's timer: armed for its time, fired once, moved by a snooze, cleared by a cancel; gone a week after it fired."""

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("reminder", "what string, at timestamp, fired boolean")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        for frame in rows:
            for row in frame.sort_values("seen").itertuples():
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                if row.action == "cancel":
                    self.held.clear()
                elif row.action == "snooze" and self.held.exists():
                    self._arm(self.held.get()[0], (row.seen + timedelta(minutes=SNOOZE)).to_pydatetime())
                elif row.action == "set":
                    self._arm(row.what, row.due.to_pydatetime())
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if self.held.exists():
            what, at, fired = self.held.get()
            if fired:
                self.held.clear()
            else:
                self.held.update((what, at, True))
                self.handle.registerTimer(_millis(at) + KEPT_DAYS * 86_400_000)
                yield pd.DataFrame({"id": [key[0]], "what": [what], "at": [at]})

    def _arm(self, what: str, at: datetime) -> None:
        self.held.update((what, at, False))
        self.handle.registerTimer(_millis(at))

    def close(self) -> None:
        pass


def _millis(at: datetime) -> int:
    return int(at.replace(tzinfo=timezone.utc).timestamp() * 1000)


def fired(requests: DataFrame, *, delay: str = "1 minute") -> DataFrame:
    """(id, what, at) of the reminders that ring, once each: requests (id, action, what, due, seen) are a stream in the order of seen;
    action is set, snooze (again after ten minutes) or cancel. A reminder whose time has passed when it is set rings at once.
    Timers run by event time, so that a restart rings what was due meanwhile. Needs the session's RocksDB state store.
    """
    keyed = requests.withWatermark("seen", delay).groupBy("id")
    return keyed.transformWithStateInPandas(statefulProcessor=_Timers(), outputStructType="id long, what string, at timestamp", outputMode="append", timeMode="EventTime")
