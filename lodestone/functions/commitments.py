"""Whether a message says that something is owed at some time."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType, TimestampType

from .time import parse_when

# Words that say so strongly, plainly, weakly; those that take it back.
STRONG = ["don'?t forget", "dont forget", "remember to", "remind me", "make sure", "be sure to", "deadline", "due", "submit", "submission", "turn (?:it )?in", "hand (?:it )?in", "rsvp", "you need to", "you have to", "we need to", "i need you to", "make sure you", "cut ?off", "last chance", "expires", "closes", "closing", "ends", "ending"]
MEDIUM = ["meeting", "meet", "call", "appointment", "interview", "session", "standup", "practice", "rehearsal", "shift", "class", "lecture", "lab", "exam", "midterm", "final", "finals", "test", "quiz", "presentation", "demo", "review", "reservation", "booked", "scheduled", "starts", "starting", "begins", "tryout", "audition", "game", "match", "tournament", "flight", "train", "bus", "pickup", "pick up", "drop off", "deliver", "assignment", "homework", "project", "essay", "paper", "application", "apply", "register", "registration", "hackathon", "competition", "contest", "workshop", "conference", "ceremony", "recital", "performance", "doctor", "dentist", "checkup", "ticket", "tickets"]
WEAK = ["can you", "could you", "please", "send me", "bring", "party", "dinner", "lunch", "breakfast", "coffee", "concert", "birthday", "wedding", "let me know", "see you", "meet up", "hang out", "going to", "gonna"]
NOISE = r"^\s*(?:https?://|[\[\{<]|\d+[-–]\d+\s*$)"
PAST = r"was|were|went|had|used to|did you|didn'?t"
LONG_PAST = r"yesterday|last night|last week|last weekend|last month|last year|\d+\s*(?:days?|weeks?|months?|years?)\s+ago"
HEDGE = r"\b(?:maybe|might|probably|possibly|thinking about|considering|not sure|if i|if we|might be)\b"

_CUES = [(re.compile(rf"\b(?:{'|'.join(words)})\b", re.I | re.A), share) for words, share in ((STRONG, 0.55), (MEDIUM, 0.40), (WEAK, 0.24))]
_SHIFTS = [(re.compile(pattern, re.I | re.A), share) for pattern, share in ((r"\b(?:you|your|u|ur)\b", 0.1), (r"\b(?:by|before|due|no later than)\b", 0.1), (r"\?\s*$", -0.15), (HEDGE, -0.35))]
_NOISE, _PAST, _LONG_PAST = (re.compile(p, re.I) for p in (NOISE, PAST, LONG_PAST))


def detect(text: str | None, now: datetime, least: float = 0.45) -> dict | None:
    """at, confidence and cue, or None."""
    s = (text or "").strip()
    if not 8 <= len(s) <= 600 or _NOISE.search(s) or _LONG_PAST.search(s):
        return None
    when = parse_when(s, now)
    if when is None or not now - timedelta(minutes=5) <= when["at"] <= now + timedelta(days=365):
        return None
    if _PAST.search(s) and not (when["names_a_day"] and when["at"] > now):
        return None
    found = next(((m[0], share) for cue, share in _CUES if (m := cue.search(s))), None)
    if found is None:
        if not (when["names_a_day"] and when["has_clock"]):
            return None
        found = "day and time", 0.34
    cue, confidence = found
    confidence += 0.25 * when["explicit"] + 0.12 * when["day_and_clock"]
    confidence += sum(share for pattern, share in _SHIFTS if pattern.search(s))
    confidence = round(max(0.0, min(1.0, confidence)), 9)
    return {"at": when["at"], "confidence": confidence, "cue": cue.lower()} if confidence >= least else None


_SCHEMA = StructType([StructField("at", TimestampType()), StructField("confidence", DoubleType()), StructField("cue", StringType())])


def detect_commitment(text: Column, now: Column, least: float = 0.45) -> Column:
    """struct(at, confidence, cue), its fields null where there is no commitment."""

    @F.pandas_udf(_SCHEMA)
    def run(texts: pd.Series, times: pd.Series) -> pd.DataFrame:
        rows = [detect(s, t.to_pydatetime().replace(tzinfo=None), least) or {} for s, t in zip(texts, times, strict=True)]
        return pd.DataFrame({"at": pd.to_datetime([r.get("at") for r in rows]), "confidence": pd.Series([r.get("confidence") for r in rows], dtype="float64"), "cue": pd.Series([r.get("cue") for r in rows], dtype="object")})

    return run(text, now)
