"""What a title says about an event: its status, whether it is a meeting, and its name without both."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import SPACES, WS, let, matches, squeeze, swap

# Words for called-off and moved events, and for meetings of governing bodies.
CANCELLED = r"\b(cancell?ed|canceled|no\s+meeting)\b"
MOVED = r"\b(rescheduled|postponed)\b"
MARKER = r"(^|\s)[-–—:(]?\s*\b(cancell?ed|canceled|no\s+meeting|rescheduled|postponed)\b\s*[-–—:)]?\s*"
DATE_FIRST = r"^\s*(?:\d{1,2}[ /.-]\d{1,2}[ /.-]\d{4}|\d{4}[ /.-]\d{1,2}[ /.-]\d{1,2})\s*[-–—:]?\s*"
DATE_LAST = r"\s*[-–—]\s*(?:\d{1,2}\s+[A-Za-z]{3,9}\.?,?\s+\d{4}|[A-Za-z]{3,9}\.?\s+\d{1,2},?\s+\d{4})\s*(\([^)]*\))?\s*$"
DATE_LAST_BARE = r"\s+\d{1,2}\s+[A-Za-z]{3,9}\.?\s+\d{4}\s*$"
MEETING_NAMES = r"\b(committee of adjustment|committee of the whole|council meeting|special council|regular council|council session|public meeting|statutory public meeting|budget deliberations?|board of health meeting)\b"
BODIES = r"\b(council|committee|board|commission|authority|budget|by-?law|planning act|zoning)\b"
SITTINGS = r"\b(meeting|session|hearing|deliberations?|workshop|open house)\b"
MEETING_LABELS = r"\b(council|committee|public meeting|meetings?)\b"


def clean_title(raw: Column) -> Column:
    """Without dates at either end and without status words; a title that is nothing else stays as it is."""
    title = F.trim(raw)
    title = swap(title, DATE_FIRST, "")
    title = swap(title, DATE_LAST_BARE, "")
    title = swap(title, DATE_LAST, " $1")
    title = squeeze(swap(title, MARKER, " "))
    title = F.regexp_replace(title, rf"^[{SPACES}\-–—:,]+|[{SPACES}\-–—:,]+$", "")
    title = F.trim(F.regexp_replace(title, rf"\({WS}*\)", ""))
    return let(title, lambda t: F.when(t != "", t).otherwise(F.trim(raw)))


def stated_status(title: Column, location: Column | None = None) -> Column:
    """cancelled before rescheduled; null when neither is said."""
    text = title if location is None else F.concat_ws(" ", title, F.coalesce(location, F.lit("")))
    return F.when(matches(text, CANCELLED), "cancelled").when(matches(text, MOVED), "rescheduled")


def location_is_marker(location: Column) -> Column:
    """Whether a place field only says that the event is off."""
    left = F.regexp_replace(swap(swap(location, MARKER, " "), r"\b(meeting|this|is|has|been|the|was)\b", ""), "[^A-Za-z0-9]+", "")
    return matches(location, CANCELLED) & (F.length(left) < 3)


def is_meeting(title: Column, categories: Column) -> Column:
    """A meeting by name; a body and a sitting; or a body on a calendar that labels it a meeting."""
    title = F.trim(title)
    labelled = F.exists(categories, lambda c: matches(c, MEETING_LABELS))
    return matches(title, MEETING_NAMES) | (matches(title, BODIES) & (matches(title, SITTINGS) | labelled))
