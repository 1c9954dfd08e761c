"""Dates and times as platforms print them."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from ..shipping import by_value

by_value(__name__)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def month(name: str) -> int | None:
    short = name.strip().lower()[:3]
    return MONTHS.index(short) + 1 if short in MONTHS else None


def clock(text: str) -> str | None:
    """HH:mm of "9:30 AM", "12 p.m." or "19:00"."""
    m = re.fullmatch(r"\s*(\d{1,2})(?::(\d{2}))?(?::\d{2})?\s*(?:([ap])\.?\s?m\.?)?\s*", text, re.IGNORECASE)
    if not m or not (m[2] or m[3]):
        return None
    hour, minute = int(m[1]), int(m[2] or 0)
    if m[3]:
        hour = hour % 12 + 12 * (m[3].lower() == "p") if hour <= 12 else hour
    return f"{hour:02d}:{minute:02d}" if hour < 24 and minute < 60 else None


def year_of(number: int, window: tuple[str, str]) -> int:
    """The year of a month that is printed without one: the window's first, or the next for months before it."""
    return int(window[0][:4]) + (number < int(window[0][5:7]))


def day(y: int, m: int, d: int) -> str:
    return f"{y:04d}-{m:02d}-{d:02d}"


def shift(iso: str, days: int) -> str:
    return (date.fromisoformat(iso) + timedelta(days=days)).isoformat()


def at_zone(seconds: float, zone: str) -> str:
    return datetime.fromtimestamp(seconds, timezone.utc).astimezone(ZoneInfo(zone)).strftime("%Y-%m-%dT%H:%M")


def zulu_at_zone(wall: str, zone: str) -> str:
    return at_zone(datetime.fromisoformat(wall).replace(tzinfo=timezone.utc).timestamp(), zone)


def wall(text: str) -> str:
    """The first sixteen characters of an ISO time, or midnight of a date."""
    return f"{text}T00:00" if len(text) == 10 else text[:16]
