"""Shapes of the tables: raw events, listings, events."""

from __future__ import annotations

RAW = """source_slug string, external_id string, title string, description string, local_start string, local_end string,
all_day boolean, time_precision string, venue_name string, address string, municipality_hint string, cost_text string,
is_free boolean, categories array<string>, organizer string, image_url string, url string, position long"""

LISTING = [
    "id", "source_slug", "source_kind", "external_id", "municipality_slug", "title", "description", "category", "source_categories",
    "starts_at", "ends_at", "local_date", "local_time", "timezone", "time_precision", "all_day", "venue_name", "address", "cost",
    "cost_text", "organizer", "image_url", "url", "status", "active", "content_hash",
]
STATUSES = ("scheduled", "rescheduled", "cancelled")
COSTS = ("free", "paid", "unknown")
CATEGORIES = ("arts", "music", "family", "outdoors", "markets", "sports", "community", "education", "civic-meeting", "other")
