"""All queries that the driver can call; importing the modules registers them."""

from __future__ import annotations

from . import queries_console, queries_feedback, queries_feeds, queries_forms, queries_listings, queries_search, queries_serving, queries_sources, queries_streaming
from .catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "queries_console", "queries_feedback", "queries_feeds", "queries_forms", "queries_listings", "queries_search", "queries_serving", "queries_sources", "queries_streaming"]
