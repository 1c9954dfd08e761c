"""What an editor does: finding events, entering them by hand, working through inboxes, judging prices."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashes
from ..functions.text import keep_lines
from ..registry import MUNICIPALITIES
from .filters import UNPLACED
from .ranks import ranks_within
from .reconcile import upsert

# Events that a search shows, rows of an inbox, of them handled ones; the source and ids of rows by hand.
FOUND, INBOX, DONE = 60, 300, 50
MANUAL = "manual"
CODE = re.compile(r"/e/([0-9a-f]{7})\b|^([0-9a-f]{7})$", re.IGNORECASE)


def record_cost_decisions(old: DataFrame, made: DataFrame, method: str, now: str) -> DataFrame:
    """Decisions by (listing_id, content_hash) after more were made; also those that decided nothing are kept.

    old: listing_id, content_hash, verdict, quote, method, decided_at; made: the first four. A later reading of
    the same text takes the place of the earlier."""
    return upsert(old, made.withColumns({"method": F.lit(method), "decided_at": F.lit(now).cast("timestamp")}), ["listing_id", "content_hash"])


def set_listing_cost(listings: DataFrame, updates: DataFrame) -> DataFrame:
    """listings with the judged cost and cost_text (updates: id, cost, cost_text) where nothing was stated before."""
    rows = listings.join(updates.select("id", F.struct("cost", "cost_text").alias("_to")), "id", "left")
    may = (F.col("cost") == "unknown") & F.col("_to").isNotNull()
    return rows.withColumns({c: F.when(may, F.col(f"_to.{c}")).otherwise(F.col(c)) for c in ("cost", "cost_text")}).select(*listings.columns)


def find(events: DataFrame, query: str, place: str, past: bool, today: str, most: int = FOUND) -> DataFrame:
    """The first `most` events that a search finds, with truncated: whether there are more.

    A short code, alone or in an address, finds its event at any time. Else the title holds the text, letters of
    ASCII in either case; place is a municipality, UNPLACED or, if unknown, any; past events come newest first."""
    query = (query or "").strip()[:200]
    code = CODE.search(query)
    if code:
        rows = events.where(F.col("short_code") == (code[1] or code[2]).lower())
    else:
        rows = events.where((F.col("local_date") < today) if past else (F.col("local_date") >= today))
        if query:
            upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
            rows = rows.where(F.contains(F.translate("title", upper, lower), F.translate(F.lit(query), upper, lower)))
        if place == UNPLACED:
            rows = rows.where(F.col("municipality_slug").isNull())
        elif place in {m[0] for m in MUNICIPALITIES}:
            rows = rows.where(F.col("municipality_slug") == place)
    order = [F.desc("starts_at") if past and not code else F.asc("starts_at"), F.asc("id")]
    found = rows.orderBy(*order).limit(most + 1)
    return found.withColumns({"nth": F.row_number().over(Window.orderBy(*order)), "truncated": F.count("*").over(Window.partitionBy()) > most}).where(F.col("nth") <= most)


def with_outcome(rows: DataFrame, listings: DataFrame, events: DataFrame) -> DataFrame:
    """rows (with handled_listing_id) and event_code: the short code of the event that they became."""
    became = listings.select(F.col("id").alias("handled_listing_id"), F.col("cluster_id").alias("_cluster"))
    codes = events.select(F.col("id").alias("_cluster"), F.col("short_code").alias("event_code"))
    return rows.join(became, "handled_listing_id", "left").join(codes, "_cluster", "left").select(*rows.columns, "event_code")


def inbox(rows: DataFrame, listings: DataFrame, events: DataFrame, most: int = INBOX, done: int = DONE) -> DataFrame:
    """The newest `most` rows that were sent in (created_at), those that wait and the first `done` of the others,
    with part and nth."""
    newest = rows.orderBy(F.desc("created_at"), "id").limit(most)
    part = F.when(F.col("handled_at").isNull(), "waiting").otherwise("done")
    shown = with_outcome(newest, listings, events).withColumn("part", part)
    shown = shown.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("created_at"), "id")))
    return shown.where((F.col("part") == "waiting") | (F.col("nth") <= done))


#: States that a row of an inbox may leave, and the one it comes to.
INBOX_MOVES = {"accept": (["waiting"], "accepted"), "dismiss": (["waiting"], "dismissed"), "reopen": (["dismissed", "accepted"], "waiting")}


def cluster_listings(events: DataFrame, listings: DataFrame) -> DataFrame:
    """event_id and the columns of each listing that an event is made of."""
    ids = events.select(F.col("id").alias("event_id"), F.explode("listing_ids").alias("id"))
    return ids.join(listings, "id").select("event_id", *listings.columns)


def manual_listings(listings: DataFrame, events: DataFrame, today: str) -> DataFrame:
    """Listings by hand with their event's short code and how many listings it has; part and nth: those to come by
    start, the others by start backwards. Ranks are global ones, so no task sorts a part."""
    own = listings.where(F.col("source_slug") == MANUAL)
    about = events.select(F.col("id").alias("cluster_id"), F.col("short_code").alias("event_code"), F.col("listing_count").alias("event_listings"))
    rows = own.join(about, "cluster_id", "left").withColumn("part", F.when(F.col("local_date") >= today, "upcoming").otherwise("past"))
    rows = rows.withColumn("_start", F.unix_micros("starts_at") * F.when(F.col("part") == "upcoming", 1).otherwise(-1))
    return ranks_within(rows, "part", ["_start", "id"], "nth").withColumn("nth", (F.col("nth") + 1).cast("int")).drop("_start")


def manual_choices(listings: DataFrame, choices: DataFrame, description: Column | None = None) -> DataFrame:
    """Normalized listings by hand with what their form says: place, category (auto: as found), cost and status win
    over what the rules find, and the hash takes them in, so that a choice alone is a change.

    choices: id, municipality_slug, category, cost, status. description: the form's text, whose lines are kept."""
    names = ["municipality_slug", "category", "cost", "status"]
    rows = listings.join(choices.select("id", F.struct(*names).alias("_choice")), "id")
    chosen = {n: F.col(f"_choice.{n}") for n in names} | {"category": F.when(F.col("_choice.category") == "auto", F.col("category")).otherwise(F.col("_choice.category"))}
    text = F.to_json(F.struct(*[v.alias(k) for k, v in zip(("municipalitySlug", "category", "cost", "status"), chosen.values(), strict=True)]), {"ignoreNullFields": "false"})
    made = rows.withColumns(chosen | {"content_hash": hashes.text_hash(F.concat("content_hash", F.lit("|"), text))})
    return (made if description is None else made.withColumn("description", keep_lines(description))).select(*listings.columns)


def save_manual(listings: DataFrame, events: DataFrame, saved: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """listings and events after listings by hand were saved (new ones, or edits by id), and ids of events that wait.

    An edit keeps whether the listing is active, its cluster and when it was first seen. The second table has
    id, event_id and what is to be done: `solo` events are rebuilt from their one listing at once, under
    their id (a new listing's own), `merged` ones by the next de-duplication."""
    stored = saved.withColumns({"cluster_id": F.lit(None).cast("string"), "active": F.lit(True), "first_seen_at": F.lit(now).cast("timestamp"), "last_seen_at": F.lit(now).cast("timestamp"), "removed_at": F.lit(None).cast("timestamp"), "detail_hash": F.lit(None).cast("string"), "detail_attempts": F.lit(0)})
    after = upsert(listings, stored.select(*listings.columns), ["id"], keep=["cluster_id", "active", "first_seen_at", "removed_at", "detail_hash", "detail_attempts"])
    touched = after.join(saved.select("id"), "id", "left_semi").select("id", "cluster_id")
    alone = (F.size("listing_ids") == 1) & (F.get("listing_ids", F.lit(0)) == F.col("id"))
    about = touched.join(events.select(F.col("id").alias("cluster_id"), "listing_ids"), "cluster_id", "left")
    solo = F.col("listing_ids").isNull() | alone
    return after, about.select("id", F.when(solo, F.coalesce(F.when(F.col("listing_ids").isNotNull(), F.col("cluster_id")), "id")).otherwise(F.col("cluster_id")).alias("event_id"), F.when(solo, "solo").otherwise("merged").alias("action"))


def set_active(listings: DataFrame, events: DataFrame, asked: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """listings and events after listings by hand were removed or brought back. asked: id, active.

    Nothing is deleted. An event of that listing alone follows it; a merged one stays as it is."""
    own = asked.join(listings.where(F.col("source_slug") == MANUAL).select("id", "cluster_id"), "id")
    rows = listings.join(own.select("id", F.col("active").alias("_to")), "id", "left")
    moved = F.col("_to").isNotNull()
    flipped = rows.withColumns({"active": F.coalesce("_to", "active"), "removed_at": F.when(moved & F.col("_to"), F.lit(None).cast("timestamp")).when(moved, F.lit(now).cast("timestamp")).otherwise(F.col("removed_at"))})
    follow = own.select(F.col("cluster_id").alias("id"), F.array("id").alias("_only"), F.col("active").alias("_to"))
    joined = events.join(follow, "id", "left")
    there = F.col("_to").isNotNull() & (F.col("listing_ids") == F.col("_only"))
    return flipped.select(*listings.columns), joined.withColumn("active", F.when(there, F.col("_to")).otherwise(F.col("active"))).select(*events.columns)


def quotes(evidence: Column) -> Column:
    """The quotes of a draft by the field that each supports: the texts of a JSON object; anything else is empty."""
    said = F.map_filter(F.from_json(evidence, "map<string,variant>"), lambda _, v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform_values(said, lambda _, v: v.cast("string")), F.create_map().cast("map<string,string>"))


def measured_size(rows: DataFrame, sizes: DataFrame, image: str = "image_url") -> DataFrame:
    """rows and size (width, height): of a picture that was measured; null if it never was or could not be read."""
    known = sizes.where((F.col("width") > 0) & (F.col("height") > 0)).select(F.col("url").alias(image), F.struct("width", "height").alias("size"))
    return rows.join(known, image, "left").select(*rows.columns, "size")


def record_sizes(old: DataFrame, read: DataFrame, now: str) -> DataFrame:
    """Sizes by url after more pictures were read (read: url, width, height; null: it could not be read)."""
    return upsert(old, read.withColumn("checked_at", F.lit(now).cast("timestamp")), ["url"])
