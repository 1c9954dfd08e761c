"""Raw events to listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashes, places, rules, times, titles
from ..functions.text import clean
from ..schemas import LISTING

FIELDS = ["title", "description", "local_start", "local_end", "all_day", "time_precision", "venue_name", "address", "cost_text", "is_free", "categories", "organizer", "image_url", "url"]


def judged(raw: DataFrame) -> DataFrame:
    """raw and reason: why a row is no listing (null: it is one).

    Not public; a later copy of an id among the public rows of its source (the first takes the id even if
    its own time can't be read); a start or end that is no time."""
    untimed = F.coalesce("all_day", F.lit(False)) | F.coalesce(F.col("time_precision") == "date-only", F.lit(False))
    public = rules.is_public(F.col("title"), F.col("categories"), untimed)
    first = Window.partitionBy("source_slug", "external_id", "_public").orderBy("position")
    start, end = (times.naive(times.wall_string(F.col(c))) for c in ("local_start", "local_end"))
    return (
        raw.withColumn("_public", public)
        .withColumn("_nth", F.row_number().over(first))
        .withColumn("reason", F.when(~F.col("_public"), "not a public event").when(F.col("_nth") > 1, "duplicate external id in batch").when(start.isNull() | (F.coalesce("local_end", F.lit("")) != "") & end.isNull(), "unreadable time"))
        .drop("_public", "_nth")
    )


def normalize(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """Listings of the rows of raw (judged) without a reason. sources: slug, kind, municipality_slug, timezone; small, broadcast."""
    about = F.broadcast(sources.select(F.col("slug").alias("source_slug"), F.col("kind").alias("source_kind"), F.col("municipality_slug").alias("_home"), "timezone"))
    rows = raw.where(F.col("reason").isNull()).join(about, "source_slug")
    start, end = times.wall_string(F.col("local_start")), times.wall_string(F.col("local_end"))
    description = clean(F.col("description"))
    labels = F.filter(F.transform("categories", lambda c: F.trim(c)), lambda c: c != "")
    title = F.coalesce(clean(titles.clean_title(F.coalesce("title", F.lit("")))), F.lit("Untitled event"))
    rows = rows.withColumns({"_title": title, "_description": description, "_labels": labels, "_starts": times.wall_to_utc(start, F.col("timezone")), "_ends": times.wall_to_utc(end, F.col("timezone")), "_wall": start})
    named = places.resolve_municipality
    return rows.select(
        hashes.listing_id(F.col("source_slug"), F.col("external_id")).alias("id"),
        "source_slug",
        "source_kind",
        "external_id",
        F.coalesce(named(F.col("municipality_hint"), F.col("address"), F.col("venue_name")), F.col("_home"), named(F.col("title")), named(F.col("_description"))).alias("municipality_slug"),
        F.col("_title").alias("title"),
        F.col("_description").alias("description"),
        rules.classify(F.col("_title"), F.col("_labels")).alias("category"),
        F.col("_labels").alias("source_categories"),
        F.col("_starts").alias("starts_at"),
        F.when(F.col("_ends") >= F.col("_starts"), F.col("_ends")).alias("ends_at"),
        F.substring("_wall", 1, 10).alias("local_date"),
        F.substring("_wall", 12, 5).alias("local_time"),
        "timezone",
        F.coalesce("time_precision", F.lit("exact")).alias("time_precision"),
        F.coalesce("all_day", F.lit(False)).alias("all_day"),
        clean(F.col("venue_name")).alias("venue_name"),
        clean(F.col("address")).alias("address"),
        rules.assess_cost(F.col("is_free"), F.col("cost_text"), F.col("_title"), F.col("_description"))["cost"].alias("cost"),
        clean(F.col("cost_text")).alias("cost_text"),
        clean(F.col("organizer")).alias("organizer"),
        clean(F.col("image_url")).alias("image_url"),
        "url",
        F.coalesce(titles.stated_status(F.coalesce("title", F.lit(""))), F.lit("scheduled")).alias("status"),
        F.lit(True).alias("active"),
        hashes.content_hash({f: F.col(f) for f in FIELDS}).alias("content_hash"),
    ).select(*LISTING)
