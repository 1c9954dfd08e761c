"""Work that waits: what to read next, who is due, and what was claimed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import contains_money
from ..registry import PRIORITY  # noqa: F401  (kinds of sources, for callers)
from ..shipping import by_value

# Attempts at a page, and how much each queue may take in a run or a day.
ATTEMPTS, DETAILS, COSTS, IMAGES, DIGESTS_RUN, DIGESTS_DAY, SHOWN = 3, 300, 200, 60, 100, 700, 10
LEAST_TEXT, LONGEST_DETAIL = 60, 4000
by_value(__name__)


def enrichment(listings: DataFrame, sources: list[str], today: str, budget: int = DETAILS) -> DataFrame:
    """Listings whose page is to be read: active, to come, no meeting, of such a source, not read since the
    text changed, tried less than ATTEMPTS times; the soonest first."""
    stale = ~F.col("detail_hash").eqNullSafe(F.col("content_hash"))
    rows = listings.where(F.col("active") & (F.col("local_date") >= today) & (F.col("category") != "civic-meeting") & F.col("source_slug").isin(sources) & stale & (F.col("detail_attempts") < ATTEMPTS))
    return rows.orderBy("local_date", "id").limit(budget)


def enriched(listings: DataFrame, details: DataFrame) -> DataFrame:
    """listings after their pages were read. details: id, ok, description, cost_text, image_url. A page adds
    and never erases; a longer description wins; a failure counts an attempt."""
    found = details.select("id", F.struct("ok", "description", "cost_text", "image_url").alias("_d"))
    rows = listings.join(found, "id", "left")
    ok = F.coalesce(F.col("_d.ok"), F.lit(False))
    longer = F.length(F.coalesce("_d.description", F.lit(""))) > F.length(F.coalesce("description", F.lit("")))
    return rows.withColumns({
        "description": F.when(ok & longer, F.substring("_d.description", 1, LONGEST_DETAIL)).otherwise(F.col("description")),
        "cost_text": F.when(ok, F.coalesce("cost_text", "_d.cost_text")).otherwise(F.col("cost_text")),
        "image_url": F.when(ok, F.coalesce("image_url", "_d.image_url")).otherwise(F.col("image_url")),
        "detail_hash": F.when(ok, F.col("content_hash")).otherwise(F.col("detail_hash")),
        "detail_attempts": F.when(ok, 0).when(F.col("_d").isNotNull(), F.col("detail_attempts") + 1).otherwise(F.col("detail_attempts")),
    }).drop("_d")


def costs(listings: DataFrame, decided: DataFrame, detailed: list[str], budget: int = COSTS) -> DataFrame:
    """Listings whose price is to be judged: unknown, long enough, page read or none to read, money in the
    text, not judged for this text. decided: id, content_hash."""
    told = F.length(F.coalesce("description", F.lit(""))) >= LEAST_TEXT
    read = ~F.col("source_slug").isin(detailed) | F.col("detail_hash").isNotNull()
    rows = listings.where(F.col("active") & (F.col("cost") == "unknown") & told & read & contains_money(F.col("description")))
    return rows.join(decided.select("id", "content_hash"), ["id", "content_hash"], "left_anti").orderBy("local_date", "id").limit(budget)


def images(events: DataFrame, measured: DataFrame, wanted: Column, budget: int | None = IMAGES) -> DataFrame:
    """Pictures that were never measured, the commonest first (budget None: all, in no order). measured: url."""
    counts = events.where(F.col("active") & F.col("image_url").isNotNull() & wanted).groupBy(F.col("image_url").alias("url")).agg(F.count("*").alias("uses"))
    unread = counts.join(measured.select("url"), "url", "left_anti")
    return unread if budget is None else unread.orderBy(F.desc("uses"), "url").limit(budget)


def due_digests(calendars: DataFrame, users: DataFrame, sends: DataFrame, date: str, hour: int, weekday: int, spent: int = 0) -> DataFrame:
    """Readers whose digest is due now: verified, hour reached, cadence and day match, period unsent."""
    period = F.concat(F.when(F.col("digest") == "daily", "d:").otherwise("w:"), F.lit(date))
    rows = calendars.join(users.where("verified").select("user_id", "email"), "user_id").withColumn("period_key", period)
    rows = rows.where((F.col("digest_hour") <= hour) & ((F.col("digest") == "daily") | (F.col("digest") == "weekly") & (F.col("digest_day") == weekday)))
    budget = max(0, min(DIGESTS_RUN, DIGESTS_DAY - spent))
    return rows.join(sends.select("user_id", "period_key"), ["user_id", "period_key"], "left_anti").orderBy("digest_hour", "user_id").limit(budget)


def digest_sections(candidates: DataFrame, shown: int = SHOWN) -> DataFrame:
    """What each reader's digest shows. candidates: user_id, section (pins are 0, views follow from 1 in order),
    event_id, starts_at, for every event that a section matches.

    An event stands in the first section that shows it. A section skips what earlier ones showed, and shows
    its first `shown` by start (pins: all). `more`: a section had further ones. Pins leave the views by a
    join. Earlier views take at most `shown` events each from a section, so its first shown * section rows and
    their number decide: no more meet in a reader's group, however many a view matches."""
    window = Window.partitionBy("user_id", "section")
    pinned = candidates.where("section = 0").select("user_id", "event_id").distinct().withColumn("_pinned", F.lit(True))
    rows = candidates.select("user_id", "section", "event_id", "starts_at").join(pinned, ["user_id", "event_id"], "left").where((F.col("section") == 0) | F.col("_pinned").isNull()).drop("_pinned")
    rows = rows.withColumns({"nth": F.row_number().over(window.orderBy("starts_at", "event_id")), "_all": F.count("*").over(window)})
    first = rows.where((F.col("section") > 0) & (F.col("nth") <= shown * F.col("section")))
    kinds = {c: candidates.schema[c].dataType.simpleString() for c in ("user_id", "section", "event_id", "starts_at")}

    def pick(reader: pd.DataFrame) -> pd.DataFrame:
        seen, out = set(), []
        for _, part in reader.sort_values(["section", "nth"]).groupby("section"):
            left = part[~part["event_id"].isin(seen)]
            here = left.head(shown).assign(more=part["_all"].iloc[0] - (len(part) - len(left)) > shown)
            seen.update(here["event_id"])
            out.append(here.assign(nth=range(1, len(here) + 1)))
        return pd.concat(out).drop(columns="_all")

    views = first.groupBy("user_id").applyInPandas(pick, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", nth int, more boolean")
    pins = rows.where("section = 0").select(*kinds, "nth", F.lit(False).alias("more"))
    return pins.unionByName(views.select(*kinds, "nth", "more"))


def next_in_queue(rows: DataFrame, handled: str, day: str, order: list[Column]) -> DataFrame:
    """rows that wait, and the one after each in the queue by (day, order); a queue has null days first.

    Each day is sorted alone. The last of a day is followed by the first of the next day that has any, so
    only one row a day meets in one task, however long the queue is."""
    within = Window.partitionBy(day).orderBy(*order)
    waiting = rows.where(F.col(handled).isNull()).withColumns({"_next": F.lead("id").over(within), "_nth": F.row_number().over(within)})
    firsts = waiting.where("_nth = 1").select(F.col(day).alias("_day"), F.lead("id").over(Window.orderBy(day)).alias("_later"))
    return waiting.join(firsts, F.col(day).eqNullSafe(F.col("_day")), "left").withColumn("next_id", F.coalesce("_next", "_later")).drop("_next", "_nth", "_day", "_later")
