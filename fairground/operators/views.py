"""Counts, lists and texts that readers are served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times
from .filters import UNPLACED


def facets(events: DataFrame) -> DataFrame:
    """Events by municipality (none: UNPLACED) and by category, in one pass: facet, key, n."""
    rows = events.select(F.coalesce("municipality_slug", F.lit(UNPLACED)).alias("place"), "category")
    sets = rows.groupingSets([["place"], ["category"]], "place", "category").agg(F.count("*").alias("n"), F.grouping("place").alias("_by"))
    return sets.select(F.when(F.col("_by") == 0, "place").otherwise("category").alias("facet"), F.coalesce("place", "category").alias("key"), "n")


def place_counts(municipalities: DataFrame, events: DataFrame) -> DataFrame:
    """Active events of every municipality, none included."""
    counts = events.where("active").groupBy(F.col("municipality_slug").alias("slug")).agg(F.count("*").alias("n"))
    return municipalities.join(F.broadcast(counts), "slug", "left").select("slug", "name", F.coalesce("n", F.lit(0)).alias("events"))


def source_health(sources: DataFrame, listings: DataFrame, runs: DataFrame) -> DataFrame:
    """Active listings, the last sight of one, and how the last run went, of every source."""
    active = listings.where("active").groupBy(F.col("source_slug").alias("slug")).agg(F.count("*").alias("n"), F.max("last_seen_at").alias("last_seen"))
    last = runs.groupBy(F.col("source_slug").alias("slug")).agg(F.max_by("ok", "started_at").alias("last_run_ok"), F.max("started_at").alias("last_run"))
    return sources.join(active, "slug", "left").join(last, "slug", "left").select("slug", F.coalesce("n", F.lit(0)).alias("listings"), "last_seen", "last_run", "last_run_ok")


def first_of_day(events: DataFrame, day: str, most: int, order: list[Column]) -> DataFrame:
    """The first `most` events of each day and how many more there are."""
    window = Window.partitionBy(day)
    rows = events.withColumns({"nth": F.row_number().over(window.orderBy(*order)), "_all": F.count("*").over(window)})
    return rows.where(F.col("nth") <= most).withColumn("more", F.greatest(F.col("_all") - most, F.lit(0))).drop("_all")


def runaway_series(rows: DataFrame, keys: list[str], day: str, least: int = 90) -> DataFrame:
    """Keys whose days hold a run of `least` consecutive ones."""
    days = rows.select(*keys, F.to_date(day).alias("d")).distinct()
    island = F.date_sub("d", F.row_number().over(Window.partitionBy(*keys).orderBy("d")))
    runs = days.withColumn("_i", island).groupBy(*keys, "_i").agg(F.count("*").alias("run"))
    return runs.groupBy(*keys).agg(F.max("run").alias("longest")).where(F.col("longest") >= least)


def rate_limited(attempts: DataFrame, key: str, moment: str, most: int, seconds: int = 3600) -> DataFrame:
    """attempts with recent (how many of its key came in the `seconds` before it) and allowed."""
    window = Window.partitionBy(key).orderBy(F.unix_micros(moment)).rangeBetween(-seconds * 1_000_000, -1)
    return attempts.withColumn("recent", F.count("*").over(window)).withColumn("allowed", F.col("recent") < most)


def sessions(touches: DataFrame, user: str, moment: str, idle: str = "30 days") -> DataFrame:
    """Spans in which a user was never away for longer than idle."""
    return touches.groupBy(user, F.session_window(moment, idle).alias("s")).agg(F.count("*").alias("touches")).select(user, F.col("s.start").alias("started_at"), "touches")


def stand_columns(events: DataFrame, now: str) -> DataFrame:
    """events with finished, spans_days, runs_today, on_now and list_date at a moment."""
    untimed = F.col("all_day") | (F.col("time_precision") == "date-only")
    found = times.stand(F.lit(now).cast("timestamp"), F.col("starts_at"), F.col("ends_at"), F.col("local_date"), F.col("local_time"), untimed, F.col("timezone"))
    return events.withColumns(found)


def structured_data(events: DataFrame, origin: str) -> DataFrame:
    """id and json_ld: an event as search engines read it; free is said only where the cost is known."""
    # The names of an event's states there.
    state = F.when(F.col("status") == "cancelled", "https://schema.org/EventCancelled").when(F.col("status") == "rescheduled", "https://schema.org/EventRescheduled").otherwise("https://schema.org/EventScheduled")
    start = F.when(F.col("time_precision") == "date-only", F.col("local_date")).otherwise(times.iso(F.col("starts_at")))
    place = F.struct(F.lit("Place").alias("@type"), F.coalesce("venue_name", "municipality_slug", F.lit("Unspecified")).alias("name"), F.coalesce("address", "municipality_slug").alias("address"))
    body = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Event").alias("@type"), F.col("title").alias("name"), start.alias("startDate"), times.iso(F.col("ends_at")).alias("endDate"), state.alias("eventStatus"), place.alias("location"), F.when(F.col("cost") == "free", True).when(F.col("cost") == "paid", False).alias("isAccessibleForFree"), F.concat(F.lit(f"{origin}/event/"), F.col("id")).alias("url"))
    return events.select("id", F.to_json(body).alias("json_ld"))


def event_page_json(page: DataFrame, order: list[str]) -> DataFrame:
    """One row, json: {count, truncated, events} of a page that filters.page() gave, in the order of these columns.

    A page has a cap, so its rows fit in one."""
    rows = page.select("truncated", F.struct(*order, F.struct(*[c for c in page.columns if c != "truncated"]).alias("event")).alias("row"))
    events = F.transform(F.array_sort(F.collect_list("row")), lambda x: x["event"])
    whole = rows.agg(F.count("*").alias("count"), F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"), events.alias("events"))
    return whole.select(F.to_json(F.struct("count", "truncated", "events"), {"ignoreNullFields": "false"}).alias("json"))


LISTED = 50


def _item(position: Column, name: Column, address: Column, key: str) -> Column:
    return F.struct(F.lit("ListItem").alias("@type"), position.alias("position"), name.alias("name"), address.alias(key))


def breadcrumbs(site: str, origin: str, name: Column, address: Column) -> Column:
    """The way from the site to a page, as search engines read it: positions from 1."""
    steps = F.array(_item(F.lit(1), F.lit(site), F.lit(f"{origin}/"), "item"), _item(F.lit(2), name, address, "item"))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("BreadcrumbList").alias("@type"), steps.alias("itemListElement")))


def item_lists(upcoming: DataFrame, group: str, heading: Column, origin: str, most: int = LISTED) -> DataFrame:
    """group and json_ld: the first `most` of its events by start, as search engines read a list, and how many there are.

    upcoming: group, id, title, short_code, starts_at. Only the first of each group are gathered."""
    window = Window.partitionBy(group)
    rows = upcoming.withColumns({"_nth": F.row_number().over(window.orderBy("starts_at", "id")), "_all": F.count("*").over(window)}).where(F.col("_nth") <= most)
    item = _item(F.col("_nth"), F.col("title"), F.concat(F.lit(f"{origin}/e/"), F.col("short_code")), "url")
    lists = rows.groupBy(group).agg(F.max("_all").alias("_all"), F.array_sort(F.collect_list(F.struct(F.col("_nth").alias("n"), item.alias("item")))).alias("_items"))
    body = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("ItemList").alias("@type"), heading.alias("name"), F.col("_all").alias("numberOfItems"), F.transform("_items", lambda x: x["item"]).alias("itemListElement"))
    return lists.select(group, F.to_json(body).alias("json_ld"))


def live_pins(pins: DataFrame, events: DataFrame, today: str | None = None) -> DataFrame:
    """user_id and the columns of the active events that each reader pinned (pins: user_id, event_id): what a
    private or shared feed holds. today: only those whose last day has not passed, as a shared page shows."""
    rows = pins.select("user_id", F.col("event_id").alias("id")).distinct().join(events.where("active"), "id")
    if today is not None:
        rows = rows.where(times.last_date(F.col("local_date"), F.col("ends_at"), F.col("timezone")) >= today)
    return rows.select("user_id", *events.columns)
