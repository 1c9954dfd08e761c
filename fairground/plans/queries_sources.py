"""Adapters over payloads that are made from the served events, and whole runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from ..registry import ZONE
from ..sources.adapters import raw_events
from ..storage import materialize
from . import oracle as O
from .catalog import query
from .queries_listings import listings
from .runs import deduplicate, ingest
from .standins import homes, served

EV = f"WITH {O.EVENTS}"
WINDOW = ("1990-01-01", "2010-12-31")


def payloads(events: DataFrame, platform: str, payload: Column, **options: str) -> DataFrame:
    given = F.create_map(*[F.lit(x) for pair in ({"timezone": ZONE} | options).items() for x in pair])
    # Slim rows are dealt before payloads are made of them: one small file would be one task of parsing.
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return events.repartition(parts, "n").select(F.col("source_a").alias("source_slug"), F.lit(platform).alias("platform"), given.alias("options"), F.col("n").alias("part"), payload.alias("payload"))


def parsed(events: DataFrame, platform: str, payload: Column, window: tuple[str, str] = WINDOW, **options: str) -> DataFrame:
    return raw_events(payloads(events, platform, payload, **options), window, [platform])[0]


@query(f"""{EV} SELECT id AS external_id, regexp_replace(title, '\\s+', ' ', 'g') AS title, description, local_date || ' ' || local_time || ':00' AS local_start, {O.UNTIMED.replace('all_day OR ', '')} AS all_day, venue_name, address || ', L4M' AS address, cost_text, category || ',' || status AS labels, organizer, image_url, url
FROM ev WHERE active AND ({O.municipality("'x'", "address", "venue_name")} IS NOT NULL)""")
def adapter_tribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REST pages of a regional source: hidden rows go, and rows that an address places nowhere."""
    c = F.col
    named = lambda *cols: F.array(*[F.struct(x.alias("name")) for x in cols])
    body = F.struct(
        F.array(
            F.struct(
                c("id"), c("title"), F.concat(F.lit("<p>"), c("description"), F.lit("</p>")).alias("description"), F.concat_ws(" ", "local_date", F.concat("local_time", F.lit(":00"))).alias("start_date"), (c("time_precision") == "date-only").alias("all_day"), c("cost_text").alias("cost"),
                named(c("category")).alias("categories"), named(c("status")).alias("tags"), F.struct(c("venue_name").alias("venue"), c("address"), F.lit("").alias("city"), F.lit("L4M").alias("zip")).alias("venue"),
                F.when(c("organizer").isNotNull(), F.array(F.struct(c("organizer")))).alias("organizer"), F.struct(c("image_url").alias("url")).alias("image"), c("url"), (~c("active")).alias("hide_from_listings"), F.lit("publish").alias("status"),
            )
        ).alias("events")
    )
    rows = parsed(served(spark, sf_dir), "tribe", F.to_json(body))
    return rows.select("external_id", "title", "description", "local_start", "all_day", "venue_name", "address", "cost_text", F.array_join("categories", ",").alias("labels"), "organizer", "image_url", "url")


@query(f"{EV} SELECT id AS external_id, title || CASE WHEN n % 4 = 0 THEN ' — Part two' ELSE '' END AS title, local_date || 'T' || local_time AS local_start, venue_name, CASE WHEN n % 5 = 0 THEN 'Free' WHEN n % 5 < 3 THEN '$' || CAST(n % 5 AS VARCHAR) END AS cost_text, CASE WHEN n % 5 = 0 THEN TRUE END AS is_free, category AS labels, url FROM ev WHERE n % 9 <> 0 AND n % 11 <> 0")
def adapter_communico(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library's list: private and online rows go."""
    c, n = F.col, F.col("n")
    fee = F.when(n % 5 < 3, (n % 5).cast("string"))
    body = F.array(F.struct(c("id"), c("title"), F.when(n % 4 == 0, "Part two").alias("sub_title"), F.concat_ws("T", "local_date", "local_time").alias("event_start"), F.when(n % 9 == 0, "1").otherwise("0").alias("private_event"), F.when(n % 11 == 0, "ONLINE").otherwise("INPERSON").alias("event_type"), c("venue_name").alias("location"), fee.alias("registration_cost"), F.lit("0").alias("enable_billing"), F.array("category").alias("tagsArray"), c("url")))
    rows = parsed(served(spark, sf_dir), "communico", F.to_json(body), origin="lib.example.org")
    return rows.select("external_id", "title", "local_start", "venue_name", "cost_text", "is_free", F.array_join("categories", ",").alias("labels"), "url")


@query(f"""{EV} SELECT id AS external_id, title || ', part; two' AS title, CASE WHEN time_precision = 'date-only' THEN local_date || 'T00:00' ELSE strftime(CAST(replace(starts_at_utc, 'Z', '') AS TIMESTAMP) AT TIME ZONE 'UTC' AT TIME ZONE 'America/Toronto', '%Y-%m-%dT%H:%M') END AS local_start,
  CASE WHEN time_precision = 'date-only' THEN local_date || 'T23:59' END AS local_end, time_precision, CASE WHEN regexp_matches(substr(place, strpos(place || ',', ',')), '[0-9]') THEN split_part(place, ',', 1) ELSE place END AS venue_name,
  CASE WHEN regexp_matches(substr(place, strpos(place || ',', ',')), '[0-9]') THEN place END AS address, url FROM (SELECT *, concat_ws(', ', venue_name, address) AS place FROM ev) WHERE local_date BETWEEN '1997-01-01' AND '1999-12-31'""")
def adapter_ics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar feeds: folded and escaped lines, dates and UTC instants, only the window."""
    c = F.col
    text = lambda x: F.replace(F.replace(x, F.lit(","), F.lit("\\,")), F.lit(";"), F.lit("\\;"))
    day = F.replace(c("local_date"), F.lit("-"), F.lit(""))
    start = F.when(c("time_precision") == "date-only", F.concat(F.lit("DTSTART;VALUE=DATE:"), day, F.lit("\r\nDTEND;VALUE=DATE:"), F.date_format(F.date_add(F.to_date("local_date"), 1), "yyyyMMdd"))).otherwise(F.concat(F.lit("DTSTART:"), F.date_format("starts_at", "yyyyMMdd'T'HHmmss'Z'")))
    title = F.concat(F.lit("SUMMARY:"), text(F.concat("title", F.lit(", part; two"))))
    folded = F.concat(F.substring(title, 1, 20), F.lit("\r\n "), F.substring(title, 21, 500))
    lines = [F.lit("BEGIN:VCALENDAR"), F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), c("id")), start, folded, F.concat(F.lit("LOCATION:"), text(F.concat_ws(", ", "venue_name", "address"))), F.concat(F.lit("URL:"), c("url")), F.lit("END:VEVENT"), F.lit("END:VCALENDAR")]
    rows = parsed(served(spark, sf_dir), "ics", F.concat_ws("\r\n", *lines), window=("1997-01-01", "1999-12-31"))
    return rows.select("external_id", "title", "local_start", "local_end", "time_precision", "venue_name", "address", "url")


@query(f"{EV} SELECT '/e/' || id || '@' || local_date AS external_id, title, local_date || 'T' || local_time AS local_start, coalesce(venue_name, 'CFB Borden') AS venue_name, 'https://x.example.org/e/' || id AS url FROM ev WHERE n % 6 <> 0")
def adapter_cfmws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page with its list in a script: virtual rows go."""
    hour = F.substring("local_time", 1, 2).cast("int")
    said = F.concat(F.col("local_date"), F.lit(" "), (F.pmod(hour + 11, F.lit(12)) + 1).cast("string"), F.substring("local_time", 3, 3), F.lit(":11 "), F.when(hour < 12, "a.m.").otherwise("p.m."))
    body = F.array(F.struct(F.col("title").alias("event_name"), said.alias("event_startdate"), F.lit("None").alias("event_recurrence"), F.col("venue_name").alias("event_location"), (F.col("n") % 6 == 0).alias("event_virtual"), F.concat(F.lit("/e/"), F.col("id")).alias("event_externalurl")))
    page = F.concat(F.lit("<html><script>var a = ']'; var loadedData = "), F.to_json(body), F.lit("; draw(loadedData)</script></html>"))
    rows = parsed(served(spark, sf_dir), "cfmws", page, place="CFB Borden", origin="https://x.example.org")
    return rows.select("external_id", "title", "local_start", "venue_name", "url")


@query(f"{EV} SELECT id AS external_id, title, local_date FROM ev UNION ALL SELECT id || 'b', 'Also ' || title, local_date FROM ev WHERE n % 2 = 0")
def adapter_libcal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several calendars of a library: only those that it lists, and an event of two of them once."""
    c = F.col
    entry = lambda uid, title: F.concat(F.lit("BEGIN:VEVENT\r\nUID:"), uid, F.lit("\r\nDTSTART;VALUE=DATE:"), F.replace(c("local_date"), F.lit("-"), F.lit("")), F.lit("\r\nSUMMARY:"), title, F.lit("\r\nEND:VEVENT\r\n"))
    feed = lambda *entries: F.concat(F.lit("BEGIN:VCALENDAR\r\n"), *entries, F.lit("END:VCALENDAR"))
    own, more = entry(c("id"), c("title")), F.when(c("n") % 2 == 0, entry(F.concat("id", F.lit("b")), F.concat(F.lit("Also "), c("title")))).otherwise("")
    feeds = F.to_json(F.create_map(F.lit("8312"), feed(own), F.lit("8313"), feed(own, more), F.lit("1"), feed(entry(F.concat("id", F.lit("x")), c("title")))))
    rows = parsed(served(spark, sf_dir), "libcal", feeds, calendars="8312,8313")
    return rows.select("external_id", "title", F.substring("local_start", 1, 10).alias("local_date"))


@query(f"{EV} SELECT id AS external_id, regexp_replace(title, '\\s+', ' ', 'g') AS title, '2000' || substr(local_date, 5) || 'T' || CASE WHEN time_precision = 'date-only' THEN '00:00' ELSE local_time END AS local_start, time_precision, address, category AS labels, 'https://c.example.org/default/Detail/' || id AS url FROM ev WHERE category <> 'other'")
def adapter_govstack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List pages: days without a year (all in the window's one year), times of 12 hours, a category between link and paragraph."""
    c = F.col
    hour = F.substring("local_time", 1, 2).cast("int")
    time = F.when(c("time_precision") == "date-only", "All day").otherwise(F.concat((F.pmod(hour + 11, F.lit(12)) + 1).cast("string"), F.substring("local_time", 3, 3), F.when(hour < 12, " AM").otherwise(" PM")))
    label = F.when(c("category") == "other", "Council").otherwise(c("category"))
    html = F.concat(
        F.lit('<p>(1 Results Found)</p><div class="icrt-calendarListItem"><span class="date"> '), F.dayofmonth(F.to_date("local_date")).cast("string"), F.lit(' </span><span class="month">'), F.date_format(F.to_date("local_date"), "MMM"),
        F.lit('</span><a class="meta-title" href="/default/Detail/'), c("id"), F.lit('">'), c("title"), F.lit("</a> <em>"), label, F.lit("</em><p>"), time, F.lit(" <span>|</span> "), c("address"), F.lit('</p><div class="icrt-calendarListItemDesc"><p>'), c("description"), F.lit("</p></div></div>"),
    )
    rows = parsed(served(spark, sf_dir), "govstack", html, window=("2000-01-01", "2000-12-31"), origin="c.example.org")
    return rows.select("external_id", "title", "local_start", "time_precision", "address", F.array_join("categories", ",").alias("labels"), "url")


@query(f"{O.BASE}, {O.EVENTS} SELECT source_a AS source_slug, 'insert' AS action, count(*) AS listings FROM ev WHERE NOT {O.has('trim(title)', O.NOT_EVENT)} GROUP BY source_a UNION ALL SELECT source_slug, 'remove', count(*) FROM listings GROUP BY source_slug")
def ingest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole ingest of feeds against the listings that an earlier run left; tests check its parts."""
    feeds = served(spark, sf_dir)
    body = F.concat_ws("\n", F.lit("BEGIN:VCALENDAR"), F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("id")), F.concat(F.lit("DTSTART:"), F.date_format("starts_at", "yyyyMMdd'T'HHmmss'Z'")), F.concat(F.lit("SUMMARY:"), F.col("title")), F.lit("END:VEVENT"), F.lit("END:VCALENDAR"))
    before = F.lit("2020-01-01").cast("timestamp")
    stored = materialize(listings(spark, sf_dir), "stored").withColumns({"cluster_id": F.lit(None).cast("string"), "first_seen_at": before, "last_seen_at": before, "removed_at": F.lit(None).cast("timestamp"), "detail_hash": F.lit(None).cast("string"), "detail_attempts": F.lit(0)})
    done = ingest(payloads(feeds, "ics", body), WINDOW, homes(spark), stored, "2026-01-02", ["ics"])
    return done.decided.groupBy("source_slug", "action").agg(F.count("*").alias("listings"))


_VERDICTS = "count(*) AS pairs, count(*) FILTER (verdict = 'same') AS same, count(*) FILTER (verdict = 'distinct') AS distinct_, count(*) FILTER (verdict = 'ambiguous') AS ambiguous"


@query(f"{O.BASE}, {O.FEATURES}, {O.PAIRS}, c AS (SELECT {_VERDICTS} FROM verdicts) SELECT 'first' AS run, pairs, 0 AS cached, same, distinct_ AS \"distinct\", ambiguous, (SELECT count(*) FROM listings) AS assigned, 0 AS closed FROM c UNION ALL SELECT 'second', pairs, same + distinct_, same, distinct_, ambiguous, 0, 0 FROM c")
def dedup_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole second de-duplication after a first: verdicts are remembered and nothing changes; stats of both."""
    rows = materialize(listings(spark, sf_dir), "listings").withColumn("cluster_id", F.lit(None).cast("string"))
    priorities = homes(spark).select(F.col("slug").alias("source_slug"), "priority")
    none = spark.createDataFrame([], "id string, created_at timestamp")
    first = deduplicate(rows, priorities, none, spark.createDataFrame([], "a string, b string, hash_a string, hash_b string, verdict string, method string"))
    made = materialize(first.events.select("id"), "made")
    known = rows.drop("cluster_id").join(materialize(first.assignments, "assigned"), "id", "left")
    second = deduplicate(known, priorities, made.withColumn("created_at", F.lit("2026-01-01").cast("timestamp")), materialize(first.decisions, "decisions"))
    counts = lambda d, name: d.stats.select(F.lit(name).alias("run"), "pairs", "cached", "same", "distinct", "ambiguous").join(F.broadcast(d.assignments.agg(F.count("*").alias("assigned"))), F.lit(True)).join(F.broadcast(d.closed.agg(F.count("*").alias("closed"))), F.lit(True))
    return counts(first, "first").union(counts(second, "second"))



