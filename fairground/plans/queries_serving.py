"""What readers are served: filtered pages, searches, facets, counts, feeds, queues and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import feeds, images, text, times
from ..operators import filters as fl
from ..operators import overrides as ov
from ..operators import queues, views
from ..operators.reconcile import insert_absent, move_states, upsert
from ..registry import GAZETTEER, MUNICIPALITIES, VENUES, municipalities, sources, venues
from . import oracle as O
from .catalog import query
from .standins import served, table

EV = f"WITH {O.EVENTS}"
PLACES = "places(slug, name) AS (VALUES " + ", ".join(f"({O.q(m[0])}, {O.q(m[1])})" for m in MUNICIPALITIES) + ")"
NOON = "2000-03-15T17:00:00.000Z"
TODAY = "2000-03-15"


def with_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.with_places(served(spark, sf_dir), municipalities(spark))


def _select(spark: SparkSession, sf_dir: str, asked: str) -> DataFrame:
    return fl.select(with_places(spark, sf_dir), fl.Filters.parse(asked)).select("id")


def _filter(name: str, asked: str, where: str) -> None:
    sql = f"{EV}, {PLACES}, named AS (SELECT ev.*, p.name AS municipality_name FROM ev LEFT JOIN places p ON p.slug = municipality_slug) SELECT id FROM named WHERE active AND {where}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _select(spark, sf_dir, asked)

    run.__name__ = name
    query(sql)(run)


HIDDEN, UNPAID = "category <> 'civic-meeting'", "cost <> 'paid'"
FOLDED = "lower(strip_accents(concat_ws(chr(10), title, coalesce(description, ''), coalesce(venue_name, ''), coalesce(address, ''), coalesce(organizer, ''), coalesce(municipality_name, ''))))"
_filter("filter_default", "", f"{HIDDEN} AND {UNPAID}")
_filter("filter_places", "m=barrie,unspecified", f"{HIDDEN} AND {UNPAID} AND (municipality_slug = 'barrie' OR municipality_slug IS NULL)")
_filter("filter_only_unplaced", "m=unspecified&cost=all", f"{HIDDEN} AND municipality_slug IS NULL")
_filter("filter_category_status", "cat=music,civic-meeting&status=scheduled,cancelled&cost=all", "category IN ('music', 'civic-meeting') AND status IN ('scheduled', 'cancelled')")
_filter("filter_free", "cost=free", f"{HIDDEN} AND cost = 'free'")
_filter("filter_paid_civic", "cost=paid&civic=1", "cost = 'paid'")
_filter("filter_sources", "src=src2,src5&cost=all", f"{HIDDEN} AND (source_a IN ('src2', 'src5') OR source_b IN ('src2', 'src5'))")
_filter("filter_from_to", "from=2000-01-10&to=2000-02-20", f"{HIDDEN} AND {UNPAID} AND (local_date >= '2000-01-10' OR ends_at_utc >= '2000-01-10T00:00:00.000Z') AND local_date <= '2000-02-20'")
_filter("filter_since", "since=2000-03-15&cost=all", f"{HIDDEN} AND (local_date >= '2000-03-15' OR ends_at_utc >= '2000-03-15T00:00:00.000Z')")
_filter("filter_before", "before=2000-03-15&cost=all", f"{HIDDEN} AND local_date < '2000-03-15' AND (ends_at_utc IS NULL OR ends_at_utc < '2000-03-15T00:00:00.000Z')")
_filter("search_words", "q=CAF%C3%89+maple&cost=all&civic=1", f"contains({FOLDED}, 'cafe') AND contains({FOLDED}, 'maple')")
_filter("search_phrase", "q=%22farmers+market%22+barrie&cost=all", f"{HIDDEN} AND contains({FOLDED}, 'farmers market') AND contains({FOLDED}, 'barrie')")


@query(f"{EV}, shown AS (SELECT id, starts_at_utc, row_number() OVER (ORDER BY starts_at_utc, id) AS n, count(*) OVER () AS total FROM ev WHERE active AND {HIDDEN} AND {UNPAID}) SELECT id, starts_at_utc, total > 100 AS truncated FROM shown WHERE n <= 100")
def event_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GET of the first hundred events: a report with a limit."""
    return fl.page(with_places(spark, sf_dir), fl.Filters.parse(""), 100).select("id", "starts_at_utc", "truncated")


@query(f"{EV} SELECT CASE WHEN local_date >= '2000-03-15' OR coalesce(ends_at_utc >= '2000-03-15T00:00:00.000Z', FALSE) THEN 'since' ELSE 'before' END AS half, count(*) AS events FROM ev WHERE active AND {HIDDEN} GROUP BY half")
def halves_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two halves of a calendar, which share no event and leave out none."""
    events = with_places(spark, sf_dir)
    halves = [fl.select(events, fl.Filters.parse(f"{h}=2000-03-15&cost=all")).select(F.lit(h).alias("half"), "id") for h in ("since", "before")]
    return halves[0].union(halves[1]).groupBy("half").agg(F.count("*").alias("events"))


@query(f"{EV}, shown AS (SELECT coalesce(municipality_slug, 'unspecified') AS place, category FROM ev WHERE active AND {HIDDEN} AND {UNPAID} AND local_date >= '2000-01-01') SELECT 'place' AS facet, place AS key, count(*) AS n FROM shown GROUP BY place UNION ALL SELECT 'category', category, count(*) FROM shown GROUP BY category")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = fl.select(with_places(spark, sf_dir), fl.Filters.parse("")).where("local_date >= '2000-01-01'")
    return views.facets(chosen)


@query(f"{EV} SELECT count(*) FILTER ({UNPAID}) AS matches, count(*) AS total, count(DISTINCT municipality_slug) AS places FROM ev WHERE active AND {HIDDEN}")
def stats_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = fl.select(served(spark, sf_dir).withColumn("municipality_name", F.lit(None).cast("string")), fl.Filters.parse("cost=all"))
    return shown.agg(F.count_if(F.col("cost") != "paid").alias("matches"), F.count("*").alias("total"), F.count_distinct("municipality_slug").alias("places"))


@query(f"{EV}, {PLACES} SELECT slug, name, count(ev.id) AS events FROM places LEFT JOIN ev ON slug = municipality_slug AND active GROUP BY slug, name")
def place_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.place_counts(municipalities(spark), served(spark, sf_dir))


@query(f"{EV} SELECT category, count(*) AS events FROM ev WHERE active GROUP BY category")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return served(spark, sf_dir).where("active").groupBy("category").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "category")


RUNS = "runs AS (SELECT 'src' || CAST(user_id % 9 AS VARCHAR) AS slug, ts AS started_at, event_type <> 'error' AS ok, event_id FROM events)"


@query(f"""{EV}, {RUNS}, s AS (SELECT 'src' || CAST(i AS VARCHAR) AS slug FROM range(0, 10) t(i)),
n AS (SELECT source_a AS slug, count(*) AS n, max(starts_at_utc) AS seen FROM ev WHERE active GROUP BY source_a), r AS (SELECT slug, arg_max(ok, (started_at, event_id)) AS ok FROM runs GROUP BY slug)
SELECT slug, coalesce(n, 0) AS listings, seen AS last_seen, ok AS last_run_ok FROM s LEFT JOIN n USING (slug) LEFT JOIN r USING (slug)""")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.concat(F.lit("src"), (F.col("user_id") % 9).cast("string")).alias("source_slug"), F.struct("ts", "event_id").alias("started_at"), (F.col("event_type") != "error").alias("ok"))
    all_sources = spark.range(10).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("slug"))
    listings = served(spark, sf_dir).select(F.col("source_a").alias("source_slug"), "active", F.col("starts_at_utc").alias("last_seen_at"))
    return views.source_health(all_sources, listings, runs).select("slug", "listings", "last_seen", "last_run_ok")


@query(f"{EV}, {RUNS} SELECT (SELECT count(*) FROM ev WHERE active) AS active_events, (SELECT strftime(max(started_at), '%Y-%m-%d %H:%M:%S') FROM runs) AS last_run")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = served(spark, sf_dir).where("active").agg(F.count("*").alias("active_events"))
    return active.join(F.broadcast(table(spark, sf_dir, "events").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_run"))), F.lit(True))


@query(f"{RUNS} SELECT slug, count(*) AS runs, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed FROM runs GROUP BY slug".replace("runs AS", "WITH runs AS", 1))
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.concat(F.lit("src"), (F.col("user_id") % 9).cast("string")).alias("slug"), (F.col("event_type") != "error").alias("ok"))
    return runs.groupBy("slug").agg(F.count("*").alias("runs"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))


@query(f"{EV} SELECT cost, count(*) FILTER (category IN ('arts', 'music')) AS culture, count(*) FILTER (category = 'sports') AS sports, count(*) FILTER (municipality_slug IS NULL) AS unplaced FROM ev GROUP BY cost")
def cost_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = F.count_if
    return served(spark, sf_dir).groupBy("cost").agg(count(F.col("category").isin("arts", "music")).alias("culture"), count(F.col("category") == "sports").alias("sports"), count(F.col("municipality_slug").isNull()).alias("unplaced"))


UNTIMED = "time_precision = 'date-only'"
LAST = "greatest(local_date, coalesce(strftime(CAST(replace(ends_at_utc, 'Z', '') AS TIMESTAMP) AT TIME ZONE 'UTC' AT TIME ZONE 'America/Toronto', '%Y-%m-%d'), local_date))"
STAND = f"""stand AS (SELECT *, {LAST} AS last_date, strftime(CAST(replace(ends_at_utc, 'Z', '') AS TIMESTAMP) AT TIME ZONE 'UTC' AT TIME ZONE 'America/Toronto', '%H:%M') AS until FROM ev),
s2 AS (SELECT *, CASE WHEN NOT {UNTIMED} AND ends_at_utc IS NOT NULL THEN ends_at_utc <= '{NOON}' ELSE last_date < '{TODAY}' END AS finished,
  coalesce(epoch(CAST(replace(ends_at_utc, 'Z', '') AS TIMESTAMP)) - epoch(CAST(replace(starts_at_utc, 'Z', '') AS TIMESTAMP)) >= 86400, FALSE) AS spans_days FROM stand),
s3 AS (SELECT *, CASE WHEN {UNTIMED} THEN local_date <= '{TODAY}' ELSE starts_at_utc <= '{NOON}' END AND NOT finished AS runs_today FROM s2),
s4 AS (SELECT *, runs_today AND (NOT spans_days OR {UNTIMED} OR CASE WHEN coalesce(local_time < until AND local_time <> '00:00', FALSE) THEN '12:00' >= local_time AND '12:00' < until ELSE TRUE END) AS on_now,
  CASE WHEN local_date < '{TODAY}' AND runs_today THEN '{TODAY}' ELSE local_date END AS list_date FROM s3)"""


@query(f"{EV}, {STAND} SELECT id, finished, spans_days, runs_today, on_now, list_date FROM s4")
def event_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.stand_columns(served(spark, sf_dir), NOON).select("id", "finished", "spans_days", "runs_today", "on_now", "list_date")


@query(f"{EV}, {STAND}, p AS (SELECT * FROM s4 WHERE active AND municipality_slug = 'tay' AND {HIDDEN}) SELECT * FROM (SELECT id, 'upcoming' AS part FROM p WHERE on_now OR NOT finished ORDER BY starts_at_utc, id LIMIT 120) UNION ALL SELECT * FROM (SELECT id, 'past' FROM p WHERE NOT on_now AND finished ORDER BY starts_at_utc DESC, id LIMIT 12)")
def place_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place's page: what comes (120 at most) and what was (12 at most); paid events too."""
    rows = views.stand_columns(served(spark, sf_dir), NOON).where("active AND municipality_slug = 'tay' AND category <> 'civic-meeting'")
    ahead, past = F.col("on_now") | ~F.col("finished"), ~F.col("on_now") & F.col("finished")
    return rows.where(ahead).orderBy("starts_at", "id").limit(120).select("id", F.lit("upcoming").alias("part")).union(rows.where(past).orderBy(F.desc("starts_at"), "id").limit(12).select("id", F.lit("past").alias("part")))


@query(f"{EV} SELECT id, local_date FROM ev WHERE active AND {HIDDEN} AND local_date >= '1999-03-16' ORDER BY starts_at_utc DESC, id LIMIT 20000")
def sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages for search engines: events since the cutoff, the latest first; a cap of 20,000 is the feature."""
    return served(spark, sf_dir).where("active AND category <> 'civic-meeting' AND local_date >= '1999-03-16'").orderBy(F.desc("starts_at"), "id").limit(20000).select("id", "local_date")


@query(f"{EV}, n AS (SELECT *, row_number() OVER (PARTITION BY local_date ORDER BY user_id % 17 = 3 DESC, starts_at_utc, id) AS nth, count(*) OVER (PARTITION BY local_date) AS c FROM ev WHERE active) SELECT id, local_date, nth::INTEGER AS nth, greatest(c - 3, 0) AS more FROM n WHERE nth <= 3")
def top3_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three of each day, pinned ones first, and how many more there are."""
    pinned = F.col("user_id") % 17 == 3
    return views.first_of_day(served(spark, sf_dir).where("active"), "local_date", 3, [pinned.desc(), F.col("starts_at"), F.col("id")]).select("id", "local_date", "nth", "more")


@query(f"{EV} SELECT local_date, string_agg(id, ',' ORDER BY starts_at_utc, id) AS ids FROM ev WHERE active GROUP BY local_date")
def day_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(F.array_sort(F.collect_list(F.struct("starts_at_utc", "id"))), lambda x: x["id"])
    return served(spark, sf_dir).where("active").groupBy("local_date").agg(F.array_join(ids, ",").alias("ids"))


@query(f"{EV}, m AS (SELECT DISTINCT substr(local_date, 1, 7) AS month FROM ev WHERE active) SELECT month, lead(month) OVER (ORDER BY month) AS next_month FROM m")
def next_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month after each that has events; one row a month meets in one task, whatever the number of events."""
    months = served(spark, sf_dir).where("active").select(F.substring("local_date", 1, 7).alias("month")).distinct()
    return months.withColumn("next_month", F.lead("month").over(Window.orderBy("month")))


@query("""WITH d AS (SELECT DISTINCT user_id % 40 AS series, CAST(ts AS DATE) - CASE WHEN user_id % 40 >= 38 AND extract(day FROM ts) = 9 THEN 1 ELSE 0 END AS d FROM events),
i AS (SELECT series, d - CAST(row_number() OVER (PARTITION BY series ORDER BY d) AS INTEGER) AS g FROM d), r AS (SELECT series, count(*) AS run FROM i GROUP BY series, g)
SELECT series, max(run) AS longest FROM r GROUP BY series HAVING max(run) >= 25""")
def runaway_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with events on 25 days in a row; two of the forty pause on the ninth and hold its events the day before."""
    moved = F.date_sub(F.to_date("ts"), F.when((F.col("user_id") % 40 >= 38) & (F.dayofmonth("ts") == 9), 1).otherwise(0))
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("series"), moved.alias("day"))
    return views.runaway_series(rows, ["series"], "day", 25)


@query("SELECT event_id, count(*) OVER w AS recent, count(*) OVER w < 3 AS allowed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 36000000000 PRECEDING AND 1 PRECEDING)")
def rate_limit_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return views.rate_limited(attempts, "user_id", "ts", 3, 36000).select("event_id", "recent", "allowed")


@query("""WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL '12' HOUR, TRUE) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at, count(*) AS touches FROM s GROUP BY user_id, s""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    touches = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return views.sessions(touches, "user_id", "ts", "12 hours").withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").select("event_id", props.alias("k")).where("k >= 50")


@query(f"{EV}, {PLACES} SELECT id, name AS municipality_name, 'https://example.org' || substr(url, 20) AS url FROM ev LEFT JOIN places ON slug = municipality_slug WHERE id = 'e' || CAST((SELECT max(n) // 2 FROM ev) AS VARCHAR)")
def event_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event by its id."""
    events = with_places(spark, sf_dir)
    middle = served(spark, sf_dir).agg(F.concat(F.lit("e"), F.floor(F.max("n") / 2).cast("string")).alias("id"))
    return events.join(F.broadcast(middle), "id", "left_semi").select("id", "municipality_name", "url")


ESCAPED = lambda x: f"replace(replace(replace(replace({x}, '\\', '\\\\'), ';', '\\;'), ',', '\\,'), chr(10), '\\n')"
ICS = lambda x: f"replace(replace(substr({x}, 1, 19), '-', ''), ':', '') || 'Z'"


@query(f"""{EV}, {PLACES}, v AS (SELECT ev.*, name, {LAST} AS last_date, concat_ws(chr(10), CASE WHEN cost = 'free' THEN 'Free.' WHEN cost_text IS NOT NULL THEN 'Cost: ' || cost_text END, description, 'Organizer: ' || organizer,
  CASE WHEN status = 'rescheduled' THEN 'This event has been rescheduled.' END, CASE WHEN {UNTIMED} THEN 'Start time not published by the source — check the listing.' END, 'Source: ' || url) AS notes,
  concat_ws(', ', venue_name, CASE WHEN venue_name IS NULL OR NOT contains(lower(venue_name), lower(address)) THEN address END,
    CASE WHEN NOT coalesce(contains(lower(venue_name), lower(name)), FALSE) AND NOT contains(lower(address), lower(name)) THEN name END) AS place FROM ev LEFT JOIN places ON slug = municipality_slug WHERE active)
SELECT id, concat_ws(chr(10), 'BEGIN:VEVENT', 'UID:' || id || '@example.org', 'DTSTAMP:20000101T000000Z', CASE WHEN {UNTIMED} THEN 'DTSTART;VALUE=DATE:' || replace(local_date, '-', '') ELSE 'DTSTART:' || {ICS('starts_at_utc')} END,
  CASE WHEN {UNTIMED} THEN 'DTEND;VALUE=DATE:' || strftime(CAST(last_date AS DATE) + 1, '%Y%m%d') ELSE 'DTEND:' || coalesce({ICS('ends_at_utc')}, strftime(CAST(replace(starts_at_utc, 'Z', '') AS TIMESTAMP) + INTERVAL 2 HOUR, '%Y%m%dT%H%M%SZ')) END,
  'SUMMARY:' || {ESCAPED("CASE WHEN status = 'cancelled' THEN 'CANCELLED: ' ELSE '' END || title")}, 'STATUS:' || CASE WHEN status = 'cancelled' THEN 'CANCELLED' ELSE 'CONFIRMED' END, 'TRANSP:TRANSPARENT',
  'LOCATION:' || {ESCAPED('place')}, 'DESCRIPTION:' || {ESCAPED('notes')}, 'URL:https://example.org/event/' || id, 'END:VEVENT') AS vevent FROM v""")
def calendar_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.event_lines(with_places(spark, sf_dir).where("active"), "example.org", "https://example.org", "20000101T000000Z", folded=False)


@query()
def calendar_feed_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed text with lines folded at 75 octets; tests hold the folding against its definition."""
    return feeds.event_lines(with_places(spark, sf_dir).where("active"), "example.org", "https://example.org", "20000101T000000Z")


@query(f"""{EV} SELECT id, '{{"@context":"https://schema.org","@type":"Event","name":' || to_json(title) || ',"startDate":' || to_json(CASE WHEN {UNTIMED} THEN local_date ELSE starts_at_utc END) || coalesce(',"endDate":' || to_json(ends_at_utc), '')
  || ',"eventStatus":"https://schema.org/Event' || CASE status WHEN 'cancelled' THEN 'Cancelled' WHEN 'rescheduled' THEN 'Rescheduled' ELSE 'Scheduled' END || '","location":{{"@type":"Place","name":' || to_json(coalesce(venue_name, municipality_slug, 'Unspecified')) || ',"address":' || to_json(address) || '}}'
  || CASE cost WHEN 'free' THEN ',"isAccessibleForFree":true' WHEN 'paid' THEN ',"isAccessibleForFree":false' ELSE '' END || ',"url":"https://example.org/event/' || id || '"}}' AS json_ld FROM ev WHERE active""")
def structured_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.structured_data(served(spark, sf_dir).where("active"), "https://example.org")


OVERRIDE = """over AS (SELECT id, CASE WHEN n % 50 = 1 THEN '{"title":"Renamed","organizer":null,"secret":"x"}' WHEN n % 50 = 2 THEN '{"localDate":"2000-01-01","localTime":"10:00"}'
  WHEN n % 50 = 3 THEN '{"active":false,"cost":"free"}' WHEN n % 50 = 4 THEN 'not json' WHEN n % 50 = 5 THEN '{"startsAtUtc":"2001-01-01T00:00:00.000Z","endsAtUtc":null,"localDate":"2000-12-31","localTime":"19:00","allDay":false,"timePrecision":"exact"}' END AS fields FROM ev WHERE n % 50 BETWEEN 1 AND 5)"""


@query(f"""{EV}, {OVERRIDE} SELECT ev.id, CASE WHEN n % 50 = 1 THEN 'Renamed' ELSE title END AS title, CASE WHEN n % 50 = 1 THEN NULL ELSE organizer END AS organizer, CASE WHEN n % 50 = 5 THEN '2000-12-31' ELSE local_date END AS local_date,
  CASE WHEN n % 50 = 5 THEN '19:00' ELSE local_time END AS local_time, CASE WHEN n % 50 = 5 THEN '2001-01-01T00:00:00.000Z' ELSE starts_at_utc END AS starts_at_utc, CASE WHEN n % 50 = 5 THEN NULL ELSE ends_at_utc END AS ends_at_utc,
  CASE WHEN n % 50 = 3 THEN FALSE ELSE active END AS active, CASE WHEN n % 50 = 3 THEN 'free' ELSE cost END AS cost,
  CASE n % 50 WHEN 1 THEN 'organizer,title' WHEN 2 THEN 'time' WHEN 3 THEN 'active,cost' WHEN 4 THEN '' WHEN 5 THEN 'time' END AS edited FROM ev LEFT JOIN over USING (id)""")
def overridden_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = served(spark, sf_dir)
    sets = spark.sql(f"WITH {OVERRIDE} SELECT * FROM over".replace("FROM ev", "FROM {ev}").replace("{\"", "{{\"").replace("\"}'", "\"}}'").replace("false}'", "false}}'").replace("\"free\"}", "\"free\"}"), ev=events)
    changed = ov.apply(events, sets).join(sets.select("id", F.array_join(ov.edited(F.col("fields")), ",").alias("edited")), "id", "left")
    return changed.select("id", "title", "organizer", "local_date", "local_time", times.iso(F.col("starts_at")).alias("starts_at_utc"), times.iso(F.col("ends_at")).alias("ends_at_utc"), "active", "cost", "edited")


LIST = f"""ls AS (SELECT id, source_a AS source_slug, active, category, local_date, description, cost, 'h' || CAST(n % 7 AS VARCHAR) AS content_hash, CASE WHEN n % 3 = 0 THEN 'h' || CAST(n % 5 AS VARCHAR) END AS detail_hash, CAST(n % 5 AS INTEGER) AS detail_attempts FROM ev)"""


def _listing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    return served(spark, sf_dir).select("id", F.col("source_a").alias("source_slug"), "active", "category", "local_date", "description", "cost", "cost_text", "image_url", F.concat(F.lit("h"), (n % 7).cast("string")).alias("content_hash"), F.when(n % 3 == 0, F.concat(F.lit("h"), (n % 5).cast("string"))).alias("detail_hash"), (n % 5).cast("int").alias("detail_attempts"))


@query(f"{EV}, {LIST} SELECT id FROM ls WHERE active AND local_date >= '{TODAY}' AND {HIDDEN} AND source_slug IN ('src0', 'src3') AND detail_hash IS DISTINCT FROM content_hash AND detail_attempts < 3 ORDER BY local_date, id LIMIT 300")
def enrichment_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.enrichment(_listing_rows(spark, sf_dir), ["src0", "src3"], TODAY).select("id")


@query(f"""{EV}, {LIST}, d AS (SELECT id, TRUE AS seen, n % 4 <> 1 AS ok, 'A page that says far more about it than the list does.' AS page, '$' || CAST(n % 9 AS VARCHAR) AS price FROM ev)
SELECT ls.id, CASE WHEN coalesce(ok, FALSE) AND length(page) > length(coalesce(ls.description, '')) THEN page ELSE ls.description END AS description, CASE WHEN ok THEN coalesce(ev.cost_text, price) ELSE ev.cost_text END AS cost_text,
  CASE WHEN ok THEN content_hash ELSE detail_hash END AS detail_hash, CASE WHEN ok THEN 0 WHEN seen THEN detail_attempts + 1 ELSE detail_attempts END AS detail_attempts FROM ls JOIN ev USING (id) LEFT JOIN d USING (id)""")
def enriched_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = served(spark, sf_dir)
    pages = events.select("id", (F.col("n") % 4 != 1).alias("ok"), F.lit("A page that says far more about it than the list does.").alias("description"), F.concat(F.lit("$"), (F.col("n") % 9).cast("string")).alias("cost_text"), F.lit(None).cast("string").alias("image_url"))
    return queues.enriched(_listing_rows(spark, sf_dir), pages).select("id", "description", "cost_text", "detail_hash", "detail_attempts")


@query(f"{EV}, {LIST} SELECT id FROM ls JOIN ev USING (id) WHERE ls.active AND ls.cost = 'unknown' AND length(ls.description || ' Seats from $' || CAST(n AS VARCHAR) || ' while they last, says the page of the hall.') >= 60 AND n % 4 = 0 AND (source_slug <> 'src0' OR detail_hash IS NOT NULL) AND n % 6 <> 0 ORDER BY ls.local_date, id LIMIT 200")
def cost_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_extract("id", "([0-9]+)", 1)
    told = F.when(n.cast("long") % 4 == 0, F.concat("description", F.lit(" Seats from $"), n, F.lit(" while they last, says the page of the hall."))).otherwise("Nothing about prices here, however long one reads this text on.")
    rows = _listing_rows(spark, sf_dir).withColumn("description", told)
    decided = rows.where(n.cast("long") % 6 == 0).select("id", "content_hash").union(rows.where(n.cast("long") % 10 == 0).select("id", F.lit("old")))
    return queues.costs(rows, decided, ["src0"]).select("id")


@query(f"{EV} SELECT image_url AS url, count(*) AS uses FROM ev WHERE active AND image_url IS NOT NULL AND NOT contains(image_url, '//calendar.') AND CAST(regexp_extract(image_url, '/([0-9]+)', 1) AS INTEGER) % 7 <> 0 GROUP BY image_url ORDER BY uses DESC, url LIMIT 60")
def image_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = served(spark, sf_dir)
    measured = events.select(F.col("image_url").alias("url")).where(F.regexp_extract("url", "/([0-9]+)", 1).try_cast("int") % 7 == 0).distinct()
    return queues.images(events, measured, text.shareable_host(F.col("image_url")))


CALENDARS = "cal AS (SELECT c_custkey AS user_id, CASE c_custkey % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' ELSE 'none' END AS digest, CAST(c_custkey % 24 AS INTEGER) AS digest_hour, CAST(c_custkey % 7 AS INTEGER) AS digest_day, c_custkey % 10 <> 4 AS verified FROM customer)"


@query(f"WITH {CALENDARS} SELECT user_id, CASE digest WHEN 'daily' THEN 'd:' ELSE 'w:' END || '{TODAY}' AS period_key FROM cal WHERE verified AND digest_hour <= 12 AND (digest = 'daily' OR (digest = 'weekly' AND digest_day = 3)) AND user_id % 11 <> 5 ORDER BY digest_hour, user_id LIMIT 100")
def digest_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readers to write to in this run: a budget of a hundred is the feature."""
    cal = spark.sql(f"WITH {CALENDARS} SELECT * FROM cal".replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))
    users = cal.select("user_id", "verified", F.concat(F.lit("reader"), F.col("user_id").cast("string"), F.lit("@example.org")).alias("email"))
    sent = cal.where("user_id % 11 = 5").select("user_id", F.concat(F.when(F.col("digest") == "daily", "d:").otherwise("w:"), F.lit(TODAY)).alias("period_key"))
    return queues.due_digests(cal.drop("verified"), users, sent, TODAY, 12, 3).select("user_id", "period_key")


CANDIDATES = f"""cand AS (SELECT user_id % 20 AS user_id, section, id AS event_id, starts_at_utc FROM ev, (VALUES (0), (1), (2)) s(section)
  WHERE active AND ((section = 0 AND user_id % 31 = 7) OR (section = 1 AND category IN ('music', 'arts')) OR (section = 2 AND category IN ('arts', 'sports', 'other'))))"""


@query(f"""{EV}, {CANDIDATES}, s0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY starts_at_utc, event_id) AS nth, FALSE AS more FROM cand WHERE section = 0),
s1 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY starts_at_utc, event_id) AS nth, count(*) OVER (PARTITION BY user_id) > 10 AS more FROM cand c WHERE section = 1 AND NOT EXISTS (FROM s0 WHERE s0.user_id = c.user_id AND s0.event_id = c.event_id)),
d1 AS (SELECT * FROM s1 WHERE nth <= 10),
s2 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY starts_at_utc, event_id) AS nth, count(*) OVER (PARTITION BY user_id) > 10 AS more FROM cand c WHERE section = 2 AND NOT EXISTS (FROM s0 WHERE s0.user_id = c.user_id AND s0.event_id = c.event_id) AND NOT EXISTS (FROM d1 WHERE d1.user_id = c.user_id AND d1.event_id = c.event_id))
SELECT user_id, section, event_id, nth::INTEGER AS nth, more FROM s0 UNION ALL SELECT user_id, section, event_id, nth::INTEGER, more FROM d1 UNION ALL SELECT user_id, section, event_id, nth::INTEGER, more FROM s2 WHERE nth <= 10""")
def digest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = served(spark, sf_dir).where("active")
    sections = F.filter(F.array(F.when(F.col("user_id") % 31 == 7, 0), F.when(F.col("category").isin("music", "arts"), 1), F.when(F.col("category").isin("arts", "sports", "other"), 2)), lambda s: s.isNotNull())
    rows = events.select((F.col("user_id") % 20).alias("user_id"), F.explode(sections).alias("section"), F.col("id").alias("event_id"), F.col("starts_at_utc").alias("starts_at"))
    return queues.digest_sections(rows).select("user_id", "section", "event_id", "nth", "more")


@query(f"{EV} SELECT user_id, id AS event_id, CASE WHEN NOT active THEN 'withdrawn' WHEN {LAST} >= '{TODAY}' THEN 'upcoming' ELSE 'past' END AS part, CASE WHEN active THEN title ELSE 'Saved: ' || title END AS title FROM ev")
def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinned events as they are now, or as they were saved if they were withdrawn."""
    events = served(spark, sf_dir)
    saved = events.select("user_id", F.col("id").alias("event_id"), F.concat(F.lit("Saved: "), F.col("title")).alias("saved_title"), F.col("local_date").alias("saved_date"))
    live = events.where("active").select(F.col("id").alias("event_id"), F.col("title").alias("live_title"), times.last_date(F.col("local_date"), F.col("ends_at"), F.col("timezone")).alias("last"))
    part = F.when(F.col("live_title").isNull(), "withdrawn").when(F.col("last") >= TODAY, "upcoming").otherwise("past")
    return saved.join(live, "event_id", "left").select("user_id", "event_id", part.alias("part"), F.coalesce("live_title", "saved_title").alias("title"))


@query(f"{EV}, s AS (SELECT n, id, CASE n % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'approved' WHEN 2 THEN 'skipped' ELSE 'failed' END AS state, CASE n % 5 WHEN 0 THEN 'approve' WHEN 1 THEN 'unapprove' WHEN 2 THEN 'unskip' WHEN 3 THEN 'retry' END AS move, CASE WHEN n % 7 = 0 THEN 'draft' END AS stale FROM ev),"
       " t AS (SELECT *, CASE WHEN coalesce(stale, state) <> state THEN NULL WHEN move = 'approve' AND state = 'draft' THEN 'approved' WHEN move = 'unapprove' AND state = 'approved' THEN 'draft' WHEN move = 'unskip' AND state = 'skipped' THEN 'draft' WHEN move = 'retry' AND state = 'failed' THEN 'approved' END AS next FROM s)"
       " SELECT id, coalesce(next, state) AS state, next IS NOT NULL AS moved FROM t")
def social_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts moved only from the state that was shown."""
    n = F.col("n")
    rows = served(spark, sf_dir).select("n", "id", F.element_at(F.array(*[F.lit(s) for s in ("draft", "approved", "skipped", "failed")]), (n % 4 + 1).cast("int")).alias("state"))
    asked = rows.where("n % 5 < 4").select("id", F.element_at(F.array(*[F.lit(s) for s in ("approve", "unapprove", "unskip", "retry")]), (n % 5 + 1).cast("int")).alias("move"), F.when(n % 7 == 0, "draft").otherwise(F.col("state")).alias("seen"))
    moves = {"approve": (["draft"], "approved"), "unapprove": (["approved"], "draft"), "unskip": (["skipped"], "draft"), "retry": (["failed"], "approved")}
    return move_states(rows, asked, "id", moves).select("id", "state", "moved")


@query(f"WITH {CALENDARS} SELECT user_id, 'd:{TODAY}' AS period_key FROM cal WHERE digest <> 'none' AND user_id % 3 = 0 AND user_id % 4 <> 0")
def digest_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that are won: one for each reader who still wants a digest and has no row for the period."""
    customers = table(spark, sf_dir, "customer")
    asked = customers.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"), F.lit(f"d:{TODAY}").alias("period_key"))
    on = customers.where("c_custkey % 3 <> 2").select(F.col("c_custkey").alias("user_id"))
    held = customers.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("user_id"), F.lit(f"d:{TODAY}").alias("period_key"))
    return insert_absent(held, asked.union(asked).join(on, "user_id", "left_semi"), ["user_id", "period_key"])


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 AND NOT (c_custkey % 3 = 0) THEN 'new' ELSE 'old' END AS value, CASE WHEN c_custkey % 3 = 0 THEN 'kept' ELSE 'first' END AS first_seen FROM customer UNION ALL SELECT -c_custkey - 1, 'new', 'now' FROM customer WHERE c_custkey % 10 = 0")
def guarded_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert or update by key: first sight is kept, and a guard leaves some known rows alone."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    old = customers.select("id", F.lit("old").alias("value"), F.when(F.col("id") % 3 == 0, "kept").otherwise("first").alias("first_seen"))
    new = customers.where("id % 2 = 0").select("id", F.lit("new").alias("value"), F.lit("now").alias("first_seen")).union(customers.where("id % 10 = 0").select(-F.col("id") - 1, F.lit("new"), F.lit("now")))
    return upsert(old, new, ["id"], keep=["first_seen"], guard=F.col("old.first_seen") != "kept")


@query(f"{EV}, q AS (SELECT id, local_date, starts_at_utc, CASE WHEN n % 6 = 0 THEN 'done' END AS handled FROM ev) SELECT id, lead(id) OVER (ORDER BY local_date, starts_at_utc DESC, id) AS next_id FROM q WHERE handled IS NULL")
def staged_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = served(spark, sf_dir).select("id", "local_date", "starts_at_utc", F.when(F.col("n") % 6 == 0, "done").alias("handled"))
    return queues.next_in_queue(rows, "handled", "local_date", [F.desc("starts_at_utc"), F.col("id")]).select("id", "next_id")


PNG = "unhex('89504E470D0A1A0A0000000D49484452' || lpad(to_hex(CAST(p_partkey % 3000 AS BIGINT)), 8, '0') || lpad(to_hex(CAST(p_size * 40 AS BIGINT)), 8, '0'))"


@query("SELECT p_partkey, CASE WHEN p_partkey % 3000 > 0 AND p_size > 0 THEN p_partkey % 3000 END AS width, CASE WHEN p_partkey % 3000 > 0 AND p_size > 0 THEN p_size * 40 END AS height, CASE p_partkey % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'gif' ELSE 'jpeg' END AS kind, CASE WHEN p_partkey % 3000 >= 600 AND p_size * 40 >= 315 THEN 'https://img.example.org/' || p_partkey END AS card FROM part")
def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes read back from headers that were written with a known width and height."""
    w, h = (F.col("p_partkey") % 3000).cast("long"), (F.col("p_size") * 40).cast("long")
    fixed = lambda x, n: F.lpad(F.hex(x), n, "0")
    little = lambda x: F.concat(F.substring(fixed(x, 4), 3, 2), F.substring(fixed(x, 4), 1, 2))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), fixed(w, 8), fixed(h, 8))
    gif = F.concat(F.lit("474946383961"), little(w), little(h), F.lit("0000"))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC0001108"), fixed(h, 4), fixed(w, 4), F.lit("03012200021101031101"))
    third = F.col("p_partkey") % 3
    data = F.unhex(F.when(third == 0, png).when(third == 1, gif).otherwise(jpeg))
    rows = table(spark, sf_dir, "part").select("p_partkey", data.alias("data")).withColumn("size", images.image_size(F.col("data")))
    card = images.share_card(F.concat(F.lit("https://img.example.org/"), F.col("p_partkey").cast("string")), F.col("size.width"), F.col("size.height"))
    return rows.select("p_partkey", "size.width", "size.height", images.kind_of(F.col("data")).alias("kind"), card.alias("card"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '^https?://(www\\.)?', ''), '[?#].*$', ''), '/$', '') AS page, coalesce(NOT regexp_matches(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^(calendar|events)\\.', 'i'), TRUE) AS shareable FROM pages")
def page_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url")).alias("page"), text.shareable_host(F.col("url")).alias("shareable"))


#: Letters that have no marks to lose; the checking SQL's own function would change them, so they are kept from it.
_LETTERS = "øłđßæœ"
_KEPT = "".join(chr(0xE000 + i) for i in range(len(_LETTERS)))
_FOLD = lambda x: f"translate(lower(strip_accents(translate({x}, {O.q(_LETTERS + 'ØŁĐẞÆŒ')}, {O.q(_KEPT * 2)}))), {O.q(_KEPT)}, {O.q(_LETTERS)})"
_STRAIGHT = lambda x: f"translate({x}, '‘’“”', {O.q(chr(39) * 2 + chr(34) * 2)})"


@query(f"SELECT doc_id, {_STRAIGHT(_FOLD('text'))} AS folded, substr(regexp_replace(regexp_replace({_FOLD('text')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug FROM documents")
def folded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text folded for search, and as a slug; null texts stay null."""
    return table(spark, sf_dir, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"), text.slugify(F.col("text")).alias("slug"))


_TAGS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</(p|div|li|h[1-6]|tr|section|article)>', chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g')"


_READ = _TAGS
for _name, _to in text.ENTITIES.items():
    if _name != "amp":
        _READ = f"replace({_READ}, '&{_name};', {O.q(_to)})"


@query(f"SELECT page_id, trim(regexp_replace(replace({_READ}, '&amp;', '&'), '[\\s\\x{{00a0}}]+', ' ', 'g')) AS text FROM pages")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.patterns import squeeze

    return table(spark, sf_dir, "pages").select("page_id", squeeze(text.tag_text(F.col("html"))).alias("text"))


@query()
def page_text_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text with numeric entities read and lines kept; tests hold it against cases."""
    return table(spark, sf_dir, "pages").select("page_id", text.truncate(text.strip_tags(F.col("html"))).alias("text"))


@query("SELECT o_orderkey, strftime(w AT TIME ZONE 'America/Toronto' AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') AS utc, strftime(w AT TIME ZONE 'UTC' AT TIME ZONE 'America/Toronto', '%Y-%m-%dT%H:%M') AS wall FROM (SELECT o_orderkey, o_orderdate + INTERVAL 8 HOUR + to_minutes(CAST(o_orderkey % 600 AS BIGINT)) AS w FROM orders)")
def wall_to_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    moment = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (F.lit(480) + F.col("o_orderkey") % 600) * 60_000_000)
    zone = F.lit("America/Toronto")
    return table(spark, sf_dir, "orders").select("o_orderkey", times.iso(times.wall_to_utc(F.date_format(moment, "yyyy-MM-dd'T'HH:mm"), zone)).alias("utc"), times.wall_clock(moment, zone).alias("wall"))


@query(f"""SELECT o_orderkey, CASE WHEN h > 12 THEN NULL ELSE lpad(CAST(h % 12 + CASE WHEN pm THEN 12 ELSE 0 END AS VARCHAR), 2, '0') || ':' || m END AS clock,
  CASE dayofweek(d) WHEN 0 THEN d ELSE d + CAST(7 - dayofweek(d) AS INTEGER) END::VARCHAR AS weekend_end, CASE WHEN d = DATE '2000-03-15' THEN 'Today' WHEN d = DATE '2000-03-16' THEN 'Tomorrow' WHEN d = DATE '2000-03-14' THEN 'Yesterday' WHEN d > DATE '2000-03-16' AND d < DATE '2000-03-22' THEN strftime(d, '%A') ELSE strftime(d, '%a, %b %-d') END AS relative
FROM (SELECT o_orderkey, 1 + o_orderkey % 14 AS h, o_orderkey % 2 = 0 AS pm, lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS m, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def clock_and_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    said = F.concat((1 + k % 14).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"), F.when(k % 2 == 0, " p.m.").otherwise("AM"))
    clock = F.when(1 + k % 14 <= 12, times.parse_clock(said))
    return table(spark, sf_dir, "orders").select("o_orderkey", clock.alias("clock"), times.preset(day, "weekend")[1].cast("string").alias("weekend_end"), times.relative_day(day, F.lit(TODAY).cast("date")).alias("relative"))


def _rows(columns: str, rows: list[tuple]) -> str:
    """Numbered rows of a fixed table in SQL."""
    quoted = lambda v: "NULL" if v is None else O.q(v) if isinstance(v, str) else str(v)
    return f"d(n, {columns}) AS (VALUES " + ", ".join(f"({n}, {', '.join(map(quoted, r))})" for n, r in enumerate(rows)) + ")"


NAMED = [(s, n) for s, names in GAZETTEER.items() for n in names]


@query(f"WITH {_rows('venue_id, name, municipality_slug', VENUES)} SELECT venue_id, name, municipality_slug, count(c_custkey) AS readers FROM d LEFT JOIN customer ON c_custkey % {len(VENUES)} = n GROUP BY venue_id, name, municipality_slug")
def venue_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues with the readers (customers) that follow each."""
    follows = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % len(VENUES)).alias("n")).agg(F.count("*").alias("readers"))
    numbered = spark.createDataFrame([(v[0], n) for n, v in enumerate(VENUES)], "venue_id string, n long")
    return venues(spark).join(numbered, "venue_id").join(follows, "n", "left").select("venue_id", "name", "municipality_slug", F.coalesce("readers", F.lit(0)).alias("readers"))


@query(f"WITH {_rows('slug, name', NAMED)} SELECT slug, name, count(c_custkey) AS readers FROM d LEFT JOIN customer ON c_custkey % {len(NAMED)} = n GROUP BY slug, name")
def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of places with the readers (customers) who wrote each: every name is found again as its own place."""
    names = F.array(*[F.lit(n) for _, n in NAMED])
    wrote = table(spark, sf_dir, "customer").select(F.element_at(names, (F.col("c_custkey") % len(NAMED) + 1).cast("int")).alias("name")).groupBy("name").agg(F.count("*").alias("readers"))
    return spark.createDataFrame(NAMED, "slug string, name string").join(wrote, "name", "left").select("slug", "name", F.coalesce("readers", F.lit(0)).alias("readers"))


@query("WITH k(kind, enabled, total, n) AS (VALUES ('county', 1, 1, 0), ('library', 7, 7, 1), ('manual', 0, 1, 2), ('media', 6, 7, 3), ('municipal', 18, 18, 4), ('organization', 5, 5, 5), ('ticketing', 2, 2, 6), ('tourism', 1, 1, 7)) SELECT kind, enabled, total, count(o_orderkey) AS listings FROM k LEFT JOIN orders ON o_custkey % 8 = n GROUP BY kind, enabled, total")
def source_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of sources, how many are on, and the listings (orders) of each kind."""
    kinds = sources(spark).groupBy("kind").agg(F.count_if("enabled").cast("int").alias("enabled"), F.count("*").cast("int").alias("total"))
    held = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 8).alias("n")).agg(F.count("*").alias("listings"))
    numbered = kinds.withColumn("n", F.row_number().over(Window.orderBy("kind")) - 1)  # eight rows
    return numbered.join(held, "n", "left").select("kind", "enabled", "total", F.coalesce("listings", F.lit(0)).alias("listings"))
