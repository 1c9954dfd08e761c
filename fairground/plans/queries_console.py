"""What editors and readers' calendars do, over rows made from orders, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import feeds, hashes, text, times, titles
from ..operators import console, forms, queues, views
from ..operators import filters as fl
from ..operators import overrides as ov
from ..operators.reconcile import move_states
from ..registry import municipalities
from . import oracle as O
from .catalog import ORACLE, query
from .queries_listings import HASH
from .queries_serving import EV, LAST, PLACES, TODAY, with_places
from .standins import served, table

CODE = lambda x: f"lpad(substr(regexp_replace({HASH(x)}, '^0+', ''), 1, 7), 7, '0')"
#: Every fifth order is by hand; half of these stand alone, and every listing is in an event of its own or its neighbour's.
LISTED = f"""le AS (SELECT 'c' || CAST(n AS VARCHAR) AS cluster, * FROM ev), li AS (SELECT id, CASE WHEN n % 5 = 0 THEN 'manual' ELSE source_a END AS source_slug, CASE WHEN n % 20 = 1 THEN NULL ELSE cluster END AS cluster_id, local_date, starts_at_utc, active, title, n FROM le),
se AS (SELECT cluster AS id, {CODE('cluster')} AS short_code, n % 3 = 0 AS merged FROM le)"""


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return served(spark, sf_dir).withColumn("short_code", hashes.short_code(F.col("id")))


def listed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Listings, some by hand, and the events that they are in."""
    rows = served(spark, sf_dir)
    n, cluster = F.col("n"), F.concat(F.lit("c"), F.col("n").cast("string"))
    listings = rows.select("id", F.when(n % 5 == 0, "manual").otherwise(F.col("source_a")).alias("source_slug"), F.when(n % 20 != 1, cluster).alias("cluster_id"), "local_date", "starts_at", "active", "title", "n")
    ids = F.when(n % 3 == 0, F.array("id", F.concat("id", F.lit("x")))).otherwise(F.array("id"))
    return listings, rows.select(cluster.alias("id"), hashes.short_code(cluster).alias("short_code"), ids.alias("listing_ids"), F.size(ids).alias("listing_count"), "active", "n")


def judged(spark: SparkSession, sf_dir: str, every: int, verdict: str) -> DataFrame:
    """A reading of every listing; but each `every`-th is of a text that the others no longer have."""
    n = F.col("n")
    read = F.concat(F.when(n % every == 0, "h").otherwise("g"), (n % 7).cast("string"))
    return served(spark, sf_dir).select(F.col("id").alias("listing_id"), read.alias("content_hash"), F.lit(verdict).alias("verdict"), F.concat(F.lit("$"), (n % 9).cast("string")).alias("quote"))


@query(f"""{EV} SELECT id AS listing_id, 'h' || CAST(n % 7 AS VARCHAR) AS content_hash, CASE WHEN n % 6 = 0 THEN 'paid' ELSE 'unknown' END AS verdict, '$' || CAST(n % 9 AS VARCHAR) AS quote,
  CASE WHEN n % 6 = 0 THEN 'judge' ELSE 'rule' END AS method, CASE WHEN n % 6 = 0 THEN '2026-02-01' ELSE '2026-01-01' END AS decided FROM ev
  UNION ALL SELECT id, 'g' || CAST(n % 7 AS VARCHAR), 'paid', '$' || CAST(n % 9 AS VARCHAR), 'judge', '2026-02-01' FROM ev WHERE n % 6 <> 0""")
def cost_decision_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of prices by listing and text: a later one takes the place of an earlier, or stands beside one of another text."""
    old = judged(spark, sf_dir, 1, "unknown").withColumns({"method": F.lit("rule"), "decided_at": F.lit("2026-01-01").cast("timestamp")})
    after = console.record_cost_decisions(old, judged(spark, sf_dir, 6, "paid"), "judge", "2026-02-01")
    return after.select("listing_id", "content_hash", "verdict", "quote", "method", F.date_format("decided_at", "yyyy-MM-dd").alias("decided"))


@query(f"{EV} SELECT id, CASE WHEN cost = 'unknown' AND n % 2 = 0 THEN 'paid' ELSE cost END AS cost, CASE WHEN cost = 'unknown' AND n % 2 = 0 THEN '$' || CAST(n % 9 AS VARCHAR) ELSE cost_text END AS cost_text FROM ev")
def judged_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judged price is applied only where nothing was stated."""
    rows = served(spark, sf_dir).select("id", "cost", "cost_text", "n")
    updates = rows.where("n % 2 = 0").select("id", F.lit("paid").alias("cost"), F.concat(F.lit("$"), (F.col("n") % 9).cast("string")).alias("cost_text"))
    return console.set_listing_cost(rows, updates).select("id", "cost", "cost_text")


_ASKED = [("farmers MARKET", "tay", False), ("", "unspecified", True), ("maple", "nowhere", True), ("https://x.ca/e/{code}", "", False), ("(  )", "", False)]
_FIND = lambda where, order: f"SELECT * FROM (SELECT row_number() OVER (ORDER BY {order}, id)::INTEGER AS nth, id, count(*) OVER () > 60 AS truncated FROM e WHERE {where}) WHERE nth <= 60"
_NOW = f"local_date >= '{TODAY}'"


@query(f"{EV}, e AS (SELECT *, {CODE('id')} AS code FROM ev)" + " UNION ALL ".join([
    f" SELECT 0 AS asked, * FROM ({_FIND(f'{_NOW} AND contains(lower(title), {O.q('farmers market')}) AND municipality_slug = {O.q('tay')}', 'starts_at_utc')})",
    f" SELECT 1 AS asked, * FROM ({_FIND(f'NOT {_NOW} AND municipality_slug IS NULL', 'starts_at_utc DESC')})",
    f" SELECT 2 AS asked, * FROM ({_FIND(f'NOT {_NOW} AND contains(lower(title), {O.q('maple')})', 'starts_at_utc DESC')})",
    f" SELECT 3 AS asked, * FROM ({_FIND(f'code = (SELECT {CODE(O.q('e1'))})', 'starts_at_utc')})",
    f" SELECT 4 AS asked, * FROM ({_FIND(f'{_NOW} AND contains(title, {O.q('(  )')})', 'starts_at_utc')})",
]))
def event_finder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches of an editor: by title and place, backwards in time, by a link's short code; a limit of 60 is the feature."""
    events = coded(spark, sf_dir)
    code = spark.range(1).select(hashes.short_code(F.lit("e1")).alias("c")).first()["c"]
    found = [console.find(events, q.format(code=code), m, past, TODAY).select(F.lit(i).alias("asked"), "nth", "id", "truncated") for i, (q, m, past) in enumerate(_ASKED)]
    return found[0].union(found[1]).union(found[2]).union(found[3]).union(found[4])


SENT = "se0 AS (SELECT n, 's' || CAST(n AS VARCHAR) AS id, local_date AS created_at, CASE WHEN n % 4 = 0 THEN id END AS handled_listing_id, CASE WHEN n % 4 <> 1 THEN local_date END AS handled_at FROM ev)"


def _sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    return served(spark, sf_dir).select("n", F.concat(F.lit("s"), n.cast("string")).alias("id"), F.col("local_date").alias("created_at"), F.when(n % 4 == 0, F.col("id")).alias("handled_listing_id"), F.when(n % 4 != 1, F.col("local_date")).alias("handled_at"))


@query(f"{EV}, {LISTED}, {SENT} SELECT s.id, e.short_code AS event_code FROM se0 s LEFT JOIN li l ON l.id = s.handled_listing_id LEFT JOIN se e ON e.id = l.cluster_id")
def sent_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions and drafts, with the event that each became."""
    return console.with_outcome(_sent(spark, sf_dir), *listed(spark, sf_dir)).select("id", "event_code")


@query(f"""{EV}, {LISTED}, {SENT}, top AS (SELECT * FROM se0 ORDER BY created_at DESC, id LIMIT 300), p AS (SELECT t.id, CASE WHEN handled_at IS NULL THEN 'waiting' ELSE 'done' END AS part, e.short_code AS event_code, created_at FROM top t LEFT JOIN li l ON l.id = t.handled_listing_id LEFT JOIN se e ON e.id = l.cluster_id),
r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY created_at DESC, id)::INTEGER AS nth FROM p) SELECT id, part, event_code, nth FROM r WHERE part = 'waiting' OR nth <= 50""")
def suggestion_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 300 that were sent in: those that wait, and 50 of the others."""
    return console.inbox(_sent(spark, sf_dir), *listed(spark, sf_dir)).select("id", "part", "event_code", "nth")


@query(f"""{EV}, s AS (SELECT id, CASE n % 4 WHEN 0 THEN 'event' WHEN 1 THEN 'waiting' WHEN 2 THEN 'dismissed' ELSE 'accepted' END AS state, CASE n % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'dismiss' ELSE 'reopen' END AS move FROM ev),
t AS (SELECT *, CASE WHEN move = 'accept' AND state = 'waiting' THEN 'accepted' WHEN move = 'dismiss' AND state = 'waiting' THEN 'dismissed' WHEN move = 'reopen' AND state IN ('dismissed', 'accepted') THEN 'waiting' END AS next FROM s)
SELECT id, coalesce(next, state) AS state, next IS NOT NULL AS moved FROM t""")
def suggestion_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted, dismissed and reopened, each only from the states that allow it."""
    n = F.col("n")
    of = lambda k, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (n % k + 1).cast("int"))
    rows = served(spark, sf_dir).select("n", "id", of(4, "event", "waiting", "dismissed", "accepted").alias("state"))
    asked = rows.select("id", of(3, "accept", "dismiss", "reopen").alias("move"), F.col("state").alias("seen"))
    return move_states(rows, asked, "id", console.INBOX_MOVES).select("id", "state", "moved")


@query(f"{EV}, {LISTED} SELECT e.cluster AS event_id, e.id, title FROM le e WHERE TRUE")
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings that each event is made of."""
    listings, events = listed(spark, sf_dir)
    return console.cluster_listings(events, listings).select("event_id", "id", "title")


@query(f"""{EV}, {LISTED}, m AS (SELECT l.id, CASE WHEN local_date >= '{TODAY}' THEN 'upcoming' ELSE 'past' END AS part, e.short_code AS event_code, CASE WHEN e.id IS NOT NULL THEN CASE WHEN merged THEN 2 ELSE 1 END END AS event_listings, starts_at_utc FROM li l LEFT JOIN se e ON e.id = l.cluster_id WHERE source_slug = 'manual')
SELECT id, part, event_code, event_listings, row_number() OVER (PARTITION BY part ORDER BY epoch_us(CAST(replace(starts_at_utc, 'Z', '') AS TIMESTAMP)) * CASE part WHEN 'upcoming' THEN 1 ELSE -1 END, id)::INTEGER AS nth FROM m""")
def manual_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hand: those to come first, the others backwards."""
    return console.manual_listings(*listed(spark, sf_dir), TODAY).select("id", "part", "event_code", "event_listings", "nth")


_CHOSEN = "CASE WHEN n % 4 = 0 THEN NULL ELSE 'tay' END AS municipality_slug, CASE WHEN n % 3 = 0 THEN category ELSE 'arts' END AS category, CASE n % 2 WHEN 0 THEN 'free' ELSE 'unknown' END AS cost, CASE WHEN n % 10 = 5 THEN 'cancelled' ELSE 'scheduled' END AS status"


@query(f"""{EV}, c AS (SELECT id, 'base' || CAST(n % 100 AS VARCHAR) AS h, {_CHOSEN} FROM ev), j AS (SELECT *, h || '|{{"municipalitySlug":' || coalesce(to_json(municipality_slug), 'null') || ',"category":' || to_json(category) || ',"cost":' || to_json(cost) || ',"status":' || to_json(status) || '}}' AS told FROM c)
SELECT id, municipality_slug, category, cost, status, {HASH('told')} AS content_hash FROM j""")
def manual_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one by hand: what its form says wins, and the hash takes it in."""
    n = F.col("n")
    rows = served(spark, sf_dir).withColumn("content_hash", F.concat(F.lit("base"), (n % 100).cast("string")))
    choices = rows.select("id", F.when(n % 4 != 0, "tay").alias("municipality_slug"), F.when(n % 3 == 0, "auto").otherwise("arts").alias("category"), F.when(n % 2 == 0, "free").otherwise("unknown").alias("cost"), F.when(n % 10 == 5, "cancelled").otherwise("scheduled").alias("status"))
    return console.manual_choices(rows, choices).select("id", "municipality_slug", "category", "cost", "status", "content_hash")


@query(f"""{EV}, {LISTED}, e AS (SELECT id, n, CASE WHEN n % 20 = 1 THEN NULL ELSE cluster END AS cluster FROM le), w AS (SELECT id || 'new' AS id, id || 'new' AS event_id, 'solo' AS action, 'Saved' AS title, TRUE AS active, '2026-02-01' AS seen FROM e WHERE n % 30 = 0
  UNION ALL SELECT id, coalesce(cluster, id), CASE WHEN n % 3 = 0 AND cluster IS NOT NULL THEN 'merged' ELSE 'solo' END, 'Saved', (SELECT active FROM ev WHERE ev.n = e.n), '2026-01-01' FROM e) SELECT * FROM w""")
def manual_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events entered and edited by hand: an edit keeps its event and whether it is shown; merged events wait."""
    rows, events = listed(spark, sf_dir)
    none = lambda kind: F.lit(None).cast(kind)
    first = F.lit("2026-01-01").cast("timestamp")
    listings = rows.withColumns({"first_seen_at": first, "last_seen_at": first, "removed_at": none("timestamp"), "detail_hash": none("string"), "detail_attempts": F.lit(0)})
    form = rows.withColumn("title", F.lit("Saved"))
    saved = form.unionByName(form.where("n % 30 = 0").withColumn("id", F.concat("id", F.lit("new"))))
    after, waiting = console.save_manual(listings, events, saved, "2026-02-01")
    return waiting.join(after.select("id", "title", "active", F.date_format("first_seen_at", "yyyy-MM-dd").alias("seen")), "id")


@query(f"""{EV}, {LISTED}, asked AS (SELECT *, n % 4 = 0 AS shown FROM li WHERE n % 2 = 0 AND source_slug = 'manual') SELECT l.id, coalesce(a.shown, l.active) AS active, CASE WHEN NOT a.shown THEN '2026-02-01' END AS removed,
  CASE WHEN a.cluster_id IS NOT NULL AND l.n % 3 <> 0 THEN a.shown ELSE l.active END AS event_active FROM li l LEFT JOIN asked a ON a.id = l.id""")
def manual_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hand removed and brought back: those of one listing follow it, merged ones stay."""
    rows, events = listed(spark, sf_dir)
    asked = rows.where("n % 2 = 0").select("id", (F.col("n") % 4 == 0).alias("active"))
    listings, after = console.set_active(rows.withColumn("removed_at", F.lit(None).cast("timestamp")), events, asked, "2026-02-01")
    return listings.join(after.select("n", F.col("active").alias("event_active")), "n").select("id", "active", F.date_format("removed_at", "yyyy-MM-dd").alias("removed"), "event_active")


EVIDENCE = """CASE n % 5 WHEN 0 THEN '{"date":"on May 5","pages":3,"none":null}' WHEN 1 THEN '[1]' WHEN 2 THEN 'broken {' WHEN 3 THEN '{"a b":"he said \\"no\\"","deep":{"x":"y"}}' END"""


@query(f"{EV} SELECT id, CASE n % 5 WHEN 0 THEN 'date=on May 5' WHEN 3 THEN 'a b=he said \"no\"' ELSE '' END AS quotes FROM ev")
def evidence_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that support a draft: the texts of a JSON object, and nothing from anything else."""
    n = F.col("n")
    given = [F.lit('{"date":"on May 5","pages":3,"none":null}'), F.lit("[1]"), F.lit("broken {"), F.lit('{"a b":"he said \\"no\\"","deep":{"x":"y"}}'), F.lit(None).cast("string")]
    found = console.quotes(F.element_at(F.array(*given), (n % 5 + 1).cast("int")))
    return served(spark, sf_dir).select("id", F.array_join(F.array_sort(F.transform(F.map_entries(found), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("quotes"))


@query(f"""{EV}, p AS (SELECT id, title, venue_name, cost, starts_at_utc, row_number() OVER (ORDER BY starts_at_utc, id) AS nth FROM ev WHERE active AND category <> 'civic-meeting' AND cost <> 'paid')
SELECT '{{"count":100,"truncated":true,"events":[' || string_agg('{{"id":' || to_json(id) || ',"title":' || to_json(title) || ',"venue_name":' || coalesce(to_json(venue_name), 'null') || ',"cost":' || to_json(cost) || ',"starts_at_utc":' || to_json(starts_at_utc) || '}}', ',' ORDER BY nth) || ']}}' AS json FROM p WHERE nth <= 100""")
def event_page_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred events as the JSON that a reader's program gets."""
    page = fl.page(with_places(spark, sf_dir), fl.Filters.parse(""), 100)
    return views.event_page_json(page.select("id", "title", "venue_name", "cost", "starts_at_utc", "truncated"), ["starts_at_utc", "id"])


_DATE = "strftime(CAST(local_date AS DATE), '%A, %B %-d, %Y')"
_CLOCK = lambda c: f"CAST((CAST(substr({c}, 1, 2) AS INTEGER) + 11) % 12 + 1 AS VARCHAR) || substr({c}, 3, 3) || CASE WHEN CAST(substr({c}, 1, 2) AS INTEGER) < 12 THEN ' a.m.' ELSE ' p.m.' END"
_SAID = f"'- ' || title || CASE WHEN status = 'cancelled' THEN ' (CANCELLED)' ELSE '' END || chr(10) || '  ' || concat_ws(' · ', {_DATE}, CASE WHEN time_precision <> 'date-only' THEN {_CLOCK('local_time')} END, name) || chr(10) || '  https://example.org/e/' || short_code"


@query(f"""{EV}, {PLACES}, c AS (SELECT user_id % 20 AS user_id, id, starts_at_utc, n, {_SAID} AS said FROM (SELECT *, {CODE('id')} AS short_code FROM ev) LEFT JOIN places ON slug = municipality_slug WHERE active),
s AS (SELECT *, 0 AS section FROM c WHERE n % 31 = 7 UNION ALL SELECT *, 1 FROM c WHERE n % 3 = 1 AND n % 31 <> 7),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, section ORDER BY starts_at_utc, id) AS nth, count(*) OVER (PARTITION BY user_id, section) AS c FROM s),
p AS (SELECT user_id, section, CASE section WHEN 0 THEN 'YOUR PINS' ELSE 'A VIEW' END || chr(10) || chr(10) || string_agg(said, chr(10) || chr(10) ORDER BY nth) || CASE WHEN section = 1 AND max(c) > 10 THEN chr(10) || chr(10) || '  See all: https://example.org/?v=1' ELSE '' END AS part FROM r WHERE section = 0 OR nth <= 10 GROUP BY user_id, section)
SELECT user_id, 'Today on Fair: Wednesday, March 15, 2000' AS subject, 'Here is what is on for you today.' || chr(10) || chr(10) || string_agg(part, chr(10) || chr(10) || chr(10) ORDER BY section) || chr(10) || chr(10) || '--' || chr(10) || 'You are getting this because you turned on a daily digest at Fair.' || chr(10)
  || 'Change it, or turn it off: https://example.org/account#digest' || chr(10) || 'Unsubscribe with one click: https://example.org/unsubscribe/' || CAST(user_id AS VARCHAR) || chr(10) AS text FROM p GROUP BY user_id""")
def digest_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reader's digest as text: pins first, then a view with its first ten."""
    events = fl.with_places(coded(spark, sf_dir).where("active"), municipalities(spark))
    section = F.when(F.col("n") % 31 == 7, 0).when(F.col("n") % 3 == 1, 1)
    rows = events.select((F.col("user_id") % 20).alias("user_id"), section.alias("section"), F.col("id").alias("event_id"), F.col("starts_at_utc").alias("starts_at"), feeds.event_text(events, "https://example.org").alias("text")).where("section IS NOT NULL")
    shown = queues.digest_sections(rows.drop("text")).join(rows.select("event_id", "text"), "event_id")
    about = shown.withColumns({"heading": F.when(F.col("section") == 0, "Your pins").otherwise("A view"), "more": F.when(F.col("more"), "https://example.org/?v=1"), "unsubscribe": F.concat(F.lit("https://example.org/unsubscribe/"), F.col("user_id").cast("string"))})
    return feeds.digest_messages(about, "daily", TODAY, TODAY, "Fair", "https://example.org")


@query(f"WITH {PLACES}, p AS (SELECT slug, name, row_number() OVER (ORDER BY slug) - 1 AS n FROM places) SELECT c_custkey, slug, " + "'{\"@context\":\"https://schema.org\",\"@type\":\"BreadcrumbList\",\"itemListElement\":[{\"@type\":\"ListItem\",\"position\":1,\"name\":\"Fair\",\"item\":\"https://example.org/\"},{\"@type\":\"ListItem\",\"position\":2,\"name\":' || to_json(name) || ',\"item\":\"https://example.org/place/' || slug || '\"}]}' AS json_ld FROM customer JOIN p ON c_custkey % (SELECT count(*) FROM p) = n")
def place_breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way to the page of each reader's (customer's) place."""
    places = sorted((r["slug"], r["name"]) for r in municipalities(spark).collect())  # a fixed dimension
    of = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in places]), (F.col("c_custkey") % len(places) + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", of(0).alias("slug"), of(1).alias("name"))
    return rows.select("c_custkey", "slug", views.breadcrumbs("Fair", "https://example.org", F.col("name"), F.concat(F.lit("https://example.org/place/"), F.col("slug"))).alias("json_ld"))


@query(f"""{EV}, r AS (SELECT municipality_slug, title, {CODE('id')} AS short_code, row_number() OVER w AS nth, count(*) OVER (PARTITION BY municipality_slug) AS c FROM ev WHERE active AND municipality_slug IS NOT NULL AND local_date >= '{TODAY}' WINDOW w AS (PARTITION BY municipality_slug ORDER BY starts_at_utc, id))
SELECT municipality_slug, '{{"@context":"https://schema.org","@type":"ItemList","name":' || to_json('Events in ' || municipality_slug) || ',"numberOfItems":' || max(c) || ',"itemListElement":[' || string_agg('{{"@type":"ListItem","position":' || nth || ',"name":' || to_json(title) || ',"url":"https://example.org/e/' || short_code || '"}}', ',' ORDER BY nth) || ']}}' AS json_ld FROM r WHERE nth <= 50 GROUP BY municipality_slug""")
def place_item_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty events of each place as search engines read a list."""
    upcoming = coded(spark, sf_dir).where(f"active AND municipality_slug IS NOT NULL AND local_date >= '{TODAY}'")
    return views.item_lists(upcoming, "municipality_slug", F.concat(F.lit("Events in "), F.col("municipality_slug")), "https://example.org")


@query(f"{EV} SELECT user_id % 50 AS user_id, id, local_date FROM ev WHERE active AND {LAST} >= '{TODAY}'")
def shared_calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each shared page shows: the pinned events whose last day has not passed."""
    events = served(spark, sf_dir)
    pins = events.select((F.col("user_id") % 50).alias("user_id"), F.col("id").alias("event_id"))
    return views.live_pins(pins.union(pins), events.drop("user_id"), TODAY).select("user_id", "id", "local_date")


@query("SELECT p.user_id, f.id, f.vevent FROM (" + ORACLE["calendar_feed"] + ") f JOIN (" + f"{EV} SELECT id, user_id % 50 AS user_id FROM ev" + ") p USING (id)")
def pinned_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of every reader's private feed: their pinned events as they are now."""
    events = with_places(spark, sf_dir)
    pins = events.select((F.col("user_id") % 50).alias("user_id"), F.col("id").alias("event_id"))
    entries = feeds.event_lines(events.where("active"), "example.org", "https://example.org", "20000101T000000Z", folded=False)
    return views.live_pins(pins, events.drop("user_id")).select("user_id", "id").join(entries, "id").select("user_id", "id", "vevent")


@query(f"""{EV}, g AS (SELECT coalesce(municipality_slug, 'none') AS place, id, local_date FROM ev WHERE active) SELECT place, 1 AS part, id, 'BEGIN:VEVENT' AS opens FROM g UNION ALL SELECT DISTINCT place, 0, NULL, 'BEGIN:VCALENDAR' FROM g UNION ALL SELECT DISTINCT place, 2, NULL, 'END:VCALENDAR' FROM g""")
def place_calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each place's calendar file, head and end included."""
    events = with_places(spark, sf_dir).where("active").withColumn("place", F.coalesce("municipality_slug", F.lit("none")))
    rows = feeds.calendar_rows(events, "place", F.concat(F.lit("Events, "), F.col("place")), "example.org", "https://example.org", "20000101T000000Z")
    return rows.select("place", "part", "id", F.regexp_extract("text", "^[A-Z:]+", 0).alias("opens"))


@query("SELECT o_orderkey, strftime(d - 14, '%Y-%m-%d') AS first, strftime(d + 180, '%Y-%m-%d') AS last, strftime(d - 14 - 400, '%Y-%m-%d') AS published FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def sync_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of a run on any day, and from when a list's posts are asked for."""
    first, last = times.default_window(F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", first.cast("string").alias("first"), last.cast("string").alias("last"), times.published_after(first).cast("string").alias("published"))


SIZES = "sz AS (SELECT 'https://img.example.org/' || CAST(i AS VARCHAR) || '.png' AS url, CASE WHEN i % 3 > 0 THEN i * 10 END AS width, CASE WHEN i % 3 > 1 THEN i * 5 ELSE 7 END AS height FROM range(0, 25) t(i))"


def _sizes(spark: SparkSession) -> DataFrame:
    i = F.col("id").cast("int")
    return spark.range(25).select(F.concat(F.lit("https://img.example.org/"), i.cast("string"), F.lit(".png")).alias("url"), F.when(i % 3 > 0, i * 10).alias("width"), F.when(i % 3 > 1, i * 5).otherwise(7).alias("height"), F.lit("2026-01-01").cast("timestamp").alias("checked_at"))


@query(f"{EV}, {SIZES} SELECT ev.id, CASE WHEN width > 0 AND height > 0 THEN width END AS width, CASE WHEN width > 0 AND height > 0 THEN height END AS height FROM ev LEFT JOIN sz ON sz.url = image_url")
def poster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's picture with its size, if it could be measured."""
    return console.measured_size(served(spark, sf_dir), _sizes(spark)).select("id", "size.width", "size.height")


@query(f"""{EV}, {SIZES}, open AS (SELECT image_url AS url FROM ev WHERE active AND image_url IS NOT NULL AND NOT contains(image_url, '//calendar.') AND image_url NOT IN (SELECT url FROM sz) GROUP BY image_url)
SELECT url, width, height, '2026-01-01' AS checked FROM sz UNION ALL SELECT url, CASE WHEN length(url) % 2 = 0 THEN length(url) * 10 END, CASE WHEN length(url) % 2 = 0 THEN 5 END, '2026-02-01' FROM open""")
def poster_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes after every picture that was never measured has been read, whatever their number."""
    sizes, events = _sizes(spark), served(spark, sf_dir)
    unread = queues.images(events, sizes, text.shareable_host(F.col("image_url")), budget=None).select("url")
    even = F.length("url") % 2 == 0
    read = unread.select("url", F.when(even, F.length("url") * 10).alias("width"), F.when(even, 5).alias("height"))
    return console.record_sizes(sizes, read, "2026-02-01").select("url", "width", "height", F.date_format("checked_at", "yyyy-MM-dd").alias("checked"))


_SAVED = [("m=tay,nowhere,barrie&cat=music&cost=free", "m=barrie%2Ctay&cat=music&cost=free"), ("cost=weird&civic=1&from=2026-01-01&to=bad", "civic=1&from=2026-01-01"), ("q=  a   b ", "q=a+b"), ("", "")]


@query("SELECT c_custkey, " + ", ".join(f"CASE c_custkey % 4 {' '.join(f'WHEN {n} THEN {O.q(v[k])}' for n, v in enumerate(_SAVED))} END AS {name}" for k, name in enumerate(("asked", "kept"))) + " FROM customer")
def saved_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query strings that readers (customers) asked for as they are kept: known values only, in one order."""

    @F.udf("string", useArrow=True)
    def saved(asked: str) -> str:
        return fl.Filters.parse(asked).saved()

    asked = F.element_at(F.array(*[F.lit(a) for a, _ in _SAVED]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", asked.alias("asked"), saved(asked).alias("kept"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'https://example.org/a' WHEN 1 THEN 'http://x.ca' END AS address, CASE c_custkey % 3 WHEN 0 THEN 'Tay Township' WHEN 1 THEN 'Oro Medonte' ELSE '' END AS named,
  'GET /v2?apikey=REDACTED&page=' || c_custkey AS logged, CASE c_custkey % 2 WHEN 0 THEN 'Bold and plain' ELSE 'See this (https://x.ca) soon' END AS plain, c_custkey % 5 = 0 AS marker, sha256('2000-03-15:' || CASE WHEN c_custkey % 7 = 0 THEN 'unknown' ELSE '10.0.0.' || c_custkey % 200 END) AS visitor FROM customer""")
def form_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses, names, log lines, markup, places that only say that an event is off, and keys of visitors."""
    k = F.col("c_custkey")
    of = lambda n, *given: F.element_at(F.array(*[F.lit(x) for x in given]), (k % n + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        text.web_address(of(4, " example.org/a ", "http://x.ca", "ftp://x.ca", " ")).alias("address"),
        text.title_case(of(3, "tay-township", "oro-medonte", "")).alias("named"),
        text.redact(F.concat(F.lit("GET /v2?apikey=s3cr3t"), k.cast("string"), F.lit("&page="), k.cast("string"))).alias("logged"),
        text.markdown_text(of(2, "## **Bold** and *plain*", "See [this](https://x.ca) soon")).alias("plain"),
        titles.location_is_marker(of(5, "This meeting has been CANCELLED", "Town Hall", "12 Main Street, cancelled for renovation works", "Hall", "Arena")).alias("marker"),
        hashes.visitor_key(F.lit("2000-03-15"), F.when(k % 7 != 0, F.concat(F.lit("10.0.0."), (k % 200).cast("string")))).alias("visitor"),
    )


@query(f"{EV} SELECT id, {_DATE} AS day, {_CLOCK('local_time')} AS clock, CAST((CAST(substr(local_time, 1, 2) AS INTEGER) + 11) % 12 + 1 AS VARCHAR) || replace(substr(local_time, 3, 3), ':00', '') || CASE WHEN CAST(substr(local_time, 1, 2) AS INTEGER) < 12 THEN 'am' ELSE 'pm' END AS compact, strftime(t, '%Y-%m-%d') AS date, extract(hour FROM t)::INTEGER AS hour, dayofweek(t)::INTEGER AS weekday FROM (SELECT *, CAST(replace(starts_at_utc, 'Z', '') AS TIMESTAMP) AT TIME ZONE 'UTC' AT TIME ZONE 'America/Toronto' AS t FROM ev)")
def shown_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and times in words, and the site's own clock at each start."""
    at = times.site_clock(F.col("starts_at"), F.col("timezone"))
    return served(spark, sf_dir).select("id", times.format_date(F.col("local_date")).alias("day"), times.format_time(F.col("local_time")).alias("clock"), times.compact_time(F.col("local_time")).alias("compact"), *[c.alias(n) for n, c in at.items()])


@query("SELECT id, fields FROM (SELECT 'e' || c_custkey AS id, CASE WHEN c_custkey % 6 = 5 THEN CASE WHEN c_custkey % 2 = 0 THEN '{\"title\":\"T\"}' END WHEN c_custkey % 6 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN '{\"title\":\"T\",\"active\":\"false\"}' ELSE '{\"active\":\"false\"}' END WHEN c_custkey % 6 = 2 THEN CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE NULL END WHEN c_custkey % 6 = 4 THEN '{\"title\":\"T\"}' END AS fields FROM customer) WHERE fields IS NOT NULL")
def override_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections after hiding, showing and clearing: one of which nothing is left is deleted."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, F.concat(F.lit("e"), k.cast("string")).alias("id"))
    held = rows.where(k % 2 == 0).select("id", F.lit('{"title":"T"}').alias("fields"))
    action = F.when(k % 6 == 0, "hide").when(k % 6 == 1, "show").when(k % 6 == 2, "clear:title").when(k % 6 == 3, "clear:all").when(k % 6 == 4, "clear:cost")
    return ov.store(held, rows.select("id", action.alias("action")).where("action IS NOT NULL"))


@query("""WITH RECURSIVE s AS (SELECT c_custkey AS id, c_nationkey AS sender, c_custkey * 600 AS t FROM customer WHERE c_custkey % 17 <> 1),
o AS (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY t) AS k FROM s),
g AS (SELECT id, sender, k, [t] AS held, TRUE AS ok FROM o WHERE k = 1
  UNION ALL SELECT o.id, o.sender, o.k, CASE WHEN len(list_filter(held, lambda x: x > t - 3600 * 20)) < 5 THEN list_append(list_filter(held, lambda x: x > t - 3600 * 20), t) ELSE held END, len(list_filter(held, lambda x: x > t - 3600 * 20)) < 5 FROM g JOIN o ON o.sender = g.sender AND o.k = g.k + 1)
SELECT id FROM g WHERE ok""")
def accepted_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions that are stored: checked, and fewer than five of the sender's were stored in the twenty hours before.
    Customers send one every ten minutes, those of a nation under one address."""
    k = F.col("c_custkey")
    sent = table(spark, sf_dir, "customer").select(k.alias("id"), F.lit("event").alias("kind"), F.when(k % 17 == 1, "x").alias("company"), *[F.lit("Fair").alias(c) for c in ("name", "title", "description", "comments")], *[F.lit(None).cast("string").alias(c) for c in ("email", "url", "date", "time")])
    came = table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_nationkey").cast("string").alias("sender"), F.timestamp_seconds(k * 600).alias("received_at"))
    return forms.accept_suggestions(forms.suggestions(sent), came, seconds=3600 * 20).select("id")
