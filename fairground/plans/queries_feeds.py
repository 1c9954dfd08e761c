"""Adapters of the remaining platforms and of event pages, over payloads that are made from the served events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import page_details
from . import oracle as O
from .catalog import query
from .queries_sources import EV, parsed
from .standins import served

TORONTO = "strftime(CAST(replace(starts_at_utc, 'Z', '') AS TIMESTAMP) AT TIME ZONE 'UTC' AT TIME ZONE 'America/Toronto', '%Y-%m-%dT%H:%M')"
SQUEEZED = "regexp_replace(title, '\\s+', ' ', 'g')"
TOWN = "substr(address, strpos(address, ', ') + 2)"
SLUG = "trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-')"
FAR = ("1990-01-01", "2010-12-31")


def later(days: int) -> str:
    return f"CAST(CAST(CAST(local_date AS DATE) + INTERVAL '{days}' DAY AS DATE) AS VARCHAR)"


def day() -> Column:
    return F.to_date("local_date")


def plus(days: int) -> Column:
    return F.date_add(day(), days).cast("string")


def at(time: Column | str) -> Column:
    """The event's day at a time."""
    return F.concat("local_date", F.lit("T"), F.lit(time) if isinstance(time, str) else time)


def hour12(upper: bool = True) -> Column:
    """The event's time on a clock of twelve hours."""
    hour = F.substring("local_time", 1, 2).cast("int")
    am, pm = (" AM", " PM") if upper else ("am", "pm")
    return F.concat((F.pmod(hour + 11, F.lit(12)) + 1).cast("string"), F.substring("local_time", 3, 3), F.when(hour < 12, am).otherwise(pm))


def town() -> Column:
    return F.expr("substring(address, instr(address, ', ') + 2)")


def named(**fields: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in fields.items()])


@query(f"""{EV}, timed AS (SELECT *, CASE n % 3 WHEN 0 THEN local_date || 'T' || local_time WHEN 1 THEN local_date || 'T00:00' ELSE {TORONTO} END AS start FROM ev)
SELECT CASE WHEN n % 4 = 0 THEN id ELSE '/event/' || id || '@' || start END AS external_id, {SQUEEZED} AS title, start AS local_start, CASE WHEN n % 3 = 1 THEN 'date-only' ELSE 'exact' END AS time_precision,
  CASE WHEN n % 3 = 0 AND n % 2 = 0 THEN local_date || 'T23:00' WHEN n % 3 = 1 AND n % 5 <> 0 THEN {later(2)} || 'T23:59' END AS local_end, 'https://d.example.org/event/' || id AS url FROM timed""")
def adapter_drupal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar settings in a page, JSON inside JSON: ISO times, days and seconds; an all-day end is the day after."""
    n = F.col("n")
    shared = {"eid": F.when(n % 4 == 0, F.col("id")).otherwise(""), "url": F.concat(F.lit("/event/"), F.col("id")), "title": F.concat(F.lit('<span class="fc-time">10:30</span> '), F.col("title"))}
    iso = named(**shared, start=at(F.concat("local_time", F.lit(":00"))), end=F.when(n % 2 == 0, at("23:00:00")))
    whole = named(**shared, start=F.col("local_date"), end=F.when(n % 5 == 0, plus(1)).otherwise(plus(3)), allDay=F.lit(True))
    seconds = named(**shared, start=F.unix_timestamp("starts_at"))
    inner = F.concat(F.lit('{"events":['), F.when(n % 3 == 0, F.to_json(iso)).when(n % 3 == 1, F.to_json(whole)).otherwise(F.to_json(seconds)), F.lit("]}"))
    page = F.concat(F.lit('<html><script type="application/json" data-drupal-selector="drupal-settings-json">'), F.to_json(named(fullCalendarView=F.array(named(calendar_options=inner)))), F.lit("</script></html>"))
    return parsed(served(spark, sf_dir), "drupal-events", page, origin="https://d.example.org").select("external_id", "title", "local_start", "time_precision", "local_end", "url")


@query(f"""{EV}, timed AS (SELECT *, CASE WHEN n % 3 = 0 THEN local_date || 'T00:00' ELSE local_date || 'T' || local_time END AS start, CASE WHEN n % 3 = 0 THEN {later(2)} || 'T23:59' WHEN n % 2 = 0 THEN local_date || 'T23:30' ELSE local_date || 'T01:00' END AS stop FROM ev)
SELECT '/e/' || id || '@' || start AS external_id, {SQUEEZED} AS title, start AS local_start, CASE WHEN n % 3 = 0 THEN 'date-only' ELSE 'exact' END AS time_precision, CASE WHEN stop > start THEN stop END AS local_end, 'https://d.example.org/e/' || id AS url FROM timed""")
def adapter_drupal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a listing view: offsets are dropped, an end that is no later than the start too."""
    n = F.col("n")
    first = F.when(n % 3 == 0, F.col("local_date")).otherwise(at(F.concat("local_time", F.lit(":00-04:00"))))
    second = F.when(n % 3 == 0, plus(2)).when(n % 2 == 0, at("23:30:00-04:00")).otherwise(at("01:00:00-04:00"))
    page = F.concat(F.lit('<div class="view"><div class="views-row"><span class="views-field views-field-title"><a href="/e/'), F.col("id"), F.lit('">'), F.col("title"), F.lit('</a></span><time datetime="'), first, F.lit('">a</time> - <time datetime="'), second, F.lit('">b</time></div></div>'))
    return parsed(served(spark, sf_dir), "drupal-events", page, origin="https://d.example.org", mode="rows").select("external_id", "title", "local_start", "time_precision", "local_end", "url")


@query(f"""{EV}, times AS (
  SELECT *, 0 AS part, CASE WHEN n % 4 = 2 THEN {TORONTO} WHEN n % 4 = 3 THEN local_date || 'T00:00' ELSE local_date || 'T' || local_time END AS start FROM ev
  UNION ALL SELECT *, 1, {later(7)} || 'T' || local_time FROM ev WHERE n % 4 = 1)
SELECT CAST(n AS VARCHAR) || CASE WHEN n % 4 = 1 THEN '@' || start ELSE '' END AS external_id, {SQUEEZED} AS title, start AS local_start, CASE WHEN n % 4 = 3 THEN 'date-only' ELSE 'exact' END AS time_precision,
  CASE WHEN n % 4 < 2 THEN substr(start, 1, 10) || 'T23:15' WHEN n % 4 = 2 AND n % 3 <> 0 THEN strftime(CAST(replace(starts_at_utc, 'Z', '') AS TIMESTAMP) AT TIME ZONE 'UTC' AT TIME ZONE 'America/Toronto' + INTERVAL '1' HOUR, '%Y-%m-%dT%H:%M') END AS local_end,
  description, venue_name, address, category AS labels, CASE WHEN n % 4 <> 2 THEN image_url END AS image_url, url FROM times""")
def adapter_eventon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts and their pages: times of the page's JSON-LD (unpadded; several make several rows), else of its data-time spans."""
    c, n = F.col, F.col("n")
    dated = lambda d, time: F.concat(F.year(d).cast("string"), F.lit("-"), F.month(d).cast("string"), F.lit("-"), F.dayofmonth(d).cast("string"), F.lit("T"), time, F.lit("-4:00"))
    clock = F.concat(F.substring("local_time", 1, 2).cast("int").cast("string"), F.substring("local_time", 3, 3))

    def told(days: int) -> Column:
        d = F.date_add(day(), days)
        body = F.struct(F.lit("Event").alias("@type"), dated(d, F.when(n % 4 == 3, "0:00").otherwise(clock)).alias("startDate"), dated(d, F.when(n % 4 == 3, "23:59").otherwise(F.lit("23:15"))).alias("endDate"), c("description"), c("image_url").alias("image"))
        return F.concat(F.lit('<script type="application/ld+json">'), F.to_json(body), F.lit("</script>"))

    since = F.unix_timestamp("starts_at")
    spans = F.concat(F.lit('<i data-time="'), since.cast("string"), F.lit("-"), (since + F.when(n % 3 == 0, 0).otherwise(3600)).cast("string"), F.lit('"></i><div class="eventon_desc_in"><p>'), c("description"), F.lit("</p></div>"))
    times = F.when(n % 4 == 1, F.concat(told(0), told(7))).when(n % 4 == 2, spans).otherwise(told(0))
    page = F.concat(F.lit('<html><div data-location_name="'), F.coalesce("venue_name", F.lit("")), F.lit('" data-location_address="'), c("address"), F.lit('"></div>'), times, F.lit("</html>"))
    post = named(id=n, title=named(rendered=c("title")), event_type=F.array(F.lit(5), F.lit(6)), link=c("url"))
    rows = parsed(served(spark, sf_dir), "eventon", F.to_json(named(post=post, page=page, types=F.create_map(F.lit("5"), c("category")))))
    return rows.select("external_id", "title", "local_start", "time_precision", "local_end", "description", "venue_name", "address", F.array_join("categories", ",").alias("labels"), "image_url", "url")


@query(f"""{EV} SELECT id || '@' || local_date AS external_id, {SQUEEZED} AS title, CASE WHEN n % 3 = 0 THEN local_date || 'T' || local_time ELSE local_date || 'T00:00' END AS local_start, CASE WHEN n % 3 = 0 THEN 'exact' ELSE 'date-only' END AS time_precision,
  CASE WHEN n % 3 = 0 THEN local_date || 'T23:45' WHEN n % 3 = 2 AND '2000' || substr({later(2)}, 5) >= local_date THEN '2000' || substr({later(2)}, 5) || 'T17:00' END AS local_end,
  category AS labels, 'https://s.example.org/events/' || id AS url, venue_name, address, cost_text, organizer, 'https://i.example.org/a.png' AS image_url FROM ev WHERE local_date BETWEEN '2000-01-01' AND '2000-12-31' AND category <> 'civic-meeting'""")
def adapter_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards with dates that name no year, the last of a card's copies, and labelled lines of the pages behind them."""
    c, n = F.col, F.col("n")
    short = lambda d: F.concat(F.date_format(d, "MMM"), F.lit(" "), F.dayofmonth(d).cast("string"))
    when = F.when(n % 3 == 0, F.concat(short(day()), F.lit(" "), hour12(False), F.lit(" - 11:45pm"))).when(n % 3 == 1, short(day())).otherwise(F.concat(short(day()), F.lit(" – "), short(F.date_add(day(), 2)), F.lit(" 5:00pm")))

    def card(title: Column) -> Column:
        return F.concat(
            F.lit('<div class="card-body" data-id="'), c("id"), F.lit('"><a href="/'), c("category"), F.lit('">'), c("category"), F.lit('</a><img src="https://i.example.org/a.png;w=300;h=200;mode=crop;"><a class="event-details" href="/events/'), c("id"),
            F.lit('"><span class="short-post">'), title, F.lit("</span></a><div><button>Save</button><span>"), when, F.lit("</span></div></div>"),
        )

    line = lambda label, x: F.coalesce(F.concat(F.lit(f"<p>{label}: "), x, F.lit("</p>")), F.lit(""))
    page = F.concat(F.lit('<div id="post">'), F.coalesce(F.concat(F.lit('<span class="title">'), c("organizer"), F.lit("</span>")), F.lit("")), F.lit("<p>Come along.</p>"), line("Location", c("venue_name")), line("Address", c("address")), line("Cost", c("cost_text")), F.lit("</div>"))
    body = named(cards=F.concat(card(F.lit("Old name")), card(c("title"))), details=F.create_map(c("id"), page))
    year = served(spark, sf_dir).where("local_date BETWEEN '2000-01-01' AND '2000-12-31' AND category <> 'civic-meeting'")
    rows = parsed(year, "spaces", F.to_json(body), window=("2000-01-01", "2000-12-31"), origin="s.example.org")
    return rows.select("external_id", "title", "local_start", "time_precision", "local_end", F.array_join("categories", ",").alias("labels"), "url", "venue_name", "address", "cost_text", "organizer", "image_url")


@query(f"""{EV} SELECT id AS external_id, title, CASE WHEN n % 3 = 0 THEN local_date || 'T00:00' ELSE local_date || 'T' || local_time END AS local_start, CASE WHEN n % 3 <> 0 THEN local_date || 'T23:20' END AS local_end, description, venue_name, address || ', ' || {TOWN} || ', ON' AS address, {TOWN} AS municipality_hint,
  CASE n % 4 WHEN 0 THEN 'Free' WHEN 1 THEN '$5' WHEN 2 THEN '$5–$12.5' ELSE cost_text END AS cost_text, CASE WHEN n % 4 = 0 THEN TRUE END AS is_free, 'https://c.example.org/#/details/' || {SLUG} || '/' || id AS url
FROM ev WHERE {O.municipality(TOWN, f"address || ', ' || {TOWN} || ', ON'", "venue_name")} IS NOT NULL""")
def adapter_cityspark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A portal's pages: local times under a false Z, the first copy of an id, only rows that can be placed."""
    c, n = F.col, F.col("n")
    fields = {
        "PId": c("id"), "DateStart": at(F.concat("local_time", F.lit(":00Z"))), "DateEnd": at("23:20:00Z"), "HasTime": F.lit(True), "AllDay": n % 3 == 0, "Free": n % 4 == 0, "Price": F.when((n % 4).isin(1, 2), 5.0), "PriceHigh": F.when(n % 4 == 2, 12.5),
        "PriceText": F.when(n % 4 == 3, c("cost_text")), "Description": F.concat(F.lit("<p>"), c("description"), F.lit("</p>")), "Venue": c("venue_name"), "Address": c("address"), "CityState": F.concat(town(), F.lit(", ON")),
    }
    body = named(Success=F.lit(True), Value=F.array(named(**fields, Name=c("title")), named(**fields, Name=F.lit("Late copy"))))
    rows = parsed(served(spark, sf_dir), "cityspark", F.to_json(body), origin="https://c.example.org")
    return rows.select("external_id", "title", "local_start", "local_end", "description", "venue_name", "address", "municipality_hint", "cost_text", "is_free", "url")


@query(f"""{EV} SELECT id AS external_id, CASE WHEN status = 'cancelled' THEN 'CANCELLED: ' ELSE '' END || title AS title, CASE WHEN n % 7 = 0 THEN local_date || 'T00:00' ELSE local_date || 'T' || local_time END AS local_start,
  CASE WHEN n % 7 <> 0 THEN CASE WHEN n % 2 = 0 THEN local_date ELSE {later(1)} END || 'T23:30' WHEN n % 2 = 1 THEN {later(1)} || 'T23:59' END AS local_end, venue_name, address, CASE n % 4 WHEN 0 THEN 'Free' WHEN 1 THEN '$5' WHEN 2 THEN '$5–$12.50' END AS cost_text,
  n % 4 = 0 AS is_free, category AS labels, image_url, url FROM ev WHERE n % 9 <> 0 AND local_date <= '1996-12-31' AND {O.municipality(TOWN, "address", "venue_name")} IS NOT NULL""")
def adapter_eventbrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results: online rows, rows behind the window and rows that can't be placed go."""
    c, n = F.col, F.col("n")
    money = lambda k, v: F.when(k, named(major_value=F.lit(v)))
    tag = lambda p, x: named(prefix=F.lit(p), display_name=x)
    row = named(
        id=c("id"), name=c("title"), url=c("url"), is_cancelled=c("status") == "cancelled", is_online_event=n % 9 == 0, start_date=c("local_date"), start_time=c("local_time"), hide_start_date=n % 7 == 0,
        end_date=F.when(n % 2 == 0, c("local_date")).otherwise(plus(1)), end_time=F.lit("23:30:00"), summary=c("description"), tags=F.array(tag("EventbriteCategory", c("category")), tag("OrganizerTag", F.lit("hidden"))),
        primary_venue=named(name=c("venue_name"), address=named(city=town(), localized_address_display=c("address"))), ticket_availability=named(is_free=n % 4 == 0, minimum_ticket_price=money((n % 4).isin(1, 2), "5.00"), maximum_ticket_price=money(n % 4 == 2, "12.50")),
        image=F.when(c("image_url").isNotNull(), named(url=c("image_url"))),
    )
    rows = parsed(served(spark, sf_dir), "eventbrite", F.to_json(named(events=named(results=F.array(row)))), window=("1990-01-01", "1996-12-31"))
    return rows.select("external_id", "title", "local_start", "local_end", "venue_name", "address", "cost_text", "is_free", F.array_join("categories", ",").alias("labels"), "image_url", "url")


@query(f"""{EV} SELECT id AS external_id, CASE status WHEN 'cancelled' THEN 'CANCELLED: ' WHEN 'rescheduled' THEN 'RESCHEDULED: ' ELSE '' END || title AS title, CASE WHEN n % 5 = 0 THEN local_date || 'T00:00' ELSE local_date || 'T' || local_time END AS local_start, venue_name, address || ', ' || {TOWN} AS address,
  CASE n % 4 WHEN 0 THEN '$25' WHEN 1 THEN '$25.50–$60' WHEN 2 THEN '$40' END AS cost_text, FALSE AS is_free, 'Music,' || category AS labels, CASE WHEN n % 3 = 0 THEN 'https://t.example.org/old900.png' ELSE 'https://t.example.org/wide1024.png' END AS image_url, url
FROM ev WHERE n % 8 <> 0 AND n % 11 <> 0 AND {O.municipality(TOWN, f"address || ', ' || {TOWN}", "venue_name")} IS NOT NULL""")
def adapter_ticketmaster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues' events: test rows and open dates go, all are paid, the smallest wide picture that is large enough."""
    c, n = F.col, F.col("n")
    image = lambda ratio, width, name: named(ratio=F.lit(ratio), width=F.lit(width), url=F.lit(f"https://t.example.org/{name}{width}.png"))
    price = lambda low, high: F.array(named(min=F.lit(low).cast("double"), max=F.lit(high).cast("double")))
    row = named(
        id=c("id"), name=c("title"), url=c("url"), test=n % 8 == 0, info=c("description"), dates=named(start=named(localDate=c("local_date"), localTime=F.concat("local_time", F.lit(":00")), dateTBA=n % 11 == 0, timeTBA=n % 5 == 0), status=named(code=c("status"))),
        priceRanges=F.when(n % 4 == 0, price(25.0, 25.0)).when(n % 4 == 1, price(25.5, 60.0)).when(n % 4 == 2, price(40.0, None)), classifications=F.array(named(segment=named(name=F.lit("Music")), genre=named(name=c("category")), subGenre=named(name=F.lit("Undefined")))),
        images=F.when(n % 3 == 0, F.array(image("16_9", 640, "wide"), image("4_3", 900, "old"))).otherwise(F.array(image("16_9", 2048, "wide"), image("4_3", 3000, "old"), image("16_9", 1024, "wide"), image("16_9", 640, "wide"))),
        _embedded=named(venues=F.array(named(name=c("venue_name"), city=named(name=town()), address=named(line1=c("address"))))),
    )
    rows = parsed(served(spark, sf_dir), "ticketmaster", F.to_json(named(_embedded=named(events=F.array(row)))))
    return rows.select("external_id", "title", "local_start", "venue_name", "address", "cost_text", "is_free", F.array_join("categories", ",").alias("labels"), "image_url", "url")


@query(f"""{EV}, placed AS (SELECT *, concat_ws(', ', venue_name, address) AS whole FROM ev)
SELECT id AS external_id, title, CASE WHEN n % 3 = 0 OR local_time = '00:00' THEN local_date || 'T00:00' ELSE local_date || 'T' || local_time END AS local_start, CASE WHEN n % 3 = 0 OR local_time = '00:00' THEN 'date-only' ELSE 'exact' END AS time_precision,
  CASE WHEN n % 3 = 0 THEN {later(1)} || 'T23:59' WHEN n % 3 = 1 THEN local_date || 'T23:10' END AS local_end, CASE WHEN regexp_matches(substr(whole, strpos(whole || ',', ',')), '[0-9]') THEN split_part(whole, ',', 1) ELSE whole END AS venue_name,
  CASE WHEN regexp_matches(substr(whole, strpos(whole || ',', ',')), '[0-9]') THEN whole END AS address, cost_text, organizer, 'https://o.example.org/events/' || id AS url FROM placed""")
def adapter_sitefinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OData pages: the clock of the offset fields, a midnight start is no time, an all-day end is the day after."""
    c, n = F.col, F.col("n")
    whole = n % 3 == 0
    row = named(
        Id=c("id"), Title=c("title"), IsRecurrent=F.lit(False), AllDayEvent=whole, EventStartWithOffset=at(F.concat(F.when(whole, "00:00").otherwise(c("local_time")), F.lit(":00-04:00"))),
        EventEndWithOffset=F.when(whole, F.concat(plus(2), F.lit("T00:00:00-04:00"))).when(n % 3 == 1, at("23:10:00-04:00")), Content=F.concat(F.lit("<p>"), c("description"), F.lit("</p>")), Location=c("venue_name"), Street=c("address"),
        Admission=c("cost_text"), ContactName=c("organizer"), ItemDefaultUrl=F.concat(F.lit("/"), c("id")),
    )
    rows = parsed(served(spark, sf_dir), "sitefinity", F.to_json(named(value=F.array(row))), origin="https://o.example.org", detail="/events")
    return rows.select("external_id", "title", "local_start", "time_precision", "local_end", "venue_name", "address", "cost_text", "organizer", "url")


@query(f"""{EV} SELECT id AS external_id, {SQUEEZED} AS title, CASE WHEN n % 6 = 0 THEN local_date || 'T00:00' ELSE local_date || 'T' || local_time END AS local_start, CASE WHEN n % 2 = 0 THEN local_date || 'T23:05' END AS local_end, description, address || ', ' || {TOWN} AS address, {TOWN} AS municipality_hint,
  CASE n % 5 WHEN 3 THEN '$15 at the door' END AS cost_text, organizer, 'https://g.example.org/events/details/' || {SLUG} || '-' || id AS url FROM ev WHERE n % 10 <> 4 AND local_date BETWEEN '1993-01-01' AND '1997-12-31'""")
def adapter_growthzone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chamber's XML list: approved rows of the window; what vendors pay and what members get is no admission."""
    c, n = F.col, F.col("n")
    slug = F.regexp_replace(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), "^-|-$", "")
    price = F.when(n % 5 == 0, "Vendor booth fee $40").when(n % 5 == 1, "N/A").when(n % 5 == 2, "Free for members").when(n % 5 == 3, "$15 at the door").otherwise("")
    fields = {
        "EventID": c("id"), "Name": c("title"), "Slug": slug, "Status": F.when(n % 10 == 4, "PENDING").otherwise("APPROVED"), "StartDate": at(F.concat("local_time", F.lit(":00"))), "EndDate": F.when(n % 2 == 0, at("23:05:00")).otherwise(at("00:00:00")),
        "IsAllDayEvent": F.when(n % 6 == 0, "true").otherwise("false"), "Description": F.concat(F.lit("&lt;p&gt;"), c("description"), F.lit("&lt;/p&gt;")), "MapAddr1": c("address"), "MapCity": town(), "AdmissionDesc": price, "ContactDesc": F.coalesce("organizer", F.lit("")),
    }
    body = F.concat(F.lit('<ArrayOfEventDisplay xmlns="http://x.example.org/"><EventDisplay>'), *[x for k, v in fields.items() for x in (F.lit(f"<{k}>"), v, F.lit(f"</{k}>"))], F.lit("</EventDisplay></ArrayOfEventDisplay>"))
    rows = parsed(served(spark, sf_dir), "growthzone", body, window=("1993-01-01", "1997-12-31"), origin="https://g.example.org")
    return rows.select("external_id", "title", "local_start", "local_end", "description", "address", "municipality_hint", "cost_text", "organizer", "url")


@query(f"""{EV}, shows AS (SELECT *, '9' || CAST(n AS VARCHAR) AS key, local_date AS date FROM ev WHERE n % 3 <> 0
  UNION ALL SELECT ev.*, CAST(k AS VARCHAR) || CAST(n AS VARCHAR), CASE k WHEN 1 THEN local_date ELSE {later(5)} END FROM ev, (VALUES (1), (2)) AS r(k) WHERE n % 3 = 0)
SELECT key AS external_id, {SQUEEZED} AS title, date || 'T' || local_time AS local_start, venue_name, FALSE AS is_free, 'https://secure1.tixhub.com/orillia/online/b_otix.asp?cboPerformances=' || key || '&cboEvent=' || CAST(n AS VARCHAR) AS url
FROM shows WHERE date BETWEEN '1993-01-01' AND '1997-12-31'""")
def adapter_tixhub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box office: a run is a row for each performance that its page lists."""
    c, n = F.col, F.col("n")
    number, run = n.cast("string"), n % 3 == 0
    option = lambda k, days: F.concat(F.lit(f'<option value="{k}'), number, F.lit('">'), F.date_format(F.date_add(day(), days), "MMMM d, yyyy"), F.lit(" - "), hour12(), F.lit("</option>"))
    index = F.concat(
        F.lit("<table><tr><th>Date</th></tr><tr><td>"), F.when(run, "Multiple dates").otherwise(F.date_format(day(), "M/d/yyyy")), F.lit("</td><td>"), hour12(), F.lit('</td><td><a href="b_otix.asp?cboPerformances=9'), number, F.lit("&amp;cboEvent="), number,
        F.when(run, "&amp;bmultiple=1").otherwise(""), F.lit('">'), c("title"), F.lit("</a></td><td>"), F.coalesce("venue_name", F.lit("")), F.lit("</td></tr></table>"),
    )
    page = F.concat(F.lit('<select><option value="">Choose</option>'), option(1, 0), option(2, 5), F.lit("</select>"))
    rows = parsed(served(spark, sf_dir), "tixhub", F.to_json(named(index=index, runs=F.create_map(number, page))), window=("1993-01-01", "1997-12-31"), origin="Orillia")
    return rows.select("external_id", "title", "local_start", "venue_name", "is_free", "url")


@query(f"""{EV} SELECT local_date || '-' || replace(t, ':', '') || '-' || CASE WHEN n % 5 = 0 THEN 'tba' ELSE {SLUG} END AS external_id, CASE WHEN n % 5 = 0 THEN 'MAT Film Night (film to be announced)' ELSE 'MAT Film Night: ' || {SQUEEZED} END AS title, local_date || 'T' || t AS local_start,
  CASE WHEN n % 5 <> 0 THEN description END AS description, 'Galaxy Cinemas' AS venue_name, '$12' AS cost_text, 'Film' AS labels FROM ev, (VALUES ('16:30'), ('19:00')) AS s(t)""")
def adapter_film_nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of prose: a film and its day, a row for each screening, films that are to be announced."""
    c = F.col
    page = F.concat(F.lit("<html><script>var x = 1</script><h3>"), F.when(c("n") % 5 == 0, "TBA").otherwise(c("title")), F.lit("</h3><p>"), F.date_format(day(), "EEEE, MMMM d, yyyy"), F.lit(" (4:30 p.m., 7:00 p.m.)</p><p>"), c("description"), F.lit("</p></html>"))
    rows = parsed(served(spark, sf_dir), "mat-film-nights", page, venue="Galaxy Cinemas", admission="$12")
    return rows.select("external_id", "title", "local_start", "description", "venue_name", "cost_text", F.array_join("categories", ",").alias("labels"))


@query(f"""{EV} SELECT id, CASE WHEN n % 7 <> 0 THEN description END AS description, CASE WHEN n % 2 = 1 AND n % 7 <> 0 THEN cost_text END AS cost_text,
  CASE WHEN n % 7 = 0 THEN NULL WHEN n % 2 = 0 THEN 'https://www.example.org/i/' || id || '.png' WHEN n % 3 <> 0 THEN 'https://www.example.org/i/' || id || '.png' END AS image_url, n % 7 = 0 AND n % 2 = 0 AS failed FROM ev""")
def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an event's own page adds, on the two platforms whose pages are read; a page that can't be read is told."""
    c, n = F.col, F.col("n")
    src = F.concat(F.lit("/i/"), c("id"), F.lit(".png"))
    list_ = F.concat(F.lit('<div class="icrt-calendarContentDetail"><img id="event_image" src="'), src, F.lit('"><div id="tx_more"><p>'), c("description"), F.lit('</p><span id="tx_dots">...</span><button>See more</button></div></div>'))
    price = F.coalesce(F.concat(F.lit('<div class="field--name-field-cost"><div class="field__item">'), c("cost_text"), F.lit("</div></div>")), F.lit(""))
    article = F.concat(F.lit('<article class="teaser">no</article><article class="node node--view-mode-full"><div class="field--name-body">'), c("description"), F.lit("</div>"), price, F.lit('<img src="'), F.when(n % 3 == 0, "/icon.png").otherwise(src), F.lit('"></article>'))
    html = F.when(n % 7 == 0, F.when(n % 2 == 1, "<p>Moved</p>")).otherwise(F.when(n % 2 == 0, list_).otherwise(article))
    pages = served(spark, sf_dir).select("id", F.when(n % 2 == 0, "govstack").otherwise("drupal-events").alias("platform"), F.when(n % 2 == 0, "www.example.org").otherwise("https://www.example.org").alias("origin"), html.alias("html"))
    return page_details(pages).select("id", "description", "cost_text", "image_url", F.col("error").isNotNull().alias("failed"))
