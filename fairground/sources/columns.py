"""Payloads in JSON, XML and iCalendar to raw events, as columns: Spark's own parsers read them, no Python runs.

JSON is read as VARIANT, so that a field of another type than usual (a venue that is an empty list, a picture that is
false) is null and never fails. `entries(payload)` gives an array of rows for a payload, or one row that holds only its error:
a payload that is no such document, or has an event without a field that it must have, adds nothing else. Null and
empty texts are null; rows stay in the payload's order."""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import BEHIND_WORD, let, matches, squeeze, swap
from ..functions.text import fragment_lines, slugify, split_location, truncate
from ..functions.times import naive, parse_clock, wall_clock
from ..registry import ZONE
from ..schemas import RAW

Window = tuple[str, str]
#: Fields of a row that a parser gives, with their types; the source and the place come with the payload.
TYPES = {k: t for k, t in (f.split() for f in RAW.replace("\n", " ").split(", ")) if k not in ("source_slug", "position")} | {"placed": "boolean", "error": "string"}
ROW = f"struct<{','.join(f'{k}:{t}' for k, t in TYPES.items())}>"
WHITE = " \t\n\r\f\v "


def said(e: Column, path: str) -> Column:
    """A field as text, whatever its type; null when it is absent, null or on no such path."""
    return F.try_variant_get(e, f"$.{path}", "string")


def number(e: Column, path: str) -> Column:
    return F.try_variant_get(e, f"$.{path}", "decimal(20,2)")


def many(e: Column, path: str) -> Column:
    """The elements of a list; none when the field is no list."""
    return F.coalesce(F.try_variant_get(e, f"$.{path}", "array<variant>"), none())


def none() -> Column:
    return F.array().cast("array<variant>")


def true(e: Column, path: str) -> Column:
    return ~F.coalesce(said(e, path), F.lit("")).isin("", "false", "0", "[]", "{}")


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE))


def some(text: Column) -> Column:
    """No empty text. The text is bound: nullif() alone would read it twice, and again in each call around it."""
    return let(text, lambda t: F.when(t != "", t))


def words(e: Column, path: str) -> Column:
    return some(strip(said(e, path)))


def long_text(markup: Column) -> Column:
    return some(let(fragment_lines(markup), lambda t: truncate(t)))


def one_line(markup: Column) -> Column:
    return squeeze(fragment_lines(markup))


def joined(*parts: Column) -> Column:
    return some(F.concat_ws(", ", *[let(p, lambda t: F.when(strip(t) != "", t)) for p in parts]))


def texts(elements: Column, field: str) -> Column:
    """The field's texts of all elements that have one."""
    return F.filter(F.transform(elements, lambda x: words(x, field)), lambda t: t.isNotNull())


def clock_at(date: Column, time: Column) -> Column:
    return F.concat(date, F.lit("T"), F.substring(time, 1, 5))


def day_before(wall: Column) -> Column:
    return F.date_add(F.to_date(F.substring(wall, 1, 10)), -1).cast("string")


def inside(wall: Column, window: Window) -> Column:
    return F.substring(wall, 1, 10).between(*window)


def option(options: Column, name: str, default: str = "") -> Column:
    return F.coalesce(options[name], F.lit(default))


def row(external_id: Column, title: Column, start: Column, timed: Column | None = None, **more: Column) -> Column:
    """A row; without a time of day it is all day and its start is midnight."""
    timed = F.lit(True) if timed is None else F.coalesce(timed, F.lit(False))
    given = {
        "external_id": external_id, "title": title, "local_start": F.when(timed, start).otherwise(F.concat(F.substring(start, 1, 10), F.lit("T00:00"))),
        "all_day": ~timed, "time_precision": F.when(timed, "exact").otherwise("date-only"), "categories": F.array(), "placed": F.lit(False),
    } | {k: some(v) if TYPES[k] == "string" else v for k, v in more.items()}
    return F.struct(*[given.get(k, F.lit(None)).cast(t).alias(k) for k, t in TYPES.items()]).cast(ROW)


def failure(message: Column) -> Column:
    return F.array(F.struct(*[(message if k == "error" else F.lit(None)).cast(t).alias(k) for k, t in TYPES.items()]).cast(ROW))


def firsts(items: Column, key: Callable[[Column], Column]) -> Column:
    """The first item of each key, in order: neighbours of the sorted keys are compared, so no item meets all others."""

    def of(held: Column) -> Column:
        ranked = F.array_sort(F.transform(held, lambda e, i: F.struct(key(e).alias("k"), i.alias("i"))))
        new = lambda s: F.filter(s, lambda x, n: (n == 0) | ~F.get(s, n - 1)["k"].eqNullSafe(x["k"]))
        return F.transform(F.array_sort(F.transform(let(ranked, new), lambda x: x["i"])), lambda i: F.get(held, i))

    return let(items, of)


@dataclass(frozen=True)
class Listed:
    """A platform whose payload holds a list of events."""

    items: Callable[[Column], Column]
    needs: tuple[str, ...]
    kept: Callable[[Column, Window], Column]
    row: Callable[[Column, Column, Window], Column]
    read: Callable[[Column], Column] = F.try_parse_json
    wrong: Callable[[Column], Column] = lambda v: F.lit(None).cast("string")
    refused: Callable[[Column], Column] = lambda e: F.lit(False)

    def rows(self, payload: Column, options: Column, window: Window) -> Column:
        def of(kept: Column) -> Column:
            lacks = lambda e: F.exists(F.array(*[said(e, n) for n in self.needs]), lambda x: x.isNull())
            return (
                F.when(kept.isNull(), failure(F.lit("no list of events")))
                .when(F.exists(kept, self.refused), failure(F.lit("an event recurs")))
                .when(F.exists(kept, lacks), failure(F.lit(f"an event lacks one of {', '.join(self.needs)}")))
                .otherwise(F.transform(kept, lambda e: self.row(e, options, window)))
            )

        def whole(v: Column) -> Column:
            kept = let(F.filter(self.items(v), lambda e: self.kept(e, window)), of)
            return F.when(v.isNull(), failure(F.lit("the payload can't be read"))).when(self.wrong(v).isNotNull(), failure(self.wrong(v))).otherwise(kept)

        return let(self.read(payload), whole)


def at_path(path: str) -> Callable[[Column], Column]:
    return lambda v: F.try_variant_get(v, path, "array<variant>")


def _tribe(e: Column, options: Column, window: Window) -> Column:
    """An event of the calendar plugin's REST pages."""

    def of(address: Column, whole: Column) -> Column:
        return row(
            said(e, "id"), F.coalesce(some(one_line(said(e, "title"))), F.lit("Untitled event")), said(e, "start_date"), local_end=said(e, "end_date"),
            description=F.when(true(e, "description"), long_text(said(e, "description"))).otherwise(one_line(said(e, "excerpt"))), venue_name=one_line(said(e, "venue.venue")), address=address,
            municipality_hint=said(e, "venue.city"), cost_text=words(e, "cost"), categories=texts(F.concat(many(e, "categories"), many(e, "tags")), "name"), organizer=one_line(said(e, "organizer[0].organizer")),
            image_url=said(e, "image.url"), url=said(e, "url"), placed=address.isNotNull() & (option(options, "municipality") == ""), all_day=whole, time_precision=F.when(whole, "date-only").otherwise("exact"),
        )

    given = F.struct(joined(said(e, "venue.address"), said(e, "venue.city"), said(e, "venue.zip")).alias("address"), true(e, "all_day").alias("whole"))
    return let(given, lambda g: of(g["address"], g["whole"]))


def _cityspark(e: Column, options: Column, window: Window) -> Column:
    """An event of a portal; times are local however they end, and a portal reaches far, so rows must be placed."""
    dollars = lambda n: F.concat(F.lit("$"), F.regexp_replace(n.cast("string"), r"\.?0+$", ""))
    timed, low, high = true(e, "HasTime") & ~true(e, "AllDay"), number(e, "Price"), number(e, "PriceHigh")
    spread = F.when((high != 0) & (high != low), F.concat(dollars(low), F.lit("–"), dollars(high))).otherwise(dollars(low))
    return row(
        said(e, "PId"), strip(said(e, "Name")), F.substring(said(e, "DateStart"), 1, 16), timed, local_end=F.when(timed, F.substring(said(e, "DateEnd"), 1, 16)), description=long_text(said(e, "Description")),
        venue_name=words(e, "Venue"), address=joined(said(e, "Address"), said(e, "CityState"), said(e, "Zip")), municipality_hint=strip(swap(said(e, "CityState"), r",\s*ON$", "")),
        cost_text=F.coalesce(words(e, "PriceText"), F.when(true(e, "Free"), "Free").otherwise(spread)), is_free=F.when(true(e, "Free"), True), image_url=F.coalesce(some(said(e, "LargeImg")), said(e, "MediumImg")),
        url=F.concat(F.regexp_replace(option(options, "origin"), "/+$", ""), F.lit("/#/details/"), slugify(said(e, "Name")), F.lit("/"), said(e, "PId")), placed=F.lit(True),
    )


def _eventbrite(e: Column, options: Column, window: Window) -> Column:
    """A search result; all must be placed."""
    start, last, until = said(e, "start_date"), some(said(e, "end_date")), some(said(e, "end_time"))
    timed = some(said(e, "start_time")).isNotNull() & ~true(e, "hide_start_date")
    money = lambda k: F.concat(F.lit("$"), F.regexp_replace(words(e, f"ticket_availability.{k}.major_value"), r"\.00$", ""))
    low, high, free = money("minimum_ticket_price"), money("maximum_ticket_price"), F.try_variant_get(e, "$.ticket_availability.is_free", "boolean")
    tags = F.filter(many(e, "tags"), lambda t: said(t, "prefix").isin("EventbriteCategory", "EventbriteSubCategory"))
    return row(
        said(e, "id"), F.concat(F.when(true(e, "is_cancelled"), "CANCELLED: ").otherwise(""), strip(said(e, "name"))), clock_at(start, F.coalesce(some(said(e, "start_time")), F.lit("00:00"))), timed,
        local_end=F.when(timed, clock_at(last, until)).when(last != start, F.concat(last, F.lit("T23:59"))), description=long_text(said(e, "summary")), venue_name=words(e, "primary_venue.name"),
        address=words(e, "primary_venue.address.localized_address_display"), municipality_hint=words(e, "primary_venue.address.city"),
        cost_text=F.when(free, "Free").when(low.isNotNull() & high.isNotNull() & (low != high), F.concat(low, F.lit("–"), high)).otherwise(low), is_free=free, categories=texts(tags, "display_name"),
        image_url=F.coalesce(some(said(e, "image.image_sizes.large")), said(e, "image.url")), url=said(e, "url"), placed=F.lit(True),
    )


def _ticketmaster(e: Column, options: Column, window: Window) -> Column:
    """An event of a venue; always paid. The smallest wide picture that is large enough, else the widest."""
    start, venue = "dates.start", "_embedded.venues[0]"
    dollars = lambda n: F.concat(F.lit("$"), F.regexp_replace(n.cast("string"), r"\.00$", ""))
    timed = some(said(e, f"{start}.localTime")).isNotNull() & ~true(e, f"{start}.timeTBA") & ~true(e, f"{start}.noSpecificTime")
    state = F.coalesce(F.get(F.array(F.lit("CANCELLED: "), F.lit("RESCHEDULED: ")), F.array_position(F.array(F.lit("cancelled"), F.lit("rescheduled")), said(e, "dates.status.code")) - 1), F.lit(""))
    price = F.get(F.filter(many(e, "priceRanges"), lambda p: number(p, "min") > 0), F.lit(0))
    cost = let(price, lambda p: F.when((number(p, "max") != 0) & (number(p, "max") != number(p, "min")), F.concat(dollars(number(p, "min")), F.lit("–"), dollars(number(p, "max")))).otherwise(dollars(number(p, "min"))))
    wide = lambda i: F.coalesce(number(i, "width"), F.lit(0))
    fits = lambda i: F.coalesce((said(i, "ratio") == "16_9") & (wide(i) >= 1024), F.lit(False))
    ranked = F.array_sort(F.transform(many(e, "images"), lambda i, n: F.struct((~fits(i)).alias("misfit"), F.when(fits(i), wide(i)).otherwise(-wide(i)).alias("width"), n.alias("n"), said(i, "url").alias("url"))))
    named = F.flatten(F.transform(many(e, "classifications"), lambda c: F.array(*[words(c, f"{k}.name") for k in ("segment", "genre", "subGenre")])))
    return row(
        said(e, "id"), F.concat(state, strip(said(e, "name"))), clock_at(said(e, f"{start}.localDate"), F.coalesce(some(said(e, f"{start}.localTime")), F.lit("00:00"))), timed, description=long_text(F.coalesce(some(said(e, "info")), said(e, "pleaseNote"))),
        venue_name=words(e, f"{venue}.name"), address=joined(said(e, f"{venue}.address.line1"), words(e, f"{venue}.city.name"), said(e, f"{venue}.postalCode")), municipality_hint=words(e, f"{venue}.city.name"),
        cost_text=cost, is_free=F.lit(False), categories=F.filter(named, lambda n: n.isNotNull() & (n != "Undefined")), image_url=F.get(ranked, F.lit(0))["url"], url=said(e, "url"), placed=F.lit(True),
    )


def _communico(e: Column, options: Column, window: Window) -> Column:
    """An event of a library; free only if nothing is billed."""
    host, fee, outside = option(options, "origin"), some(said(e, "registration_cost")), words(e, "venue_name")
    free = F.coalesce((fee == "0") & (said(e, "enable_billing") == "0"), F.lit(False))
    named = lambda field: F.transform(many(e, field), lambda x: some(strip(F.try_variant_get(x, "$", "string"))))
    return row(
        said(e, "id"), F.concat_ws(" — ", words(e, "title"), words(e, "sub_title")), said(e, "event_start"), local_end=said(e, "event_end"), description=long_text(F.coalesce(some(said(e, "long_description")), said(e, "description"))),
        venue_name=F.coalesce(outside, words(e, "location")), municipality_hint=outside, cost_text=F.when(free, "Free").otherwise(F.concat(F.lit("$"), fee)), is_free=F.when(free, True),
        categories=F.filter(F.concat(named("tagsArray"), named("agesArray")), lambda t: t.isNotNull()),
        image_url=F.concat(F.lit("https://"), host, F.lit("/images/events/"), F.substring_index(host, ".", 1), F.lit("/"), some(said(e, "image"))), url=F.coalesce(words(e, "url"), F.concat(F.lit("https://"), host, F.lit("/event/"), said(e, "id"))),
    )


def _sitefinity(e: Column, options: Column, window: Window) -> Column:
    """An OData row; the clock is that of the offset fields, a midnight start is no time."""

    def of(start: Column, last: Column, whole: Column, city: Column, place: Column) -> Column:
        end = F.when(whole & last.endswith("T00:00"), F.concat(day_before(last), F.lit("T23:59"))).otherwise(last)
        venue, address = split_location(place)
        return row(
            said(e, "Id"), strip(said(e, "Title")), start, ~whole & ~start.endswith("T00:00"), local_end=F.when(end > start, end), description=long_text(F.coalesce(some(said(e, "Content")), some(said(e, "Summary")), said(e, "Description"))),
            venue_name=venue, address=address, municipality_hint=city, cost_text=words(e, "Admission"), organizer=words(e, "ContactName"), image_url=let(said(e, "ImagePath"), lambda path: F.when(path.startswith("https://"), path)),
            url=F.concat(option(options, "origin"), option(options, "detail"), F.coalesce(said(e, "ItemDefaultUrl"), F.lit(""))),
        )

    given = F.struct(F.substring(said(e, "EventStartWithOffset"), 1, 16).alias("start"), some(F.substring(said(e, "EventEndWithOffset"), 1, 16)).alias("last"), true(e, "AllDayEvent").alias("whole"), words(e, "City").alias("city"))
    return let(given, lambda g: let(joined(words(e, "Location"), words(e, "Street"), g["city"]), lambda place: of(g["start"], g["last"], g["whole"], g["city"], place)))


def _cfmws(e: Column, options: Column, window: Window) -> Column:
    """An entry of a base's list; a day without a readable time is all day."""

    def moment(field: str) -> Column:
        text = words(e, field)
        time = let(F.regexp_replace(F.substring(text, 11, 100), r"([0-9]:[0-9]{2}):[0-9]{2}", "$1"), parse_clock)
        return F.struct(F.substring(text, 1, 10).alias("day"), time.alias("time"))

    def of(start: Column, end: Column) -> Column:
        place, kind = option(options, "place"), some(said(e, "event_demo"))
        path, name = F.coalesce(words(e, "event_externalurl"), words(e, "event_cta_link")), said(e, "event_name")
        wall = lambda t: F.concat(t["day"], F.lit("T"), F.coalesce(t["time"], F.lit("00:00")))
        return row(
            F.concat(F.coalesce(path, name), F.lit("@"), start["day"]), strip(name), wall(start), start["time"].isNotNull(), local_end=F.when(wall(end) > wall(start), wall(end)), venue_name=F.coalesce(words(e, "event_location"), place), municipality_hint=place,
            categories=F.when(kind != "All", F.array(kind)).otherwise(F.array().cast("array<string>")), url=F.when(path.startswith("http"), path).otherwise(F.concat(option(options, "origin"), F.coalesce(path, F.lit("")))),
        )

    return let(F.struct(moment("event_startdate").alias("start"), moment("event_enddate").alias("end")), lambda t: of(t["start"], t["end"]))


def _loaded(page: Column) -> Column:
    """The list behind `var loadedData`: the JSON reader stops where the list ends, whatever follows."""
    at = F.locate("var loadedData", page)
    list_ = F.from_json(F.substring(page, F.position(F.lit("["), page, at), F.length(page)), "array<variant>")
    return F.when(at > 0, list_)


# Fields of a chamber's list.
CHAMBER = ["EventID", "Name", "Slug", "Status", "StartDate", "EndDate", "IsAllDayEvent", "Description", "LocationDesc", "MapAddr1", "MapCity", "AdmissionDesc", "ContactDesc"]


def growthzone(payload: Column, options: Column, window: Window) -> Column:
    """A chamber's XML list: approved events; fees of vendors and "free for members" are no admission."""
    # What is charged to others than visitors, and what is free to members only.
    others = rf"\b(float|vendor|booth|table|exhibitor|sponsor|entrant)s?\b.{{0,20}}\b(entr|fee|rate|cost|price)|entry fee|\bfree{BEHIND_WORD}[^.]{{0,30}}\b(members?|membership)\b"
    read = F.from_xml(F.regexp_replace(payload, r'\s\w+:nil="true"', ""), f"EventDisplay array<struct<{','.join(f'{c}:string' for c in CHAMBER)}>>, broken string", {"columnNameOfCorruptRecord": "broken", "ignoreSurroundingSpaces": "true"})

    def of(record: Column) -> Column:
        raw = lambda tag: F.coalesce(strip(record[tag]), F.lit(""))
        field = lambda tag: some(one_line(raw(tag)))
        start, end, price = F.substring(raw("StartDate"), 1, 16), F.substring(raw("EndDate"), 1, 16), field("AdmissionDesc")
        return row(
            raw("EventID"), field("Name"), start, raw("IsAllDayEvent") != "true", local_end=F.when(end > start, end), description=let(field("Description"), lambda t: truncate(t)), address=F.when(field("MapAddr1").isNotNull(), joined(field("MapAddr1"), field("MapCity"))).otherwise(field("LocationDesc")),
            municipality_hint=field("MapCity"), cost_text=F.when(~matches(price, others) & ~matches(price, r"^n/?a$"), price), organizer=field("ContactDesc"),
            url=F.concat(option(options, "origin"), F.lit("/events/details/"), raw("Slug"), F.lit("-"), raw("EventID")),
        )

    def rows(list_: Column) -> Column:
        full = lambda r: F.forall(F.array(*[strip(r[k]) for k in ("EventID", "Name", "StartDate", "Slug")]), lambda x: F.coalesce(x != "", F.lit(False)))
        kept = F.filter(F.coalesce(list_["EventDisplay"], F.array().cast(f"array<struct<{','.join(f'{c}:string' for c in CHAMBER)}>>")), lambda r: (strip(r["Status"]) == "APPROVED") & full(r) & inside(strip(r["StartDate"]), window))
        return F.when(list_.isNull() | list_["broken"].isNotNull(), failure(F.lit("the payload can't be read"))).otherwise(F.transform(kept, of))

    return F.when(~F.coalesce(payload.contains("<ArrayOfEventDisplay"), F.lit(False)), failure(F.lit("not an event list"))).otherwise(let(read, rows))


def _entries(feed: Column, options: Column, window: Window) -> Column:
    """Rows of an iCalendar feed: lines are unfolded, entries cut at their marks; of a property's lines the last counts."""
    unfolded = F.regexp_replace(F.regexp_replace(feed, "\r\n?", "\n"), "\n[ \t]", "")
    parts = F.split(F.concat(F.lit("\n"), unfolded), "\nBEGIN:VEVENT\n")
    closed = F.filter(F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda b: F.concat(F.lit("\n"), b, F.lit("\n"))), lambda b: b.contains("\nEND:VEVENT\n"))
    made = F.transform(closed, lambda b: let(F.substring_index(b, "\nEND:VEVENT\n", 1), lambda block: _entry(block, options)))
    return F.filter(made, lambda r: r["external_id"].isNotNull() & inside(r["local_start"], window))


def _entry(block: Column, options: Column) -> Column:
    """One entry; its id is null if it has none or no readable start. An all-day end is the day after. Escaped
    backslashes stay doubled."""
    line = lambda name, group: F.try_element_at(F.regexp_extract_all(block, F.lit(rf"(?dim)^{name}((?:;[^:\n]*)?):(.*)$"), F.lit(group)), F.lit(-1))
    literal = lambda name: strip(F.regexp_replace(F.regexp_replace(line(name, 2), r"\\[nN]", "\n"), r"\\([;,])", "$1"))
    zone = option(options, "timezone", ZONE)

    def moment(name: str) -> Column:
        """A day or a wall clock; null when it is neither. The line is looked for once."""
        days = "^([0-9]{4})([0-9]{2})([0-9]{2})"

        def read(value: Column, about: Column) -> Column:
            local = F.regexp_replace(value, days + "T([0-9]{2})([0-9]{2})[0-9]{2}Z?$", "$1-$2-$3T$4:$5")
            timed = value.rlike(days + "T[0-9]{6}Z?$") & ~F.coalesce(about, F.lit("")).rlike('(?i);VALUE="?DATE"?(;|$)')
            return F.when(value.rlike(days + "$"), F.regexp_replace(value, days + "$", "$1-$2-$3")).when(timed & value.endswith("Z"), wall_clock(naive(local), zone)).when(timed, local)

        return let(F.struct(strip(line(name, 2)).alias("value"), line(name, 1).alias("about")), lambda x: read(x["value"], x["about"]))

    def of(start: Column, end: Column, where: Column) -> Column:
        whole = F.length(start) == 10
        venue, address = split_location(where)
        pictures = F.filter(F.array(*[literal(k) for k in ("X-TKF-FEATURED-IMAGE", "X-IMAGE", "X-GOOGLE-CALENDAR-IMAGE")]), lambda p: p.startswith("https://"))
        return row(
            F.when(start.isNotNull(), strip(line("UID", 2))), F.coalesce(literal("SUMMARY"), F.lit("Untitled event")), start, ~whole, local_end=F.when(whole, F.concat(day_before(end), F.lit("T23:59"))).otherwise(end),
            description=let(literal("DESCRIPTION"), lambda t: truncate(t)), venue_name=venue, address=address, municipality_hint=where,
            categories=F.filter(F.transform(F.split(F.coalesce(literal("CATEGORIES"), F.lit("")), ","), strip), lambda c: c != ""), image_url=F.get(pictures, F.lit(0)), url=literal("URL"),
        )

    return let(F.struct(moment("DTSTART").alias("start"), moment("DTEND").alias("end"), literal("LOCATION").alias("where")), lambda t: of(t["start"], t["end"], t["where"]))


def _feeds(feeds: Column, options: Column, window: Window) -> Column:
    """Rows of all feeds, an event of several once; a feed that is missing or none fails the payload."""
    bad = F.exists(feeds, lambda f: ~F.coalesce(f.contains("BEGIN:VCALENDAR"), F.lit(False)))
    rows = F.flatten(F.transform(feeds, lambda f: _entries(f, options, window)))
    return F.when(feeds.isNull() | bad, failure(F.lit("not an iCalendar feed"))).otherwise(rows)


def ics(payload: Column, options: Column, window: Window) -> Column:
    """A calendar feed; entries of one id are all rows (the batch decides which counts)."""
    return _feeds(F.array(payload), options, window)


def libcal(payload: Column, options: Column, window: Window) -> Column:
    """Feeds of several calendars of a library: a JSON object of feeds by calendar id, or one feed alone. Only the
    calendars that the options list count, in their order; an event of several is kept once."""
    asked = F.filter(F.transform(F.split(option(options, "calendars"), ","), strip), lambda c: c != "")
    chosen = lambda held: F.when(F.size(asked) > 0, F.transform(asked, lambda c: held[c])).otherwise(F.map_values(held))
    feeds = F.when(F.ltrim(payload).startswith("{"), let(F.from_json(payload, "map<string,string>"), chosen)).otherwise(F.array(payload))
    return let(feeds, lambda f: firsts(_feeds(f, options, window), lambda r: r["external_id"]))


_every = lambda e, window: F.lit(True)
LISTS = {
    "tribe": Listed(at_path("$.events"), ("id", "title", "start_date", "url"), lambda e, w: ~true(e, "hide_from_listings") & (F.coalesce(said(e, "status"), F.lit("publish")) == "publish"), _tribe),
    "cityspark": Listed(
        lambda v: firsts(F.coalesce(at_path("$.Value")(v), none()), lambda e: said(e, "PId")), ("PId", "Name"), lambda e, w: some(said(e, "DateStart")).isNotNull(), _cityspark,
        wrong=lambda v: F.when(~true(v, "Success"), F.coalesce(some(said(v, "ErrorMessage")), F.lit("request failed"))),
    ),
    "eventbrite": Listed(at_path("$.events.results"), ("id", "name", "url"), lambda e, w: ~true(e, "is_online_event") & F.coalesce(some(said(e, "start_date")) <= w[1], F.lit(False)), _eventbrite),
    "ticketmaster": Listed(
        lambda v: F.coalesce(at_path("$._embedded.events")(v), none()), ("id", "name", "url"),
        lambda e, w: ~true(e, "test") & ~true(e, "dates.start.dateTBA") & ~true(e, "dates.start.dateTBD") & some(said(e, "dates.start.localDate")).isNotNull(), _ticketmaster,
    ),
    "communico": Listed(
        at_path("$"), ("id", "title", "event_start"),
        lambda e, w: ~F.coalesce(said(e, "private_event") == "1", F.lit(False)) & (F.coalesce(some(said(e, "event_type")), F.lit("INPERSON")) == "INPERSON") & (F.lower(F.coalesce(words(e, "location"), F.lit(""))) != "online"), _communico,
    ),
    "sitefinity": Listed(at_path("$.value"), ("Id", "Title", "EventStartWithOffset"), _every, _sitefinity, refused=lambda e: true(e, "IsRecurrent") | true(e, "RecurrenceExpression")),
    "cfmws": Listed(
        lambda v: F.filter(v, lambda e: ~true(e, "event_virtual")), ("event_name", "event_startdate"), lambda e, w: (F.coalesce(some(said(e, "event_recurrence")), F.lit("None")) != "None") | words(e, "event_startdate").isNull() | inside(words(e, "event_startdate"), w), _cfmws,
        read=_loaded, refused=lambda e: F.coalesce(some(said(e, "event_recurrence")), F.lit("None")) != "None",
    ),
}
PLATFORMS: dict[str, Callable[[Column, Column, Window], Column]] = {k: v.rows for k, v in LISTS.items()} | {"growthzone": growthzone, "ics": ics, "libcal": libcal}


def parse(payloads: DataFrame, window: Window, platforms: Collection[str] = tuple(PLATFORMS)) -> DataFrame:
    """Rows, and errors, of the payloads of some of PLATFORMS, in one pass; other payloads give nothing."""
    by_platform = F.lit(None).cast(f"array<{ROW}>")
    for name in platforms:
        by_platform = F.when(F.col("platform") == name, PLATFORMS[name](F.col("payload"), F.col("options"), window)).otherwise(by_platform)
    found = payloads.where(F.col("platform").isin(*platforms)).select("source_slug", "platform", F.col("part").cast("long").alias("part"), F.posexplode(by_platform).alias("_at", "_row"))
    fields = [F.expr("shiftleft(part, 32) + _at").alias("position") if f == "position" else F.col("source_slug") if f == "source_slug" else F.col(f"_row.{f}") for f in (x.split()[0] for x in RAW.replace("\n", " ").split(", "))]
    return found.select(*fields, "platform", "_row.placed", "_row.error")
