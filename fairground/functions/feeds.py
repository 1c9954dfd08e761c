"""Calendar feeds: RFC 5545 text of events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import by_value
from . import times

by_value(__name__)
WIDEST = 75


def escape_text(text: Column) -> Column:
    """Backslashes, semicolons, commas and line ends escaped."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(F.replace(out, F.lit(";"), F.lit("\\;")), F.lit(","), F.lit("\\,"))
    return F.regexp_replace(out, "\r?\n", "\\\\n")


def _fold(line: str) -> str:
    parts, held, room = [], bytearray(), WIDEST
    for c in line:
        raw = c.encode("utf-8")
        if len(held) + len(raw) > room:
            parts.append(held.decode("utf-8"))
            held, room = bytearray(), WIDEST - 1
        held += raw
    return "\r\n ".join([*parts, held.decode("utf-8")])


@F.pandas_udf(T.StringType())
def fold_line(line: pd.Series) -> pd.Series:
    """A line cut to WIDEST octets between characters; what follows begins with a space."""
    return line.map(_fold, na_action="ignore")


def ics_utc(instant: Column) -> Column:
    return F.date_format(instant, "yyyyMMdd'T'HHmmss'Z'")


def ics_date(local: Column, plus: int = 0) -> Column:
    return F.date_format(F.date_add(F.to_date(local), plus), "yyyyMMdd")


def summary(status: Column, title: Column) -> Column:
    return F.concat(F.when(status == "cancelled", "CANCELLED: ").otherwise(""), title)


def event_lines(events: DataFrame, domain: str, origin: str, stamp: str, folded: bool = True) -> DataFrame:
    """id and vevent: each event as calendar text. An end that is not stated is two hours on; an event without
    a time is a day, and its end the day behind the last. Places that an earlier part names are not repeated."""
    c = F.col
    untimed = c("all_day") | (c("time_precision") == "date-only")
    last = times.last_date(c("local_date"), c("ends_at"), c("timezone"))
    notes = F.concat_ws(
        "\n",
        F.when(c("cost") == "free", "Free.").when(c("cost_text").isNotNull(), F.concat(F.lit("Cost: "), c("cost_text"))),
        c("description"),
        F.when(c("organizer").isNotNull(), F.concat(F.lit("Organizer: "), c("organizer"))),
        F.when(c("status") == "rescheduled", "This event has been rescheduled."),
        F.when(c("time_precision") == "date-only", "Start time not published by the source — check the listing."),
        F.when(c("url") != "", F.concat(F.lit("Source: "), c("url"))),
    )
    said = lambda part, whole: F.coalesce(F.contains(F.lower(whole), F.lower(part)), F.lit(False))
    venue, address, town = c("venue_name"), c("address"), c("municipality_name")
    place = F.concat_ws(", ", venue, F.when(~said(address, venue), address), F.when(~said(town, venue) & ~said(town, address), town))
    lines = F.array(
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), c("id"), F.lit(f"@{domain}")),
        F.lit(f"DTSTAMP:{stamp}"),
        F.when(untimed, F.concat(F.lit("DTSTART;VALUE=DATE:"), ics_date(c("local_date")))).otherwise(F.concat(F.lit("DTSTART:"), ics_utc(c("starts_at")))),
        F.when(untimed, F.concat(F.lit("DTEND;VALUE=DATE:"), ics_date(last, 1))).otherwise(F.concat(F.lit("DTEND:"), ics_utc(F.coalesce("ends_at", c("starts_at") + F.expr("INTERVAL 2 HOURS"))))),
        F.concat(F.lit("SUMMARY:"), escape_text(summary(c("status"), c("title")))),
        F.concat(F.lit("STATUS:"), F.when(c("status") == "cancelled", "CANCELLED").otherwise("CONFIRMED")),
        F.lit("TRANSP:TRANSPARENT"),
        F.when(place != "", F.concat(F.lit("LOCATION:"), escape_text(place))),
        F.when(notes != "", F.concat(F.lit("DESCRIPTION:"), escape_text(notes))),
        F.concat(F.lit(f"URL:{origin}/event/"), c("id")),
        F.lit("END:VEVENT"),
    )
    lines = F.filter(lines, lambda x: x.isNotNull())
    rows = events.withColumn("_lines", lines)
    if not folded:
        return rows.select("id", F.array_join("_lines", "\n").alias("vevent"))
    each = rows.select("id", F.posexplode("_lines").alias("_n", "_line")).withColumn("_line", fold_line("_line"))
    return each.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"]), "\r\n").alias("vevent"))


def calendar_head(name: str, hours: int = 6) -> list[str]:
    return ["BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//fairground//community events//EN", "CALSCALE:GREGORIAN", "METHOD:PUBLISH", f"X-WR-CALNAME:{name}", "X-WR-TIMEZONE:America/Toronto", f"REFRESH-INTERVAL;VALUE=DURATION:PT{hours}H", f"X-PUBLISHED-TTL:PT{hours}H"]


def calendar_rows(events: DataFrame, group: str, name: Column, domain: str, origin: str, stamp: str) -> DataFrame:
    """The lines of a calendar for each value of `group`: group, part (0 head, 1 events, 2 end), starts_at, id, text.

    Rows in that order are the file. No group is gathered in one place: whoever writes it sorts by these columns."""
    heads = events.select(group, name.alias("_name")).groupBy(group).agg(F.min("_name").alias("_name"))
    line = F.concat_ws("\r\n", *[F.replace(F.lit(x), F.lit("{name}"), escape_text(F.col("_name"))) for x in calendar_head("{name}")])
    nothing = [F.lit(None).cast("timestamp").alias("starts_at"), F.lit(None).cast("string").alias("id")]
    ends = heads.select(group, F.lit(0).alias("part"), *nothing, line.alias("text")).union(heads.select(group, F.lit(2), *nothing, F.lit("END:VCALENDAR")))
    return ends.union(events.select(group, "id", "starts_at").join(event_lines(events, domain, origin, stamp), "id").select(group, F.lit(1), "starts_at", "id", "vevent"))


def event_text(events: DataFrame, origin: str) -> Column:
    """Three lines that a message says of an event: title, when and where, and its address."""
    untimed = F.col("all_day") | (F.col("time_precision") == "date-only")
    when = F.concat_ws(" · ", times.format_date(F.col("local_date")), F.when(~untimed, times.format_time(F.col("local_time"))), F.col("municipality_name"))
    return F.concat(F.lit("- "), F.col("title"), F.when(F.col("status") == "cancelled", " (CANCELLED)").otherwise(""), F.lit("\n  "), when, F.lit(f"\n  {origin}/e/"), F.col("short_code"))


def digest_messages(shown: DataFrame, cadence: str, start: str, end: str, site: str, origin: str) -> DataFrame:
    """user_id, subject and text of each reader's digest.

    shown: user_id, section, heading, nth, text (event_text), more (an address, or null) and unsubscribe: what
    digest_sections() chose, so a reader's rows are few. Sections and events stand in their order."""
    day = lambda d: times.format_date(F.lit(d))
    subject = F.concat(F.lit(f"Today on {site}: "), day(start)) if cadence == "daily" else F.concat(F.lit(f"This week on {site}: "), day(start), F.lit(" to "), day(end))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), "\n\n")
    parts = shown.groupBy("user_id", "unsubscribe", "section", "heading").agg(texts.alias("_events"), F.max("more").alias("_more"))
    part = F.concat(F.upper("heading"), F.lit("\n\n"), F.col("_events"), F.coalesce(F.concat(F.lit("\n\n  See all: "), F.col("_more")), F.lit("")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", part.alias("part")))), lambda x: x["part"]), "\n\n\n")
    opening = "Here is what is on for you today." if cadence == "daily" else "Here is what is on for you this week."
    closing = F.concat(F.lit(f"\n\n--\nYou are getting this because you turned on a {cadence} digest at {site}.\nChange it, or turn it off: {origin}/account#digest\nUnsubscribe with one click: "), F.col("unsubscribe"), F.lit("\n"))
    return parts.groupBy("user_id", "unsubscribe").agg(body.alias("_body")).select("user_id", subject.alias("subject"), F.concat(F.lit(f"{opening}\n\n"), F.col("_body"), closing).alias("text"))
