"""Wall clocks, instants, days, and where an event stands at a moment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import let

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def wall_string(text: Column) -> Column:
    """yyyy-MM-ddTHH:mm of the shapes that sources use (slashes, a space, seconds); null when it is none."""
    shaped = F.regexp_replace(F.replace(F.trim(text), F.lit("/"), F.lit("-")), "^([0-9]{4}-[0-9]{2}-[0-9]{2}) ", "$1T")
    return F.nullif(F.regexp_extract(shaped, "^([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2})(?::[0-9]{2})?$", 1), F.lit(""))


def naive(wall: Column) -> Column:
    """A wall clock as the instant that it would be in UTC, session zone UTC; days that do not exist give null."""
    return F.try_to_timestamp(wall, F.lit("yyyy-MM-dd'T'HH:mm"))


def wall_to_utc(wall: Column, zone: Column) -> Column:
    """The instant of a wall clock. In the hour that spring skips, the offset of two passes is used, as where the
    rules were written; days that do not exist give null. The clock is read once, and each pass made once."""
    offset = lambda at: F.unix_micros(F.from_utc_timestamp(at, zone)) - F.unix_micros(at)
    back = lambda n, at: F.timestamp_micros(F.unix_micros(n) - offset(at))
    return let(naive(wall), lambda n: let(back(n, n), lambda once: back(n, once)))


def iso(instant: Column) -> Column:
    return F.date_format(instant, ISO)


def wall_clock(instant: Column, zone: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(instant, zone), "yyyy-MM-dd'T'HH:mm")


def local_date(instant: Column, zone: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(instant, zone), "yyyy-MM-dd")


def parse_clock(text: Column) -> Column:
    """HH:mm of "9:30 AM", "12 pm" or "19:00"; null when it is no time of day."""
    twelve = r"(?i)^\s*([0-9]{1,2})(?::([0-9]{2}))?\s*([ap])\.?\s?m\.?\s*$"
    plain = r"^\s*([0-9]{1,2}):([0-9]{2})\s*$"
    half = F.lower(F.regexp_extract(text, twelve, 3))
    pattern = lambda n: F.when(text.rlike(twelve), F.regexp_extract(text, twelve, n)).otherwise(F.regexp_extract(text, plain, n))
    hour = F.nullif(pattern(1), F.lit("")).cast("int")
    minute = F.coalesce(F.nullif(pattern(2), F.lit("")).cast("int"), F.lit(0))
    hour = F.when((half == "p") & (hour < 12), hour + 12).when((half == "a") & (hour == 12), 0).otherwise(hour)
    return F.when((hour <= 23) & (minute <= 59), F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0")))


def month_number(name: Column) -> Column:
    # The first letters of the months.
    short = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
    return F.nullif(F.array_position(F.array(*[F.lit(m) for m in short]), F.substring(F.lower(F.trim(name)), 1, 3)), F.lit(0)).cast("int")


def last_date(local: Column, ends: Column, zone: Column) -> Column:
    """The last day that an event touches, in its own zone."""
    return F.greatest(local, F.coalesce(local_date(ends, zone), local))


def days_spanned(local: Column, last: Column, most: int = 14) -> Column:
    """Every day from the first to the last, `most` at most."""
    start = F.to_date(local)
    return F.transform(F.sequence(start, F.least(F.to_date(last), F.date_add(start, most - 1))), lambda d: d.cast("string"))


def stand(now: Column, starts: Column, ends: Column, local: Column, local_time: Column, untimed: Column, zone: Column) -> dict[str, Column]:
    """finished, spans_days, runs_today, on_now and list_date of an event at an instant."""
    today = local_date(now, zone)
    clock = F.date_format(F.from_utc_timestamp(now, zone), "HH:mm")
    last = last_date(local, ends, zone)
    finished = F.when(~untimed & ends.isNotNull(), ends <= now).otherwise(last < today)
    spans = F.coalesce(ends.isNotNull() & (F.unix_micros(ends) - F.unix_micros(starts) >= 86_400_000_000), F.lit(False))
    runs = F.when(untimed, local <= today).otherwise(starts <= now) & ~finished
    until = F.date_format(F.from_utc_timestamp(ends, zone), "HH:mm")
    believable = F.coalesce((local_time < until) & (local_time != "00:00"), F.lit(False))
    inside = F.when(believable, (clock >= local_time) & (clock < until)).otherwise(True)
    return {"finished": finished, "spans_days": spans, "runs_today": runs, "on_now": runs & (~spans | untimed | inside), "list_date": F.when((local < today) & runs, today).otherwise(local)}


def preset(today: Column, name: str) -> tuple[Column, Column]:
    """The first and last day of weekend, week, month or thirty from a day."""
    sunday = F.when(F.dayofweek(today) == 1, today).otherwise(F.next_day(today, "Sunday"))
    return {
        "weekend": (F.greatest(today, F.date_sub(sunday, 2)), sunday),
        "week": (today, F.date_add(today, 6)),
        "thirty": (today, F.date_add(today, 29)),
        "month": (today, F.last_day(today)),
    }[name]


def relative_day(day: Column, today: Column) -> Column:
    away = F.datediff(day, today)
    return F.when(away == 0, "Today").when(away == 1, "Tomorrow").when(away == -1, "Yesterday").when((away > 1) & (away < 7), F.date_format(day, "EEEE")).otherwise(F.date_format(day, "EEE, MMM d"))


def month_grid(month: Column) -> Column:
    """All days of the whole weeks, from Sunday, that hold a month."""
    first, last = F.trunc(month, "month"), F.last_day(month)
    return F.sequence(F.date_sub(first, F.dayofweek(first) - 1), F.date_add(last, 7 - F.dayofweek(last)))


def format_date(local: Column) -> Column:
    return F.date_format(F.to_date(local), "EEEE, MMMM d, yyyy")


def format_time(clock: Column) -> Column:
    """19:30 as 7:30 p.m."""
    hour = F.substring(clock, 1, 2).cast("int")
    return F.concat((F.pmod(hour + 11, F.lit(12)) + 1).cast("string"), F.substring(clock, 3, 3), F.when(hour < 12, " a.m.").otherwise(" p.m."))


def compact_time(clock: Column) -> Column:
    """19:30 as 7:30pm, whole hours without minutes."""
    hour, minute = F.substring(clock, 1, 2).cast("int"), F.substring(clock, 4, 2)
    return F.concat((F.pmod(hour + 11, F.lit(12)) + 1).cast("string"), F.when(minute == "00", "").otherwise(F.concat(F.lit(":"), minute)), F.when(hour < 12, "am").otherwise("pm"))


# Days that a run keeps in sync before and after its own, and days back that a list's posts may be from.
LOOK_BACK, LOOK_AHEAD, PUBLISHED_WITHIN = 14, 180, 400


def default_window(today: Column) -> tuple[Column, Column]:
    """The first and last day of a run."""
    return F.date_sub(today, LOOK_BACK), F.date_add(today, LOOK_AHEAD)


def published_after(first: Column) -> Column:
    """The day from which posts are asked for, given a window's first day."""
    return F.date_sub(first, PUBLISHED_WITHIN)


def site_clock(now: Column, zone: Column) -> dict[str, Column]:
    """Local date, hour and weekday (Sunday is 0)."""
    local = F.from_utc_timestamp(now, zone)
    return {"date": F.date_format(local, "yyyy-MM-dd"), "hour": F.hour(local), "weekday": F.dayofweek(local) - 1}
