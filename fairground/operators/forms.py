"""What people send in: suggestions and events entered by hand, checked row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import MUNICIPALITIES
from ..schemas import CATEGORIES, COSTS, STATUSES
from .feedback import greedy_limit

# The most characters of a field, and the field that only a robot fills.
LIMITS = {"name": 100, "email": 254, "title": 200, "url": 2000, "description": 5000, "comments": 5000}
HONEYPOT, AUTO = "company", "auto"
DATE, TIME = r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$", r"^([01][0-9]|2[0-3]):[0-5][0-9]$"
EMAIL = r"""^[^\s@<>()",;:]+@[^\s@<>()",;:]+\.[^\s@<>()",;:]{2,}$"""


def field(name: str, most: int = 5000) -> Column:
    """A posted text: line ends as newlines, trimmed, capped; nothing left is null."""
    value = F.trim(F.regexp_replace(F.col(name), "\r\n?", "\n"))
    return F.when(value != "", F.substring(value, 1, most))


def address(name: str, https: bool = False) -> Column:
    """A page address with a scheme and a dotted host, else null; without a scheme it is https."""
    given = field(name, LIMITS["url"])
    full = F.when(given.rlike("(?i)^[a-z][a-z0-9+.-]*:"), given).otherwise(F.concat(F.lit("https://"), given))
    return F.when(full.rlike(rf"(?i)^{'https' if https else 'https?'}://[^\s/?#]*[^\s/?#.]\.[^\s/?#.]") & ~full.rlike(r"\s"), full)


def suggestions(forms: DataFrame) -> DataFrame:
    """forms with verdict (spam, bad email, bad url, empty or ok) and the cleaned fields of those that are ok.

    Columns: id, kind, company, name, email, title, url, date, time, description, comments."""
    event = F.coalesce(F.col("kind"), F.lit("event")) != "website"
    only = lambda c: F.when(event, c)
    kept = {n: field(n, LIMITS[n]) for n in ("name", "email", "title", "comments")}
    kept |= {"url": address("url"), "description": only(field("description")), "date": only(F.when(field("date", 10).rlike(DATE), field("date", 10))), "time": only(F.when(field("time", 5).rlike(TIME), field("time", 5)))}
    nothing = F.coalesce(kept["title"], field("url"), kept["description"], kept["comments"]).isNull()
    verdict = F.when(field(HONEYPOT).isNotNull(), "spam").when(kept["email"].isNotNull() & ~kept["email"].rlike(EMAIL), "bad email").when(field("url").isNotNull() & kept["url"].isNull(), "bad url").when(nothing, "empty").otherwise("ok")
    return forms.select("id", verdict.alias("verdict"), F.when(event, "event").otherwise("website").alias("kind"), *[F.when(verdict == "ok", c).alias(n) for n, c in kept.items()])


def event_errors(forms: DataFrame) -> DataFrame:
    """id and errors: the fields of a posted event that are wrong, sorted; an empty list means it can be saved."""
    bad = lambda name, pattern: field(name).isNotNull() & ~field(name).rlike(pattern)
    listed = lambda name, allowed, default: ~F.coalesce(field(name), F.lit(default)).isin([*allowed])
    date, end, start_time, end_time = field("date"), field("end_date"), field("start_time"), field("end_time")
    wrong_date, wrong_start = date.isNull() | bad("date", DATE), bad("start_time", TIME)
    wrong_time = bad("end_time", TIME) | end_time.isNotNull() & start_time.isNull()
    wrong_end = bad("end_date", DATE) | F.coalesce(end < date, F.lit(False))
    backwards = ~wrong_date & ~wrong_start & ~wrong_time & ~wrong_end & F.coalesce(F.concat_ws("T", F.coalesce(end, date), end_time) <= F.concat_ws("T", date, start_time), F.lit(False)) & start_time.isNotNull() & end_time.isNotNull()
    checks = {
        "title": field("title").isNull(), "municipality": field("municipality").isNotNull() & ~field("municipality").isin([m[0] for m in MUNICIPALITIES]), "category": listed("category", [*CATEGORIES, AUTO], AUTO), "date": wrong_date, "start_time": wrong_start,
        "end_time": wrong_time | backwards, "end_date": wrong_end, "url": field("url").isNotNull() & address("url").isNull(), "image_url": field("image_url").isNotNull() & address("image_url", https=True).isNull(), "cost": listed("cost", COSTS, "unknown"), "status": listed("status", STATUSES, "scheduled"),
    }
    return forms.select("id", F.array_sort(F.filter(F.array(*[F.when(c, n) for n, c in checks.items()]), lambda n: n.isNotNull())).alias("errors"))


def accept_suggestions(checked: DataFrame, came: DataFrame, most: int = 5, seconds: int = 3600, stored: DataFrame | None = None) -> DataFrame:
    """Checked suggestions that are stored: ok, and fewer than `most` of their sender's were stored in the span before.

    came: id, sender, received_at; stored: sender, received_at of those of earlier batches. A suggestion that is
    refused does not count against the next one."""
    ok = checked.where("verdict = 'ok'").join(came, "id")
    return greedy_limit(ok, "sender", "received_at", "id", most, seconds, stored).where("accepted").select(*checked.columns)
