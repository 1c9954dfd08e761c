"""What a reader asks for: filters from an address, their conditions, and pages of events."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, fold_python
from ..registry import MUNICIPALITIES
from ..schemas import CATEGORIES

UNPLACED = "unspecified"
# The longest search and its most terms, and the most events of a page.
LONGEST_SEARCH, MOST_TERMS, MOST_EVENTS = 80, 5, 10_000
DATE = re.compile(r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])")


def clean_search(text: str | None) -> str:
    return re.sub(r"\s+", " ", text or "").strip()[:LONGEST_SEARCH].strip()


def search_terms(text: str | None) -> list[str]:
    """Words and quoted phrases of a search, folded, each once, the first MOST_TERMS."""
    found = [(quoted or word).replace('"', "").strip() for quoted, word in re.findall(r'"([^"]+)"|(\S+)', fold_python(clean_search(text)))]
    return list(dict.fromkeys(t for t in found if t))[:MOST_TERMS]


@dataclass
class Filters:
    municipalities: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    cost: str = "default"
    sources: list[str] = field(default_factory=list)
    statuses: list[str] = field(default_factory=list)
    civic: bool = False
    first: str | None = None
    last: str | None = None
    search: str | None = None
    since: str | None = None
    before: str | None = None

    @classmethod
    def parse(cls, query: str) -> Filters:
        """Read a query string; what is unknown or malformed is left out."""
        given = dict(reversed(parse_qsl(query.lstrip("?"))))
        many = lambda k: [v.strip() for v in given.get(k, "").split(",") if v.strip()]
        day = lambda k: given[k] if DATE.fullmatch(given.get(k, "")) else None
        cost = given.get("cost")
        return cls(many("m"), many("cat"), cost if cost in ("free", "paid", "all") else "default", many("src"), many("status"), given.get("civic") == "1" or "civic-meeting" in many("cat"), given.get("from") or None, given.get("to") or None, clean_search(given.get("q")) or None, day("since"), day("before"))

    def saved(self) -> str:
        """The query string under which this is kept: known values only, sorted."""
        places = {m[0] for m in MUNICIPALITIES} | {UNPLACED}
        m, cat = sorted({p for p in self.municipalities if p in places}), sorted({c for c in self.categories if c in CATEGORIES})
        out = [("m", ",".join(m)), ("cat", ",".join(cat)), ("cost", "" if self.cost == "default" else self.cost), ("civic", "1" if self.civic and "civic-meeting" not in cat else "")]
        out += [(k, v) for k, v in (("from", self.first), ("to", self.last)) if v and DATE.fullmatch(v)] + [("q", self.search or "")]
        return urlencode([(k, v) for k, v in out if v])

    def conditions(self) -> list[Column]:
        """Conditions on events, each of which the scan can push down or skip by, but the search."""
        c, out = F.col, [F.col("active")]
        if self.municipalities:
            places = [p for p in self.municipalities if p != UNPLACED]
            chosen = c("municipality_slug").isin(places) if places else F.lit(False)
            out.append(chosen | c("municipality_slug").isNull() if UNPLACED in self.municipalities else chosen)
        out += [c(n).isin(v) for n, v in (("category", self.categories), ("status", self.statuses)) if v]
        if not self.civic:
            out.append(c("category") != "civic-meeting")
        if self.cost != "all":
            out.append(c("cost") == self.cost if self.cost != "default" else c("cost") != "paid")
        if self.sources:
            out.append(F.arrays_overlap("source_slugs", F.array(*[F.lit(s) for s in self.sources])))
        out += [running_from(d) for d in (self.first, self.since) if d]
        if self.last:
            out.append(c("local_date") <= self.last)
        if self.before:
            out.append((c("local_date") < self.before) & (c("ends_at").isNull() | (c("ends_at") < F.to_timestamp(F.lit(self.before)))))
        return out


def running_from(day: str) -> Column:
    """Begins on a day or later, or still runs then (its end is midnight UTC or later)."""
    return (F.col("local_date") >= day) | F.coalesce(F.col("ends_at") >= F.to_timestamp(F.lit(day)), F.lit(False))


def search_text() -> Column:
    """What a search looks into; keep it as a column of the events table to fold each event once."""
    return fold(F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "description", "venue_name", "address", "organizer", "municipality_name")]))


def select(events: DataFrame, filters: Filters) -> DataFrame:
    out = events
    for condition in filters.conditions():
        out = out.where(condition)
    for term in search_terms(filters.search):
        out = out.where(F.contains(search_text(), F.lit(term)))
    return out


def page(events: DataFrame, filters: Filters, limit: int = MOST_EVENTS) -> DataFrame:
    """The first `limit` matches by start, and truncated: whether there are more. One more row is read to know."""
    limit = max(1, int(limit))
    rows = select(events, filters).orderBy("starts_at", "id").limit(limit + 1)
    at = F.row_number().over(Window.orderBy("starts_at", "id"))
    ranked = rows.withColumn("_at", at)
    return ranked.withColumn("truncated", F.max("_at").over(Window.partitionBy(F.lit(1))) > limit).where(F.col("_at") <= limit).drop("_at")


def with_places(events: DataFrame, municipalities: DataFrame) -> DataFrame:
    return events.join(F.broadcast(municipalities.select(F.col("slug").alias("municipality_slug"), F.col("name").alias("municipality_name"))), "municipality_slug", "left")
