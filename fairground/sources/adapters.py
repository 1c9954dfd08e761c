"""Payloads of each platform to raw events; those of JSON, XML and iCalendar are read in `columns`.

A parser of pages takes a payload (or a page and the pages it leads to), the source's options and the window of
days, and gives dicts of raw event fields. `placed` asks that the row be dropped unless it can be placed.
Fetching is not done here: payloads come as a table."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Collection, Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.places import resolve_municipality
from ..operators.views import runaway_series
from ..registry import GOVSTACK_EXCLUDED, ZONE
from ..schemas import RAW
from ..shipping import by_value
from ..storage import materialize
from . import columns
from .clocks import at_zone, clock, day, month, shift, wall, year_of
from .markup import Node, plain, shorten, tree

by_value(__name__)
Window = tuple[str, str]
Rows = Iterator[dict]


def slug(text: str) -> str:
    plain_ = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", "-", plain_.lower()).strip("-")[:60]


def event(external_id, title, start, **more) -> dict:
    """A row; without a time of day it is all day and its start is midnight."""
    timed = more.pop("timed", True)
    return {"external_id": str(external_id), "title": title, "local_start": start if timed else f"{start[:10]}T00:00", "all_day": not timed, "time_precision": "exact" if timed else "date-only", "categories": [], "placed": False, **{k: (v if v not in ("", []) else None) for k, v in more.items() if k != "categories"}, **({"categories": more["categories"]} if "categories" in more else {})}


def inside(start: str, window: Window) -> bool:
    return window[0] <= start[:10] <= window[1]


def long_text(html: str | None) -> str | None:
    return shorten(plain(html)) or None


def govstack(payload: str, options: dict, window: Window) -> Rows:
    """List pages: day, month, link, category, "time | address", description. Rows of excluded categories go."""
    page = tree(payload)
    items = page.all("div", "icrt-calendarListItem")
    found = re.search(r"\((\d+)\s+Results?\s+Found\)", payload, re.IGNORECASE)
    if found and int(found[1]) and not items:
        raise ValueError(f"{found[1]} results announced but none in the list")
    host, excluded = options.get("origin", ""), {c.lower() for c in GOVSTACK_EXCLUDED}
    for item in items:
        link, number, name, about = item.one("a", "meta-title"), item.one("span", "date"), item.one("span", "month"), item.one("p")
        if not (link and number and name and about and month(name.text()) and number.text().isdigit()):
            continue
        siblings = link.up.kids[link.up.kids.index(link) + 1 :]
        before = siblings[: siblings.index(about)] if about in siblings else siblings
        category = " ".join("".join(k if isinstance(k, str) else k.text() for k in before).split())
        if category.lower() in excluded:
            continue
        when, _, address = about.text().partition("|")
        m = month(name.text())
        date, time = day(year_of(m, window), m, int(number.text())), clock(when)
        path = re.sub(r"(?i)^/default/Detail/", "", link.attrs.get("href", "").strip()).rstrip("/")
        body = item.one("div", "icrt-calendarListItemDesc")
        yield event(
            path or f"{date}-{(time or '00:00').replace(':', '')}-{slug(link.text())}", link.text(), f"{date}T{time or '00:00'}", timed=bool(time),
            description=shorten(body.lines()) if body else None, address=None if re.fullmatch(r"(?i)\s*(various|tba|tbd|n/a)?\s*", address) else address.strip(),
            categories=[category] if category else [], url=f"https://{host}/default/Detail/{path}" if path else f"https://{host}/default/Month?StartDate={date[5:7]}/01/{date[:4]}",
        )


def full_calendar(payload: str, options: dict, window: Window) -> Rows:
    """Events of the calendar settings in a page: JSON whose options are JSON again. An all-day end is the day after."""
    script = tree(payload).one("script", **{"data-drupal-selector": "drupal-settings-json"})
    view = (json.loads(script.raw()).get("fullCalendarView") or [None])[0] if script else None
    if view is None:
        raise ValueError("no calendar settings on the page")
    held = view.get("calendar_options")
    held = json.loads(held) if isinstance(held, str) else held or {}
    at = lambda v: at_zone(v, options.get("timezone", ZONE)) if isinstance(v, (int, float)) else wall(v)
    for e in held.get("events") or []:
        if not e.get("start") or not e.get("url") or not inside(start := at(e["start"]), window):
            continue
        whole = e.get("allDay") is True or (isinstance(e["start"], str) and len(e["start"]) == 10)
        end = at(e["end"]) if e.get("end") else None
        if end and whole:
            last = shift(end[:10], -1)
            end = f"{last}T23:59" if last > start[:10] else None
        path = plain(e["url"])
        title = tree(e["title"])
        for time in title.all("span", "fc-time"):
            time.kids.clear()
        yield event((e.get("eid") or "").strip() or f"{path}@{start}", title.text(), start, timed=not whole, local_end=end, url=urljoin(options.get("origin", ""), path)) | {"local_start": start}


def drupal_rows(payload: str, options: dict, window: Window) -> Rows:
    """Rows of a listing view with <time datetime>; offsets are dropped, not applied."""
    for row in tree(payload).all("div", "views-row"):
        field = next((n for n in row.walk() if any(c.startswith("views-field-title") for c in n.attrs.get("class", "").split())), row)
        link, times = field.one("a", href=None), [t.attrs["datetime"] for t in row.all("time", datetime=None)]
        if not link or not times or not inside(start := wall(times[0]), window):
            continue
        whole, end = len(times[0]) == 10, wall(times[1]) if len(times) > 1 else None
        if whole and end:
            end = f"{end[:10]}T23:59"
            end = end if end[:10] > start[:10] else None
        path = link.attrs["href"]
        yield event(f"{path}@{start}", link.text(), start, timed=not whole, local_end=end if end and end > start else None, url=urljoin(options.get("origin", ""), path))


def drupal(payload: str, options: dict, window: Window) -> Rows:
    return (drupal_rows if options.get("mode") == "rows" else full_calendar)(payload, options, window)


def eventon(payload: str, options: dict, window: Window) -> Rows:
    """{post, page, types}: a listed post, its page (JSON-LD, else data-time spans), and names of its types."""
    given = json.loads(payload)
    post, page, zone = given["post"], tree(given.get("page") or ""), options.get("timezone", ZONE)
    padded = lambda v: (m := re.search(r"(\d{4})-(\d{1,2})-(\d{1,2})T(\d{1,2}):(\d{2})", v or "")) and f"{m[1]}-{int(m[2]):02d}-{int(m[3]):02d}T{int(m[4]):02d}:{m[5]}"
    times: dict[str, str | None] = {}
    about = picture = None
    for script in page.all("script", type="application/ld+json"):
        body = script.raw()
        if '"Event"' not in body:
            continue
        try:
            told = json.loads(body)
        except ValueError:
            told = {k: (re.search(rf'"{k}":\s*"([^"]+)"', body) or [None, None])[1] for k in ("startDate", "endDate")}
        if start := padded(told.get("startDate")):
            end = padded(told.get("endDate"))
            times.setdefault(start, end if end and end > start else None)
        about, picture = about or long_text(told.get("description")), picture or told.get("image")
    if not times:
        for node in page.walk():
            if m := re.fullmatch(r"(\d+)-(\d+)", node.attrs.get("data-time", "")):
                a, b = int(m[1]), int(m[2])
                times.setdefault(at_zone(a, zone), at_zone(b, zone) if b > a else None)
    if not about and (block := page.one("div", "eventon_desc_in")):
        about = shorten(block.lines()) or None
    attr = lambda name: next((n.attrs[f"data-{name}"].strip() for n in page.walk() if n.attrs.get(f"data-{name}", "").strip()), None)
    names = {int(k): v for k, v in (given.get("types") or {}).items()}
    for start, end in times.items():
        if inside(start, window):
            whole = start.endswith("T00:00") and (end or "").endswith("T23:59")
            yield event(
                f"{post['id']}@{start}" if len(times) > 1 else post["id"], tree(post["title"]["rendered"]).text(), start, timed=not whole, local_end=None if whole else end, description=about,
                venue_name=attr("location_name"), address=attr("location_address"), categories=[names[i] for i in post.get("event_type") or [] if names.get(i)], image_url=picture, url=post["link"],
            )


def spaces(payload: str, options: dict, window: Window) -> Rows:
    """{cards, details}: a page of cards, and pages by card number. A card's last copy wins; years come from the window."""
    given = json.loads(payload)
    cards = {c.attrs["data-id"]: c for c in tree(given["cards"]).all("div", "card-body", **{"data-id": None})}

    def part(text: str) -> tuple[str | None, str | None]:
        m = re.fullmatch(r"(?i)(?:([a-z]{3,4})\s+(\d{1,2}))?\s*(\d{1,2}:\d{2}\s*[ap]m)?", text.strip())
        number = month(m[1]) if m and m[1] else None
        return (day(year_of(number, window), number, int(m[2])) if number else None), (clock(m[3]) if m and m[3] else None)

    for key, card in cards.items():
        link, title = card.one("a", "event-details"), next((n for n in card.all("span") if {"short-post", "med-short-post"} & set(n.attrs.get("class", "").split())), None)
        button = card.one("button")
        after = button.up.kids[button.up.kids.index(button) + 1 :] if button else []
        when = next((n.text() for n in after if isinstance(n, Node)), "")
        left, _, right = re.sub(r"\s+[-–]\s+", "\0", when).partition("\0")
        date, time = part(left)
        if not (link and title and date):
            continue
        last, until = part(right) if right else (None, None)
        last = last or (date if until else None)
        kind = next((a.text() for a in card.all("a", href=None) if re.fullmatch(r"/[a-z-]+", a.attrs["href"])), "")
        image = card.one("img", src=None)
        more = spaces_detail((given.get("details") or {}).get(key) or "")
        yield event(f"{key}@{date}", title.text(), f"{date}T{time or '00:00'}", timed=bool(time), local_end=f"{last}T{until}" if last and until and last >= date else None, categories=[kind] if kind else [], image_url=re.sub(r";w=\d+;h=\d+;mode=crop;?$", "", image.attrs["src"]) if image else None, url=urljoin(f"https://{options.get('origin', '')}", link.attrs["href"]), **more)


def spaces_detail(html: str) -> dict:
    """The organiser's text and the lines in it that name place, address and price."""
    post = tree(html).one("div", id="post")
    if post is None:
        return {}
    text = post.lines()
    said = lambda labels: (m := re.search(rf"(?im)^\s*(?:{labels})\s*[:\-–]\s*(.+)$", text)) and m[1].strip()
    who = post.one("span", "title")
    return {"description": shorten(text), "venue_name": said("location|where|venue|place"), "address": said("address"), "cost_text": said("cost|price|admission|tickets?|fee|entry"), "organizer": who.text() if who else None}


def tixhub(payload: str, options: dict, window: Window) -> Rows:
    """{index, runs}: a box office table, and the page of each run by its event; a run is a row for each performance."""
    given, tenant = json.loads(payload), options.get("origin", "")
    shows = 0
    for tr in tree(given["index"]).all("tr"):
        link = next((a for a in tr.all("a", href=None) if "cboPerformances=" in a.attrs["href"]), None)
        ids = re.search(r"cboPerformances=(\d+)&cboEvent=(\d+)(.*)", link.attrs["href"]) if link else None
        if not ids:
            continue
        shows += 1
        cells = [td.text() for td in tr.all("td")] + [""] * 4
        dates = []
        if "bmultiple=1" in ids[3] or "multiple dates" in cells[0].lower():
            for o in tree((given.get("runs") or {}).get(ids[2]) or "").all("option", value=None):
                m = re.search(r"(?i)([a-z]+)\s+(\d{1,2}),\s*(\d{4})\s*-\s*(\d{1,2}:\d{2}\s*[ap]m)", o.text())
                if m and month(m[1]) and clock(m[4]):
                    dates.append((o.attrs["value"], day(int(m[3]), month(m[1]), int(m[2])), clock(m[4])))
        elif m := re.search(r"(\d{1,2})/(\d{1,2})/(\d{4})", cells[0]):
            t = re.search(r"(?i)\d{1,2}:\d{2}\s*[ap]m", cells[1])
            dates.append((ids[1], day(int(m[3]), int(m[1]), int(m[2])), clock(t[0]) if t else None))
        for key, date, time in dates:
            if inside(date, window):
                yield event(key, link.text(), f"{date}T{time or '00:00'}", timed=bool(time), venue_name=cells[3], municipality_hint=cells[3], is_free=False, url=f"https://secure1.tixhub.com/{tenant.lower()}/online/b_otix.asp?cboPerformances={key}&cboEvent={ids[2]}")
    if not shows:
        raise ValueError("no shows in the listing")


def film_nights(payload: str, options: dict, window: Window) -> Rows:
    """Prose: a film, its date and screenings in parentheses, and a synopsis, each in an element of its own."""
    parts = [" ".join(k.split()) for n in tree(payload).walk() if n.tag not in ("script", "style") for k in n.kids if isinstance(k, str) and k.strip()]
    ordered: list[str] = []

    def read(node: Node) -> None:
        for k in node.kids:
            if isinstance(k, str):
                ordered.extend([" ".join(k.split())] if k.strip() else [])
            elif k.tag not in ("script", "style"):
                read(k)

    read(tree(payload))
    found = 0
    for i, text in enumerate(ordered if parts else []):
        m = re.fullmatch(r"(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day,\s*([A-Za-z]+)\s+(\d{1,2}),\s*(\d{4})\s*\(([^)]*)\)", text)
        times = [c for t in m[4].split(",") if (c := clock(t.strip()))] if m and i and month(m[1]) else []
        found += bool(times)
        date = day(int(m[3]), month(m[1]), int(m[2])) if times else ""
        for time in times if inside(date, window) else []:
            film, open_ = ordered[i - 1], ordered[i - 1].lower() == "tba"
            yield event(f"{date}-{time.replace(':', '')}-{'tba' if open_ else slug(film)}", "MAT Film Night (film to be announced)" if open_ else f"MAT Film Night: {film}", f"{date}T{time}", description=None if open_ or i + 1 >= len(ordered) else ordered[i + 1], venue_name=options.get("venue"), address=options.get("address"), cost_text=options.get("admission"), categories=["Film"], organizer="Mariposa Arts Theatre", url=options.get("origin"))
    if not found:
        raise ValueError("no films on the page")


def govstack_detail(html: str, host: str) -> dict:
    """Description up to the toggle, and the poster, of an event's own page."""
    box = tree(html).one("div", "icrt-calendarContentDetail")
    body = box and (box.one("div", id="tx_more") or box.one("div", id="text-less"))
    image = box and box.one("img", id="event_image")
    for n in body.all("button") + body.all("span", id="tx_dots") if body else []:
        n.kids.clear()
    return {"description": body.lines() or None if body else None, "image_url": urljoin(f"https://{host}", image.attrs["src"]) if image else None}


def drupal_detail(html: str, origin: str) -> dict:
    """Body and comments, price and picture of the full article of a page."""
    node = next((n for n in tree(html).all("article") if "node--view-mode-full" in n.attrs.get("class", "")), None)
    if node is None:
        return {}

    def field(name: str) -> str | None:
        box = node.one("div", f"field--name-{name}")
        items = box.all("div", "field__item") if box else []
        return " ".join(" ".join(i.text() for i in items).split() if items else box.text().split() if box else []) or None

    image = node.one("img", src=None)
    src = image.attrs["src"] if image else None
    return {"description": "\n\n".join(t for t in (field("body"), field("field-comments")) if t) or None, "cost_text": field("field-cost"), "image_url": urljoin(origin, src) if src and not re.search("placeholder|icon|logo|spacer", src, re.IGNORECASE) else None}


#: Platforms of pages; those of JSON, XML and iCalendar are columns.
ADAPTERS: dict[str, Callable[[str, dict, Window], Rows]] = {"govstack": govstack, "drupal-events": drupal, "eventon": eventon, "spaces": spaces, "tixhub": tixhub, "mat-film-nights": film_nights}
DETAILS: dict[str, Callable[[str, str], dict]] = {"govstack": govstack_detail, "drupal-events": drupal_detail}
_FIELDS = [f.split()[0] for f in RAW.replace("\n", " ").split(", ")]


def raw_events(payloads: DataFrame, window: Window, platforms: Collection[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Raw events of payloads, and the payloads that failed with their errors.

    payloads: source_slug, platform, options (map), part (its place among the source's payloads), payload.
    Payloads are parsed once, and what was read is stored. A row's position is its place in the payload behind
    that of the payload (2^32 to each). One payload that can't be read never stops the others, nor the rest of its source. Rows that must be
    placed and can't be are dropped, and so are daily series that run away (tribe). `platforms` names those that the
    table holds, where they are known, so that the plan has no part for others; rows of others are then not read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                options = dict(r.options or {})
                try:
                    rows = list(ADAPTERS[r.platform](r.payload, options, window))
                    out += [{"source_slug": r.source_slug, "platform": r.platform, "position": (int(r.part) << 32) + i, "error": None, **row} for i, row in enumerate(rows)]
                except Exception as e:  # noqa: BLE001
                    out.append({"source_slug": r.source_slug, "platform": r.platform, "position": int(r.part) << 32, "placed": False, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=[*_FIELDS, "platform", "placed", "error"]).astype(object).where(lambda d: d.notna(), None)

    def parse(some: DataFrame) -> DataFrame:
        """Documents are read by columns, pages by Python; a table of one kind only leaves the other part empty."""
        known = [p for p in columns.PLATFORMS if platforms is None or p in platforms]
        pages = some.where(~F.coalesce(F.col("platform").isin(*known), F.lit(False))).select("source_slug", "platform", "options", "part", "payload")
        if platforms is not None and set(known) == set(platforms):
            return columns.parse(some, window, known)
        read = pages.mapInPandas(run, f"{RAW}, platform string, placed boolean, error string")
        return columns.parse(some, window, known).unionByName(read) if known else read

    def placeable(rows: DataFrame) -> DataFrame:
        place = resolve_municipality(F.col("municipality_hint"), F.col("address"), F.col("venue_name"))
        return rows.where(F.col("error").isNull() & (~F.col("placed") | place.isNotNull()))

    # Read once and stored: the rows, the failures and the daily series all come from what was read.
    stored = materialize(parse(payloads), "parsed")
    kept = placeable(stored)
    # Only one platform's series run away; the others' rows wait for no join.
    regional = F.col("platform").eqNullSafe("tribe")
    tribes = kept.where(regional).withColumn("_venue", F.coalesce("venue_name", F.lit("")))
    series = ["source_slug", "title", "_venue"]
    daily = runaway_series(tribes, series, F.substring("local_start", 1, 10))
    tribes = tribes.join(daily.select(*series), series, "left_anti")
    failed = stored.where(F.col("error").isNotNull()).select("source_slug", "platform", "error")
    return kept.where(~regional).select(*_FIELDS).union(tribes.select(*_FIELDS)), failed


def page_details(pages: DataFrame) -> DataFrame:
    """What events' own pages add: description, cost_text and image_url, or the error of a page that can't be read.

    pages: id, platform, origin, html. Platforms whose pages are not read add nothing; a null page is an error."""
    names = ("description", "cost_text", "image_url")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                found, error = {}, None
                try:
                    found = DETAILS[r.platform](r.html, r.origin or "") if r.platform in DETAILS else {}
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
                out.append((r.id, *(found.get(k) for k in names), error))
            yield pd.DataFrame(out, columns=["id", *names, "error"]).astype(object).where(lambda d: d.notna(), None)

    return pages.select(F.col("id").cast("string").alias("id"), "platform", "origin", "html").mapInPandas(run, "id string, description string, cost_text string, image_url string, error string")
