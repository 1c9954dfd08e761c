"""DuckDB SQL for the rules, written apart from the Spark expressions: one common table after another."""

from __future__ import annotations

import re

from ..functions import rules as R
from ..functions import titles as T
from ..functions.places import PLACE_WORDS, SHORT, STOPWORDS, STREETS
from ..registry import GAZETTEER, NAMES, PRIORITY
from .standins import EVENTS_SQL, HOMES, RAW_SQL


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(text: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({text}, {q(pattern)}, 'i'), FALSE)"


def sub(text: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({text}, {q(pattern)}, {q(to)}, 'gi')"


def squeeze(text: str) -> str:
    return f"trim({sub(text, chr(92) + 's+', ' ')})"


def clean(text: str) -> str:
    return f"nullif({squeeze(text)}, '')"


def name_pattern(name: str) -> str:
    return re.escape(name).replace(r"\-", "[- ]").replace(r"\ ", "[- ]")


def municipality(*texts: str) -> str:
    """Matches of a name less those that a street word follows: RE2 has no lookahead."""
    text = "concat_ws(' | ', " + ", ".join(f"nullif({t}, '')" for t in texts) + ")"
    ordered = [x for x in NAMES if x[1] != "simcoe-county"] + [x for x in NAMES if x[1] == "simcoe-county"]
    parts = []
    for name, slug in ordered:
        body = name_pattern(name)
        all_of, streets = f"(?i)(^|[^A-Za-z]){body}([^A-Za-z]|$)", rf"(?i)(^|[^A-Za-z]){body} +({STREETS})\b"
        parts.append(f"WHEN regexp_matches(h, {q(all_of)}) AND len(regexp_extract_all(h, {q(all_of)})) > len(regexp_extract_all(h, {q(streets)})) THEN {q(slug)}")
    return f"(SELECT CASE {' '.join(parts)} END FROM (SELECT {text} AS h))"


def rule_chain(text: str) -> str:
    out = []
    for name, rule in R.CATEGORIES:
        seen = text
        if "(?! fitness)" in rule:
            rule, seen = rule.replace("(?! fitness)", ""), sub(seen, r"\bdance fitness", "fitness")
        if "(?! lighting)" in rule:
            rule, seen = rule.replace("(?! lighting)", ""), sub(seen, r"\btrees? lighting", "lighting")
        out.append(f"WHEN {has(seen, rule)} THEN {q(name)}")
    return f"CASE {' '.join(out)} END"


PLACE = r"\b(" + "|".join(name_pattern(n) for n, _ in NAMES) + r")\b"


def without_places(text: str) -> str:
    return squeeze(sub(text, PLACE, " "))


def clean_title(raw: str) -> str:
    t = sub(f"trim({raw})", T.DATE_FIRST)
    t = sub(sub(t, T.DATE_LAST_BARE), T.DATE_LAST, r" \1")
    t = squeeze(sub(t, T.MARKER, " "))
    t = f"trim({sub(sub(t, r'^[\s\-–—:,]+|[\s\-–—:,]+$'), r'\(\s*\)')})"
    return f"CASE WHEN {t} <> '' THEN {t} ELSE trim({raw}) END"


def status(text: str) -> str:
    return f"CASE WHEN {has(text, T.CANCELLED)} THEN 'cancelled' WHEN {has(text, T.MOVED)} THEN 'rescheduled' END"


def is_meeting(title: str, label: str) -> str:
    return f"({has(title, T.MEETING_NAMES)} OR ({has(title, T.BODIES)} AND ({has(title, T.SITTINGS)} OR {has(label, T.MEETING_LABELS)})))"


def category(title: str, label: str) -> str:
    label = without_places(f"trim({label})")
    none, audience = f"({has(label, R.GENERIC)} OR {has(label, R.DEPARTMENT)})", has(label, R.AUDIENCE)
    return f"""CASE WHEN {is_meeting(title, label)} THEN 'civic-meeting' ELSE coalesce(
      CASE WHEN NOT {none} AND NOT {audience} THEN {rule_chain(label)} END, {rule_chain(without_places(title))},
      CASE WHEN NOT {none} AND {audience} THEN {rule_chain(label)} END, 'other') END"""


def _near(width: int, before: bool) -> str:
    return "|".join(f"{re.escape(s)}(?s:.){{0,{width - len(s)}}}" if before else f"(?s:.){{0,{width - len(s)}}}{re.escape(s)}" for s in R.PRICE_STEMS)


def cost(free: str, cost_text: str, title: str, description: str) -> str:
    """A struct expression of cost and confidence, over columns that the caller names."""
    friends = lambda t: sub(t, R.FALSE_FRIENDS, " ")
    given, name = friends(f"trim(coalesce({cost_text}, ''))"), friends(f"coalesce({title}, '')")
    text = friends(f"coalesce({title}, '') || chr(10) || coalesce({description}, '')")
    paid = lambda t: has(sub(t, rf"\b(no|not)\s{R.PAID_WORDS[2:]}"), R.PAID_WORDS)
    price = f"({has(text, f'({_near(R.BEFORE, True)})({R.MONEY})')} OR {has(text, f'({R.MONEY})({_near(R.BEHIND, False)})')})"
    words = "|".join(map(re.escape, R.PRICE_STEMS))
    return f"""CASE WHEN coalesce({free}, FALSE) THEN 'free/high'
      WHEN {given} <> '' AND ({has(given, R.ZERO)} OR {has(given, R.FREE_ADMISSION)} OR {has(given, R.FREE_WORD)}) THEN 'free/high'
      WHEN {given} <> '' AND ({has(given, R.MONEY)} OR {paid(given)} OR {has(given, words)}) THEN 'paid/high'
      WHEN {free} = FALSE THEN 'paid/high'
      WHEN {has(text, R.FREE_ADMISSION)} THEN 'free/high' WHEN {price} THEN 'paid/high' WHEN {paid(text)} THEN 'paid/high'
      WHEN {has(name, R.FREE_WORD)} THEN 'free/high' WHEN {has(text, R.FREE_WORD)} THEN 'free/low' ELSE 'unknown/low' END"""


RAW = "raw AS (" + RAW_SQL.format(orders="orders") + ")"
EVENTS = "ev AS (" + EVENTS_SQL.format(orders="orders") + ")"
HOME = "homes(slug, kind, home, priority) AS (VALUES " + ", ".join(f"({q(s)}, {q(k)}, {q(m) if m else 'NULL'}, {PRIORITY[k]})" for s, k, m in HOMES) + ")"
UNTIMED = "(all_day OR time_precision = 'date-only')"
NOT_EVENT = "|".join(f"(?:{p})" for p in R.NOT_EVENTS)
JUDGED = f"""walls AS (
  SELECT *, replace(raw_start, ' ', 'T') AS wall,
         CASE WHEN length(raw_end) = 10 THEN raw_end || 'T23:59' ELSE substr(raw_end, 1, 16) END AS end_wall,
         NOT ({has("trim(title)", NOT_EVENT)} OR {has("trim(label)", NOT_EVENT)} OR ({UNTIMED} AND {has("trim(title)", "|".join(R.OBSERVANCES))})) AS public
  FROM raw),
judged AS (
  SELECT *, CASE WHEN NOT public THEN 'not a public event'
                 WHEN row_number() OVER (PARTITION BY source_slug, external_id, public ORDER BY position) > 1 THEN 'duplicate external id in batch' END AS reason
  FROM walls)"""
INSTANT = "CAST({} AS TIMESTAMP) AT TIME ZONE 'America/Toronto' AT TIME ZONE 'UTC'"
LISTINGS = f"""cleaned AS (
  SELECT j.*, h.kind AS source_kind, h.home, h.priority, source_slug || ':' || external_id AS id,
         coalesce({clean(clean_title("title"))}, 'Untitled event') AS name, {clean("description")} AS about,
         {INSTANT.format("wall")} AS starts, {INSTANT.format("end_wall")} AS ends
  FROM judged j JOIN homes h ON h.slug = source_slug WHERE reason IS NULL),
listings AS (
  SELECT id, source_slug, source_kind, external_id, priority, raw_title,
         coalesce({municipality("municipality_hint", "address", "venue_name")}, home, {municipality("raw_title")}, {municipality("about")}) AS municipality_slug,
         name AS title, about AS description, {category("name", "label")} AS category, starts,
         CASE WHEN ends >= starts THEN ends END AS ends, substr(wall, 1, 10) AS local_date, substr(wall, 12, 5) AS local_time, time_precision, all_day,
         {clean("venue_name")} AS venue_name, {clean("address")} AS address, split_part({cost("is_free", "cost_text", "name", "about")}, '/', 1) AS cost,
         {clean("cost_text")} AS cost_text, {clean("organizer")} AS organizer, {clean("image_url")} AS image_url, url,
         coalesce({status("raw_title")}, 'scheduled') AS status
  FROM (SELECT *, title AS raw_title FROM cleaned))"""
BASE = f"WITH {RAW}, {HOME}, {JUDGED}, {LISTINGS}"

PLACES_IN_ORDER = [n.lower() for n in dict.fromkeys(n for names in GAZETTEER.values() for n in names)]
DULL = "[" + ", ".join(q(w) for w in [*STOPWORDS, *PLACE_WORDS]) + "]"


def title_tokens(title: str) -> str:
    t = f"' ' || trim(regexp_replace(regexp_replace(translate(lower({title}), '’''`', ''), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) || ' '"
    for n in PLACES_IN_ORDER:
        if " " in n:
            t = f"replace({t}, ' {n} ', ' ')"
    return f"list_filter(regexp_split_to_array(trim({t}), '\\s+'), lambda w: w <> '' AND NOT list_contains({DULL}, w) AND NOT regexp_matches(w, '^[0-9]+(st|nd|rd|th)$|^(19|20)[0-9][0-9]$'))"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({text}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')"


SHORTS = "MAP {" + ", ".join(f"{q(a)}: {q(b)}" for a, b in SHORT.items()) + "}"
FEATURES = f"""told AS (
  SELECT *, {title_tokens("title")} AS tokens, list_transform({words("coalesce(address, '')")}, lambda w: coalesce({SHORTS}[w], w)) AS aw,
         list_distinct(list_filter({words("coalesce(venue_name, '') || ' ' || coalesce(address, '')")}, lambda w: length(w) > 2 AND NOT list_contains({DULL}, w))) AS place,
         trim(regexp_replace(lower(coalesce(venue_name, '') || ' ' || coalesce(address, '')), '[^a-z0-9]+', ' ', 'g')) AS venue,
         regexp_replace(regexp_replace(regexp_replace(lower(url), '^https?://(www\\.)?', ''), '[?#].*$', ''), '/$', '') AS page,
         {UNTIMED} AS untimed
  FROM listings),
told2 AS (
  SELECT *, list_distinct(tokens) AS ws, '  ' || array_to_string(tokens, ' ') || ' ' AS padded,
         list_position(list_transform(aw, lambda w: regexp_matches(w, '^[0-9]+[a-z]?$')), TRUE) AS house FROM told),
feat AS (
  SELECT *, list_distinct(list_transform(range(1, length(padded) - 1), lambda i: substr(padded, i, 3))) AS grams,
         CASE WHEN house > 0 AND house < len(aw) THEN aw[house] || ' ' || aw[house + 1] END AS street,
         greatest(local_date, coalesce(strftime(ends AT TIME ZONE 'UTC' AT TIME ZONE 'America/Toronto', '%Y-%m-%d'), local_date)) AS last_date FROM told2)"""
_AGREE = "CASE WHEN a.untimed AND b.untimed THEN 0.8::DOUBLE WHEN a.untimed <> b.untimed THEN 0.4::DOUBLE WHEN abs(epoch(a.starts) - epoch(b.starts)) <= 900 THEN 1.0::DOUBLE WHEN abs(epoch(a.starts) - epoch(b.starts)) <= 3600 THEN 0.5::DOUBLE WHEN abs(epoch(a.starts) - epoch(b.starts)) <= 10800 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END"
PAIRS = f"""days AS (SELECT *, unnest(list_transform(range(0, 14), lambda i: CAST(CAST(local_date AS DATE) + i::INTEGER AS VARCHAR))) AS day FROM feat),
pairs AS (
  SELECT DISTINCT a.id AS a, b.id AS b
  FROM days a JOIN days b ON a.day = b.day AND a.id < b.id AND a.day <= a.last_date AND b.day <= b.last_date
  WHERE (a.source_slug <> b.source_slug OR (((a.untimed AND b.untimed) OR {_AGREE} >= 1)
          AND CASE WHEN a.street IS NOT NULL AND b.street IS NOT NULL THEN a.street = b.street ELSE a.venue = '' OR b.venue = '' OR a.venue = b.venue END))
    AND (a.municipality_slug IS NULL OR b.municipality_slug IS NULL OR a.municipality_slug = b.municipality_slug
         OR coalesce(NOT a.untimed AND NOT b.untimed AND a.starts = b.starts AND a.street = b.street, FALSE))),
parts AS (
  SELECT p.a, p.b, {_AGREE} AS time, a.page = b.page AS same_page, a.local_date = b.local_date AS same_day,
         coalesce(NOT a.untimed AND NOT b.untimed AND a.starts = b.starts AND a.street = b.street, FALSE) AS same_place,
         len(list_intersect(a.ws, b.ws))::DOUBLE AS wi, len(a.ws)::DOUBLE AS wa, len(b.ws)::DOUBLE AS wb,
         len(list_intersect(a.grams, b.grams))::DOUBLE AS gi, len(a.grams)::DOUBLE AS ga, len(b.grams)::DOUBLE AS gb,
         len(list_intersect(a.place, b.place))::DOUBLE AS pi, len(a.place)::DOUBLE AS pa, len(b.place)::DOUBLE AS pb, a.street AS sa, b.street AS sb
  FROM pairs p JOIN feat a ON a.id = p.a JOIN feat b ON b.id = p.b),
signals AS (
  SELECT a, b, time, same_page, same_day, same_place,
         greatest(0.5::DOUBLE * CASE WHEN wa = 0 AND wb = 0 THEN 1.0::DOUBLE ELSE wi / (wa + wb - wi) END + 0.5::DOUBLE * CASE WHEN ga = 0 AND gb = 0 THEN 1.0::DOUBLE ELSE 2 * gi / (ga + gb) END,
                  CASE WHEN least(wa, wb) >= 2 THEN wi / least(wa, wb) ELSE 0.0::DOUBLE END * 0.8::DOUBLE) AS title,
         CASE WHEN sa IS NOT NULL AND sb IS NOT NULL THEN CASE WHEN sa = sb THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN pa = 0 OR pb = 0 THEN 0.5::DOUBLE
              WHEN pi / (pa + pb - pi) >= 0.34::DOUBLE THEN 1.0::DOUBLE WHEN pi > 0 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS place
  FROM parts),
s1 AS (SELECT *, 0.55::DOUBLE * title + 0.3::DOUBLE * time + 0.15::DOUBLE * place AS x FROM signals),
s2 AS (SELECT *, CASE WHEN title < 0.45::DOUBLE THEN least(x, 0.45::DOUBLE) ELSE x END AS y FROM s1),
s3 AS (SELECT *, CASE WHEN same_page THEN greatest(y, 0.9::DOUBLE) ELSE y END AS z FROM s2),
scored AS (SELECT *, least(1.0::DOUBLE, CASE WHEN NOT same_day THEN least(z, 0.85::DOUBLE - 0.01::DOUBLE) ELSE z END) AS score FROM s3),
verdicts AS (SELECT *, CASE WHEN score >= 0.85::DOUBLE THEN 'same' WHEN score <= 0.45::DOUBLE THEN 'distinct' ELSE 'ambiguous' END AS verdict FROM scored)"""
