"""Where an event is: municipality, street, words of the place."""

from __future__ import annotations

import re
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import GAZETTEER, NAMES
from .patterns import let

# Words that make the name before them a street's, and short forms of street words.
STREETS = "street|st|road|rd|avenue|ave|drive|dr|boulevard|blvd|crescent|cres|lane|ln|line|court|crt|way|trail|trl|sideroad|sdrd|place|pl|parkway|pkwy|circle|cir|terrace|concession|conc"
SHORT = {"highway": "hwy", "road": "rd", "street": "st", "avenue": "ave", "drive": "dr", "boulevard": "blvd", "crescent": "cres", "concession": "conc", "sideroad": "sdrd", "line": "ln", "lane": "ln", "court": "crt", "place": "pl", "trail": "trl", "north": "n", "south": "s", "east": "e", "west": "w"}
# Words that say nothing about what or where an event is.
STOPWORDS = """the a an of and & at in on for to with by presented presents annual event events township town city county public
library community centre center park hall free am pm edition monday tuesday wednesday thursday friday saturday sunday mondays
tuesdays wednesdays thursdays fridays saturdays sundays january february march april may june july august september october
november december jan feb mar apr jun jul aug sep sept oct nov dec""".split()
PLACE_WORDS = sorted({n.lower() for names in GAZETTEER.values() for n in names})


#: Names as they are found, in the order in which they win: the longest first, the county's last.
_RANKED = [x for x in NAMES if x[1] != "simcoe-county"] + [x for x in NAMES if x[1] == "simcoe-county"]
_BODY = lambda name: re.escape(name).replace(r"\-", "[- ]").replace(r"\ ", "[- ]")
#: All places where a name begins, the longest there, unless a street word follows.
_FOUND = rf"(?i)(?<![A-Za-z])(?=({'|'.join(_BODY(n) for n, _ in NAMES)})(?![A-Za-z])(?! +(?:{STREETS})(?![0-9A-Za-z_])))"


def resolve_municipality(*texts: Column) -> Column:
    """The slug of the longest name in the texts that no street word follows; the county only if no other.

    One pattern finds all names at once, overlapping ones too; a constant map ranks them."""
    text = F.concat_ws(" | ", *[F.nullif(t, F.lit("")) for t in texts])
    found = F.transform(F.regexp_extract_all(text, F.lit(_FOUND), F.lit(1)), lambda n: F.replace(F.lower(n), F.lit("-"), F.lit(" ")))
    plain = {}
    for rank, (name, _) in enumerate(_RANKED):
        plain.setdefault(name.lower().replace("-", " "), rank)
    ranks = F.create_map(*[F.lit(x) for pair in plain.items() for x in pair])
    best = F.array_min(F.transform(found, lambda n: ranks[n]))
    return F.get(F.array(*[F.lit(slug) for _, slug in _RANKED]), best)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: w != "")


def street_key(address: Column) -> Column:
    """House number and the word behind it, in short form; null when there is no such pair."""
    short = F.create_map(*[F.lit(x) for pair in SHORT.items() for x in pair])
    words = F.transform(_words(address), lambda w: F.coalesce(short[w], w))
    first = lambda ws: F.get(F.filter(F.transform(ws, lambda w, i: F.when(w.rlike("^[0-9]+[a-z]?$"), i)), lambda i: i.isNotNull()), F.lit(0))
    return let(words, lambda ws: let(first(ws), lambda at: F.concat(F.get(ws, at), F.lit(" "), F.get(ws, at + 1))))


def place_tokens(venue: Column, address: Column) -> Column:
    """Distinct words over two letters of venue and address that say something."""
    dull = F.array(*[F.lit(w) for w in [*STOPWORDS, *PLACE_WORDS]])
    words = _words(F.concat_ws(" ", F.coalesce(venue, F.lit("")), F.coalesce(address, F.lit(""))))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(dull, w)))


def venue_key(venue: Column, address: Column) -> Column:
    both = F.lower(F.concat_ws(" ", F.coalesce(venue, F.lit("")), F.coalesce(address, F.lit(""))))
    return F.trim(F.regexp_replace(both, "[^a-z0-9]+", " "))
