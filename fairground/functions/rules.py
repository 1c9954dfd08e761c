"""Decision lists: what is an event, what it costs, and what it is about."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import NAMES
from ..shipping import by_value
from .patterns import java, let, matches, squeeze, swap
from .text import snippet
from .titles import is_meeting

by_value(__name__)

# Titles and labels of rows that are not events.
NOT_EVENTS = [
    r"^\s*$",
    r"^test\b",
    r"^placeholder\b",
    r"\b(garbage|recycling|organics|yard waste|blue box|green bin)\b.*\b(pick-?up|collection|day)\b",
    r"\b(office|facility|arena|library|landfill|transfer station) (closed|closure)\b",
    r"^closed\s*($|[-–—:(]|(for|on|today)\b)",
    r"\b(closed|closure)\s*$",
    r"\bbranches (are |will be )?closed\b",
    r"\b(special|regular|holiday|modified|reduced) hours\b",
    r"^(holiday|statutory holiday)\b",
    r"^proclamation\b",
    r"\b(clock tower|town hall|bridge) (illuminated|lit) ",
    r"^flag[- ]raising\b.*\b(proclamation)\b",
]
# Titles of days that are observed rather than attended.
OBSERVANCES = [
    r"\b(heritage|history|awareness) month$",
    r"^(international|world|national)\b.*\bday\b",
    r"^(remembrance day|thanksgiving( day)?|halloween|diwali|family day|inuit day|franco-ontarian day|indigenous veterans day|human rights day|(autumn|fall|spring) equinox|(summer|winter) solstice)$",
    r"^(chanukah|hanukkah|ramadan|passover|lent) (begins|ends)$",
    r"^pa day\b",
]
# Words about money.
PRICE_STEMS = ["admission", "ticket", "cost", "fee", "price", "entry", "entrance", "adult", "senior", "student", "child", "youth", "member", "drop-in", "dropin", "per person", "per family", "at the door", "in advance", "registration", "rate"]
MONEY = r"\$\s?\d[\d,]*(\.\d{1,2})?|\b\d+(\.\d{2})?\s?(dollars|cad)\b"
FREE_ADMISSION = r"\b(free admission|admission is free|free of charge|free to attend|free event|free program|free drop-?in|no charge|no cost|no fee|free entry|entry is free|pwyc|pay what you can|by donation|donations? (are )?(welcome|appreciated|accepted|gratefully)|free will offering|complimentary)\b"
FREE_WORD = r"\bfree\b"
PAID_WORDS = r"\b(tickets? (are )?(required|available|on sale)|registration fee|admission fee|cover charge|paid admission|purchase tickets?|buy tickets?)\b"
FALSE_FRIENDS = r"\b(free parking|scent[- ]free|nut[- ]free|smoke[- ]free|barrier[- ]free|gluten[- ]free|hands[- ]free|free play|freestyle|free-?style|free the|duty[- ]free|free[- ]range|free[- ]standing|free[- ]roam|free wi-?fi|free refreshments|free coffee|free popcorn)\b"
ZERO = r"^\s*(\$?\s?0(\.00)?|none|n/a|nil)\s*$"
FUNDRAISING = r"\b(raise[ds]?|raising|proceeds|donated|donation of|grants?|prizes?|jackpot|goal|target|worth|valued at|awards?|scholarships?)\b"
#: How far before and behind a sum a price word explains it.
BEFORE, BEHIND = 34, 26
# What each category is about, in the order in which they are tried.
CATEGORIES = [
    ("markets", r"\b(markets?|farmers'? markets?|craft (sale|show)|garage sale|yard sale|bazaar|swap|flea)\b"),
    ("music", r"\b(music|concerts?|bands?|choirs?|orchestra|jazz|folk|blues|karaoke|open mic|singing|drum|tribute)\b"),
    ("arts", r"\b(art|arts|gallery|galleries|theatre|theater|films?|movies?|cinema|dance(?! fitness)|drama|craft|pottery|painting|photograph|exhibit|museum|heritage|culture|cultural|literary|author|poetry|quilt\w*|knit\w*|crochet\w*|sew(ing)?|stitch\w*|weav\w*|embroider\w*|bead\w*|jewel(le)?ry[- ]making)\b"),
    ("family", r"\b(family|families|kids?|child|children|toddler|baby|babies|preschool|youth|teen|tween|story ?time|storytime|circle time|parent|lego|play ?group)\b"),
    ("sports", r"\b(sport|sports|hockey|soccer|baseball|basketball|skating|skate|swim|run|race|marathon|5k|10k|golf|tennis|pickleball|curling|fitness|yoga|zumba|tai chi|pilates|hiit|aerobics?|workouts?|exercise|weights|strength|stretch\w*|spin|badminton|volleyball|shuffleboard|bike|cycling|cornhole|bowling|shinny|tournament)\b"),
    ("outdoors", r"\b(outdoors?|hikes?|hiking|walks?|walking|trails?|parks?|nature|gardens?|beach(es)?|camps?|camping|fishing|derby|paddle|paddling|canoe|kayak|birds?|birding|forest|conservation|earth day|trees?(?! lighting)|rides?)\b"),
    ("education", r"\b(workshops?|class(es)?|courses?|lectures?|talks?|seminars?|webinar|training|learn|lessons?|tutorial|book club|genealogy|history|science|tech|computer|literacy|clinic|information session|info session|for beginners|101)\b"),
    ("community", r"\b(community|volunteers?|fundrais\w*|charity|church|legion|seniors?|social|celebrations?|festivals?|fairs?|parades?|bbq|barbecue|dinners?|breakfasts?|lunch|potluck|open house|remembrance|canada day|christmas|halloween|easter|holiday|santa|tree lighting|fireworks|ceremony|flag raising|meet and greet|drop-?in|club|bingo|euchre|cribbage|mahjong|trivia|games? night|board games|chess|coffee|tea|social)\b"),
]
# Labels that say nothing, name a department, or say for whom.
GENERIC = r"^((special |public library )?events?|calendar|programs?( and events)?|recreation programs and events|general|all|other|misc|featured|homepage featured|things to do|happening soon|library happenings|registered|free program|pop-up|ongoing/weekly event|)$"
DEPARTMENT = r"^(recreation|parks?|facilities|culture)(,? *(and |& )?(recreation|parks?|facilities|culture))+( events?)?$"
AUDIENCE = r"^(for )?(adults?( programming)?|seniors?|55\+|all[- ]ages|drop[- ]?in( programs)?|newcomers|2slgbtq\+|allies|((external|town organized|community hosted) )?community( events?| calendar)?)$"
PLACE = r"\b(" + "|".join(re.escape(n).replace(r"\-", "[- ]").replace(r"\ ", "[- ]") for n, _ in NAMES) + r")\b"


def is_observance(title: Column, untimed: Column) -> Column:
    """A day to observe: such a title, and no time given."""
    return untimed & matches(F.trim(title), "|".join(OBSERVANCES))


def is_public(title: Column, categories: Column, untimed: Column) -> Column:
    """No title or label of something that is no event, and no observance."""
    pattern = "|".join(f"(?:{p})" for p in NOT_EVENTS)
    named = matches(F.trim(F.coalesce(title, F.lit(""))), pattern) | F.exists(categories, lambda c: matches(F.trim(c), pattern))
    return ~named & ~is_observance(title, untimed)


def contains_money(text: Column) -> Column:
    return matches(text, MONEY)


def looks_like_fundraising(text: Column) -> Column:
    return matches(text, FUNDRAISING)


def strip_false_friends(text: Column) -> Column:
    return swap(text, FALSE_FRIENDS, " ")


def _near(width: int, before: bool) -> str:
    gaps = [(s, width - len(s)) for s in PRICE_STEMS]
    return "|".join(rf"{re.escape(s)}[\s\S]{{0,{g}}}" if before else rf"[\s\S]{{0,{g}}}{re.escape(s)}" for s, g in gaps)


def has_price(text: Column) -> Column:
    """A sum with a price word at most BEFORE characters before or BEHIND behind it."""
    return matches(text, rf"(?:{_near(BEFORE, True)})(?:{MONEY})") | matches(text, rf"(?:{MONEY})(?:{_near(BEHIND, False)})")


@F.pandas_udf(T.StringType())
def price_line(text: pd.Series) -> pd.Series:
    """The line of the first sum that has a price word near it, or what stands around it if the line is long."""
    money = re.compile(MONEY, re.IGNORECASE | re.ASCII)
    word = re.compile("|".join(map(re.escape, PRICE_STEMS)), re.IGNORECASE)

    def find(s: str) -> str | None:
        for m in money.finditer(s):
            a, b = max(0, m.start() - BEFORE), m.end() + BEHIND
            if word.search(s[a : m.start()]) or word.search(s[m.end() : b]):
                line = s[s.rfind("\n", 0, m.start()) + 1 :].split("\n", 1)[0].strip()
                return line if line and len(line) <= 120 else s[a:b].strip()
        return None

    return text.map(find, na_action="ignore")


def _says_paid(text: Column) -> Column:
    return matches(text, rf"(?<!\b(no|not)\s){PAID_WORDS}")


def assess_cost(is_free: Column, cost_text: Column, title: Column, description: Column, evidence: bool = False) -> Column:
    """cost and confidence; with evidence, the words that decided too (which needs a Python function).

    In this order: the source's own flag; its cost text; free admission; a price with its word; tickets
    asked for; "free" in the title; "free" somewhere (low); a bare sum or nothing (unknown, low)."""
    given = strip_false_friends(F.trim(F.coalesce(cost_text, F.lit(""))))
    name = strip_false_friends(F.coalesce(title, F.lit("")))
    text = strip_false_friends(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    line = price_line(text) if evidence else F.lit(None).cast("string")
    read = F.struct(given.alias("given"), name.alias("name"), text.alias("text"), line.alias("line"))
    return let(read, lambda r: _cost_of(is_free, r["given"], r["name"], r["text"], r["line"], evidence))


def _cost_of(is_free: Column, given: Column, name: Column, text: Column, line: Column, evidence: bool) -> Column:
    found = lambda pattern: snippet(F.regexp_extract(text, java(f"({pattern})"), 1))
    around = lambda pattern: snippet(F.regexp_extract(text, java(rf"([\s\S]{{0,40}}(?:{pattern})[\s\S]{{0,46}})"), 1))
    none = F.lit(None).cast("string")
    steps = [
        (F.coalesce(is_free, F.lit(False)), "free", "high", none),
        ((given != "") & matches(given, f"{ZERO}|{FREE_ADMISSION}|{FREE_WORD}"), "free", "high", snippet(given)),
        ((given != "") & (matches(given, MONEY) | _says_paid(given) | matches(given, "|".join(map(re.escape, PRICE_STEMS)))), "paid", "high", snippet(given)),
        (F.coalesce(~is_free, F.lit(False)), "paid", "high", none),
        (matches(text, FREE_ADMISSION), "free", "high", found(FREE_ADMISSION)),
        (has_price(text), "paid", "high", snippet(line)),
        (_says_paid(text), "paid", "high", found(PAID_WORDS)),
        (matches(name, FREE_WORD), "free", "high", snippet(name)),
        (matches(text, FREE_WORD), "free", "low", around(FREE_WORD)),
        (matches(text, MONEY), "unknown", "low", around(MONEY)),
    ]
    value = lambda cost, sure, why: F.struct(F.lit(cost).alias("cost"), F.lit(sure).alias("confidence"), *([why.alias("evidence")] if evidence else []))
    first = F.when(steps[0][0], value(*steps[0][1:]))
    return reduce(lambda out, s: out.when(s[0], value(*s[1:])), steps[1:], first).otherwise(value("unknown", "low", none))


def decide_cost(text: Column, title: Column, quote: Column) -> Column:
    """The cost that a quoted passage supports: the quote must stand in the text; then the rules read it; a
    bare sum in at most 140 characters that is not fundraising counts as a price. Else unknown."""
    by_rule = lambda said: assess_cost(F.lit(None).cast("boolean"), said, title, F.lit(None).cast("string"))["cost"]
    bare = lambda said: contains_money(said) & (F.length(said) <= 140) & ~looks_like_fundraising(said)
    flat = F.lower(squeeze(text))
    read = lambda said: let(by_rule(said), lambda rule: F.when(rule != "unknown", rule).when(bare(said), "paid").otherwise("unknown"))
    return let(squeeze(quote), lambda said: F.when(said.isNull() | (said == "") | ~F.contains(flat, F.lower(said)), "unknown").otherwise(read(said)))


def without_places(text: Column) -> Column:
    return squeeze(swap(text, PLACE, " "))


def classify(title: Column, categories: Column) -> Column:
    """Meetings; then what the subject labels say, the title, the audience labels; else other."""
    says = lambda texts, rule: F.exists(texts, lambda t: matches(t, rule))
    first = lambda texts: reduce(lambda out, x: out.when(says(texts, x[1]), x[0]), CATEGORIES[1:], F.when(says(texts, CATEGORIES[0][1]), CATEGORIES[0][0]))
    labels = F.filter(F.transform(categories, lambda c: without_places(F.trim(c))), lambda c: ~matches(c, f"{GENERIC}|{DEPARTMENT}"))
    sorted_ = let(labels, lambda ls: F.struct(F.filter(ls, lambda c: ~matches(c, AUDIENCE)).alias("subject"), F.filter(ls, lambda c: matches(c, AUDIENCE)).alias("audience")))
    about = let(sorted_, lambda x: F.coalesce(first(x["subject"]), first(F.array(without_places(title))), first(x["audience"]), F.lit("other")))
    return F.when(is_meeting(title, categories), "civic-meeting").otherwise(about)
