"""Regular expressions that mean the same on Java's engine as where the rules were written."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the wide sense, for the inside of a class.
SPACES = r"\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
WS = f"[{SPACES}]"
#: Before and behind an ASCII word: Java's own edges count accented letters as parts of words.
BEFORE_WORD, BEHIND_WORD = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"


def java(pattern: str, ignore_case: bool = True) -> str:
    """A pattern whose word edges mean ASCII words: one that a word or group follows begins a word, others end one."""
    edges = re.sub(r"\\b(?=(.?.?))", lambda m: BEFORE_WORD if re.match(r"[\w(\[]|\\[dw]", m[1]) else BEHIND_WORD, pattern)
    return ("(?i)" if ignore_case else "") + edges


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Whether a pattern stands anywhere in a text; null: no."""
    return F.coalesce(text.rlike(java(pattern, ignore_case)), F.lit(False))


def swap(text: Column, pattern: str, to: str, ignore_case: bool = True) -> Column:
    return F.regexp_replace(text, F.lit(java(pattern, ignore_case)), F.lit(to))


def squeeze(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def any_of(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used.

    A column expression that names another one twice holds it twice; chains of rules over one cleaned text
    would grow into code that is too large to compile. A lambda's variable is evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
