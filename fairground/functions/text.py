"""Text: cleaning, markup, folding, slugs, addresses of pages."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import by_value
from .patterns import WS, let, squeeze, swap

by_value(__name__)

# The named entities that are read, and what they stand for.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“", "copy": "©", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "ocirc": "ô", "icirc": "î", "ecirc": "ê", "trade": "™", "reg": "®"}

#: The same as one SQL literal, which is built at once.
_ENTITY_MAP = "map(" + ", ".join(f"'{k}', " + ("\"'\"" if v == "'" else f"'{v}'") for k, v in ENTITIES.items()) + ")"


def clean(text: Column) -> Column:
    """White space collapsed; nothing left: null."""
    return let(squeeze(text), lambda t: F.when(t != "", t))


def snippet(text: Column) -> Column:
    return F.substring(squeeze(text), 1, 90)


def _decode(text: str) -> str:
    def one(m: re.Match) -> str:
        body = m[1]
        if body[0] != "#":
            return ENTITIES.get(body.lower(), m[0])
        number = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
        return chr(number) if number < 0x110000 else m[0]

    # Numeric references first, then named ones, so that "&#38;lt;" reads as "<".
    return re.sub(r"&([a-zA-Z]+);", one, re.sub(r"&(#[xX][0-9a-fA-F]+|#\d+);", one, text))


@F.pandas_udf(T.StringType())
def decode_entities(text: pd.Series) -> pd.Series:
    return text.map(_decode, na_action="ignore")


def _without_tags(text: str) -> str:
    for pattern, to in ((r"<(script|style)[^>]*>[\s\S]*?</\1>", " "), (r"<!--[\s\S]*?-->", " "), (r"<br\s*/?>", "\n"), (r"</(?:p|div|li|h[1-6]|tr|section|article)>", "\n"), (r"<[^>]+>", " ")):
        text = re.sub(pattern, to, text, flags=re.IGNORECASE)
    lines = [re.sub(r"[ \t\xa0]+", " ", line).strip() for line in _decode(text).split("\n")]
    return "\n".join(line for i, line in enumerate(lines) if line or (i and lines[i - 1])).strip()


@F.pandas_udf(T.StringType())
def strip_tags(markup: pd.Series) -> pd.Series:
    """Text of a page: blocks end lines, runs of blank lines shrink to one, entities are read."""
    return markup.map(_without_tags, na_action="ignore")


def tag_text(markup: Column) -> Column:
    """strip_tags without Python, for markup whose entities are the named ones of ENTITIES."""
    out = markup
    for pattern, to in ((r"<(script|style)[^>]*>[\s\S]*?</\1>", " "), (r"<!--[\s\S]*?-->", " "), (r"<br\s*/?>", "\n"), (r"</(p|div|li|h[1-6]|tr|section|article)>", "\n"), (r"<[^>]+>", " ")):
        out = swap(out, pattern, to)
    for name, to in ENTITIES.items():
        if name != "amp":
            out = F.replace(out, F.lit(f"&{name};"), F.lit(to))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def decode_references(text: Column) -> Column:
    """Numeric references, then the named ones of ENTITIES, each read once and without Python; others stay."""

    def pieces(held: Column, mark: str, read: Callable[[Column], Column]) -> Column:
        # Every piece but the first begins with a mark, so what one reference stands for is not read again.
        return F.concat_ws("", F.transform(F.split(held, f"(?={mark})"), read))

    def numeric(piece: Column) -> Column:
        body, rest = F.regexp_extract(piece, "(?s)^&#0*([0-9]{1,7}|[xX][0-9a-fA-F]{1,12});", 1), F.regexp_extract(piece, "(?s)^&#[^;]*;(.*)$", 1)
        code = F.when(body.rlike("^[xX]"), F.conv(F.substring(body, 2, 12), 16, 10).cast("long")).otherwise(F.try_to_number(body, F.lit("9999999")).cast("long"))
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when((body != "") & (code < 0x110000), F.concat(char, rest)).otherwise(piece)

    def named(piece: Column) -> Column:
        name = F.regexp_extract(piece, "^&([a-zA-Z]+);", 1)
        known = F.try_element_at(F.expr(_ENTITY_MAP), F.lower(name))
        return F.coalesce(F.concat(known, F.substring(piece, F.length(name) + 3, F.length(piece))), piece)

    return F.when(text.contains("&"), pieces(pieces(text, "&#", numeric), "&", named)).otherwise(text)


def fragment_lines(markup: Column) -> Column:
    """Text of a fragment without Python: blocks end lines, runs of blank lines shrink to one, references are read."""

    def stripped(text: Column) -> Column:
        # Three passes: what is no text, what ends a line, other tags.
        for pattern, to in ((r"<(script|style)[^>]*>[\s\S]*?</\1>|<!--[\s\S]*?-->", " "), (r"<br\s*/?>|</(p|div|li|h[1-6]|tr|section|article)>", "\n"), (r"<[^>]+>", " ")):
            text = swap(text, pattern, to)
        return let(text, decode_references)

    plain = let(markup, lambda m: F.when(m.rlike("[<&]"), stripped(m)).otherwise(m))
    lines = F.regexp_replace(F.regexp_replace(plain, r"[ \t\r\x{a0}]+", " "), " ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def text_of(markup: Column) -> Column:
    """One line of text."""
    return squeeze(strip_tags(markup))


def truncate(text: Column, most: int = 1000) -> Column:
    """At most `most` characters, cut behind a sentence or before a line or word in the second half, and "…"."""
    cut = F.substring(text, 1, most)
    sentence, line, word = (most - F.locate(mark[::-1], F.reverse(cut)) - len(mark) + 2 for mark in (". ", "\n", " "))
    found = lambda mark, at: F.when(F.locate(mark, cut) > 0, at).otherwise(0)
    at = F.greatest(found(". ", sentence), found("\n", line), found(" ", word))
    keep = F.when(at - 1 > most / 2, F.when(F.substring(cut, at, F.lit(1)) == ".", at).otherwise(at - 1)).otherwise(most)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.trim(F.substring(cut, F.lit(1), keep)), F.lit("…")))


#: Marks that one letter carries, taken off; built from the decompositions of all letters below 0x2000.
_PLAIN = {}
for _i in range(0xC0, 0x2000):
    _base = "".join(c for c in unicodedata.normalize("NFD", chr(_i)) if not unicodedata.category(c).startswith("M"))
    if len(_base) == 1 and _base != chr(_i):
        _PLAIN[chr(_i)] = _base


def fold(text: Column) -> Column:
    """For search: no marks, lower case, straight quotes. Letters with marks are those below 0x2000."""
    plain = F.translate(text, "".join(_PLAIN), "".join(_PLAIN.values()))
    return F.translate(F.lower(F.regexp_replace(plain, r"\p{M}+", "")), "‘’“”", "''\"\"")


def fold_python(text: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M"))
    return plain.lower().translate(str.maketrans("‘’“”", "''\"\""))


def slugify(text: Column) -> Column:
    """Letters and digits joined by hyphens, at most 60 characters."""
    plain = F.lower(F.regexp_replace(F.translate(text, "".join(_PLAIN), "".join(_PLAIN.values())), r"[\x{0300}-\x{036f}]", ""))
    return F.substring(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 60)


def canonical_url(url: Column) -> Column:
    """Lower case, no scheme, no www., no query or fragment, no slash at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(url), r"^https?://(www\.)?", ""), r"[?#].*$", ""), "/$", "")


def shareable_host(url: Column) -> Column:
    """Whether a picture may be shown elsewhere: not those on calendar. and events. hosts; no picture: no."""
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    return url.isNotNull() & (url != "") & ~host.rlike(r"(?i)^(calendar|events)\.")


def split_location(location: Column) -> tuple[Column, Column]:
    """Venue and address: a digit behind the first comma makes the whole an address."""
    text = F.nullif(F.trim(location), F.lit(""))
    first, rest = F.trim(F.split(text, ",")[0]), F.regexp_extract(text, "^[^,]*,(?s)(.*)$", 1)
    numbered = rest.rlike("[0-9]")
    return F.when(numbered, F.nullif(first, F.lit(""))).otherwise(text), F.when(numbered, text)


def keep_lines(text: Column, most: int = 4000) -> Column:
    """A form's text: white space collapsed in each line, blank runs to one blank line, capped."""
    lines = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("")), r"[ \t]+", " "), r" *\n *", "\n")
    return F.nullif(F.substring(F.trim(F.regexp_replace(lines, r"\n{3,}", "\n\n")), 1, most), F.lit(""))


def title_case(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def markdown_text(text: Column) -> Column:
    """Plain text of the small markup that descriptions may use: emphasis, links, headings, lists."""
    out = F.regexp_replace(text, r"\[([^\]]+)\]\((https?://[^)\s]+)\)", "$1 ($2)")
    out = F.regexp_replace(out, r"(?m)^#{1,6}\s+", "")
    out = F.regexp_replace(out, r"(\*\*|__)(.+?)\1", "$2")
    return F.regexp_replace(out, r"(?<![\w*])\*([^*\n]+)\*(?!\w)", "$1")


def web_address(text: Column) -> Column:
    """A form's page address: a scheme is put before one that has none; anything but http is null."""
    given = F.nullif(F.trim(text), F.lit(""))
    full = F.when(given.rlike("(?i)^[a-z][a-z0-9+.-]*:"), given).otherwise(F.concat(F.lit("https://"), given))
    return F.when(full.rlike(rf"(?i)^https?://[^{WS[1:-1]}]+$"), full)


def redact(message: Column, name: str = "apikey") -> Column:
    return swap(message, rf"{name}=[^&\s]*", f"{name}=REDACTED")


def escape_markup(text: str) -> str:
    return html.escape(text)
