"""Identity: listing ids, short codes and the hash that tells whether a listing's text changed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import by_value

# Start and multiplier of the two 32-bit lanes.
LANES = ((0x811C9DC5, 0x01000193), (0x01000193, 0x85EBCA6B))
MASK = 0xFFFFFFFF


#: Texts that are left longer than all others are hashed one by one from so few on.
FEW = 8
by_value(__name__)


def hash_texts(texts: list[str | None]) -> list[str | None]:
    """Sixteen hex digits of each text: both lanes over its UTF-16 units; null stays null.

    A lane's step needs the one before, so texts advance together, one unit of each at a time: they are
    ordered by length, and step i takes those that have an i-th unit."""
    known = [i for i, t in enumerate(texts) if t is not None]
    units = [np.frombuffer(texts[i].encode("utf-16-le", "surrogatepass"), "<u2") for i in known]
    order = sorted(range(len(units)), key=lambda k: -len(units[k]))
    lengths = [len(units[k]) for k in order]
    flat = np.concatenate([*(units[k] for k in order), np.zeros(0, "<u2")]).astype(np.uint32)
    starts = np.cumsum([0, *lengths[:-1]]) if lengths else np.zeros(0, int)
    lanes = [np.full(len(order), start, np.uint32) for start, _ in LANES]
    step, live = 0, len(order)
    while True:
        while live and lengths[live - 1] <= step:
            live -= 1
        if live < FEW:
            break
        unit = flat[starts[:live] + step]
        for lane, (_, by) in zip(lanes, LANES, strict=True):
            lane[:live] = (lane[:live] ^ unit) * np.uint32(by)
        step += 1
    for k in range(live):
        rest = flat[starts[k] + step : starts[k] + lengths[k]].tolist()
        for lane, (_, by) in zip(lanes, LANES, strict=True):
            h = int(lane[k])
            for u in rest:
                h = (h ^ u) * by & MASK
            lane[k] = h
    out: list[str | None] = [None] * len(texts)
    for k, a, b in zip(order, *(lane.tolist() for lane in lanes), strict=True):
        out[known[k]] = f"{a:08x}{b:08x}"
    return out


@F.pandas_udf(T.StringType())
def _hashed(texts: pd.Series) -> pd.Series:
    return pd.Series(hash_texts([None if t is None else t for t in texts.astype(object).where(texts.notna(), None)]), dtype=object)


def text_hash(text: Column) -> Column:
    """Sixteen hex digits of a text, as hash_texts() gives them. A hash is a chain of steps, one for each
    character: a batch of texts takes them in step with numpy, where column functions would take each alone."""
    return _hashed(text)


def short_code(identity: Column) -> Column:
    """Seven digits for links: the hash without leading zeros, cut or filled to seven."""
    return F.lpad(F.substring(F.regexp_replace(text_hash(identity), "^0+", ""), 1, 7), 7, "0")


def listing_id(source: Column, external: Column) -> Column:
    return F.concat(source, F.lit(":"), external)


def content_text(raw: dict[str, Column]) -> Column:
    """The revisable fields of a raw event as a JSON array in a fixed order; absent ones are null, so a
    field that appears is a change. raw: columns by field name."""
    text = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(?s)(.*)\}$', 1))
    flag = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    parts = [
        text(raw["title"]), text(raw["description"]), text(raw["local_start"]), text(raw["local_end"]), flag(F.coalesce(raw["all_day"], F.lit(False))),
        text(F.coalesce(raw["time_precision"], F.lit("exact"))), text(raw["venue_name"]), text(raw["address"]), text(raw["cost_text"]), flag(raw["is_free"]),
        F.to_json(raw["categories"]), text(raw["organizer"]), text(raw["image_url"]), text(raw["url"]),
    ]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def content_hash(raw: dict[str, Column]) -> Column:
    return text_hash(content_text(raw))


def visitor_key(day: Column, address: Column) -> Column:
    """A key of a visitor that changes every day, so it names nobody: 64 hex digits."""
    return F.sha2(F.concat(day, F.lit(":"), F.coalesce(address, F.lit("unknown"))), 256)
