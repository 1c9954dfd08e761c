"""Sizes of pictures, from their first bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import by_value

by_value(__name__)
# The least width and height of a large share card, and the largest believable side.
CARD, LARGEST = (600, 315), 65535


def _number(data: Column, at: int, size: int, little: bool = False) -> Column:
    """An unsigned integer of `size` bytes from the offset `at`."""
    order = range(size - 1, -1, -1) if little else range(size)
    return F.conv(F.concat(*[F.hex(F.substring(data, at + 1 + i, 1)) for i in order]), 16, 10).cast("long")


def header_size(data: Column) -> Column:
    """width and height of PNG, GIF and the three WebP codings, by expressions alone; else null."""
    text = lambda at, n: F.decode(F.substring(data, at + 1, n), "ISO-8859-1")
    pair = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    bits = _number(data, 21, 4, little=True)
    webp = (F.length(data) >= 30) & (text(0, 4) == "RIFF") & (text(8, 4) == "WEBP")
    low14 = lambda x: x.bitwiseAND(F.lit(0x3FFF))
    size = (
        F.when((F.length(data) >= 24) & (F.hex(F.substring(data, 1, 8)) == "89504E470D0A1A0A") & (text(12, 4) == "IHDR"), pair(_number(data, 16, 4), _number(data, 20, 4)))
        .when((F.length(data) >= 10) & (text(0, 4) == "GIF8"), pair(_number(data, 6, 2, True), _number(data, 8, 2, True)))
        .when(webp & (text(12, 4) == "VP8X"), pair(_number(data, 24, 3, True) + 1, _number(data, 27, 3, True) + 1))
        .when(webp & (text(12, 4) == "VP8 "), pair(low14(_number(data, 26, 2, True)), low14(_number(data, 28, 2, True))))
        .when(webp & (text(12, 4) == "VP8L") & (F.hex(F.substring(data, 21, 1)) == "2F"), pair(low14(bits) + 1, low14(F.shiftright(bits, 14)) + 1))
    )
    return sane(size)


def sane(size: Column) -> Column:
    inside = lambda n: (n > 0) & (n <= LARGEST)
    return F.when(inside(size["width"]) & inside(size["height"]), size)


def _jpeg(data: bytes) -> tuple[int, int] | None:
    """Walk the segments to the frame header; scans and anything odd end the walk."""
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 9 < len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
        elif kind == 0x01 or 0xD0 <= kind <= 0xD9:
            at += 2
        else:
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            if size < 2 or kind == 0xDA:
                return None
            at += 2 + size
    return None


@F.pandas_udf(T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())]))
def jpeg_size(data: pd.Series) -> pd.DataFrame:
    found = [(_jpeg(bytes(d)) if d is not None else None) or (None, None) for d in data]
    return pd.DataFrame(found, columns=["width", "height"]).astype("Int64")


def image_size(data: Column) -> Column:
    return F.coalesce(header_size(data), sane(jpeg_size(data)))


def kind_of(data: Column) -> Column:
    """png, gif, webp or jpeg by the first bytes; else null."""
    head = F.hex(F.substring(data, 1, 12))
    return F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("47494638"), "gif").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("52494646") & F.substring(head, 17, 8).eqNullSafe("57454250"), "webp")


def share_card(url: Column, width: Column, height: Column) -> Column:
    """The picture for a share card: one that may be shown elsewhere and was measured large enough."""
    from .text import shareable_host

    return F.when(shareable_host(url) & (width >= CARD[0]) & (height >= CARD[1]), url)
