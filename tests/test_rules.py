"""Rules of single values: titles, costs, categories, places, times, hashes, similarity."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fairground.functions import feeds, hashes, images, places, rules, similarity, text, times, titles


def each(spark, values, use, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", use(F.col("v")).alias("x")).collect()
    return [r["x"] for r in sorted(rows)]


def test_titles(spark):
    given = ["CANCELLED - Town Picnic", "09 08 2026 Youth Group - CANCELLED", "Council - 22 Sep 2026", "Fair - 12 Aug 2026 (At the Hall)", "NO MEETING Board", "CANCELLED", "  ", None, "Market 02 Sep 2026"]
    assert each(spark, given, titles.clean_title) == ["Town Picnic", "Youth Group", "Council", "Fair (At the Hall)", "Board", "CANCELLED", "", None, "Market"]
    assert each(spark, given, titles.stated_status) == ["cancelled", "cancelled", None, None, "cancelled", "cancelled", None, None, None]
    assert each(spark, ["Meeting Cancelled", "Cancelled - Town Hall", "Town Hall"], titles.location_is_marker) == [True, False, False]


@pytest.mark.parametrize(
    ("title", "description", "cost_text", "is_free", "want"),
    [
        ("Fair", "Free admission", None, None, ("free", "high")),
        ("Fair", "Tickets $25 at the door", None, None, ("paid", "high")),
        ("Market", "No Ticket Required!", None, None, ("unknown", "low")),
        ("Gala", "Tickets required", None, None, ("paid", "high")),
        ("Run", "$20,000 raised for charity", None, None, ("unknown", "low")),
        ("Run", "with free snacks", None, None, ("free", "low")),
        ("Free Run", None, None, None, ("free", "high")),
        ("Run", "free parking", None, None, ("unknown", "low")),
        ("Run", "free for all", None, False, ("paid", "high")),
        ("Run", None, "$0.00", False, ("free", "high")),
        ("Run", None, "12", True, ("free", "high")),
        ("Party", "we celebrate", "celebrate", None, ("paid", "high")),
    ],
)
def test_costs(spark, title, description, cost_text, is_free, want):
    rows = spark.createDataFrame([(title, description, cost_text, is_free)], "t string, d string, c string, f boolean")
    assert tuple(rows.select(rules.assess_cost(F.col("f"), F.col("c"), F.col("t"), F.col("d")).alias("x")).first()["x"]) == want


def test_price_evidence(spark):
    rows = spark.createDataFrame([("Adults: $50.00 | Seniors: $45.00",), ("raised $5,000",)], "d string")
    found = rows.select(rules.assess_cost(F.lit(None).cast("boolean"), F.lit(None).cast("string"), F.lit("Show"), F.col("d"), evidence=True)["evidence"].alias("e")).collect()
    assert found[0]["e"] == "Adults: $50.00 | Seniors: $45.00"


def test_categories(spark):
    cases = [("Yoga", ["Recreation, Parks, and Facilities events"], "sports"), ("Wasaga Beach Chess Club", [], "community"), ("Budget Deliberations", [], "civic-meeting"), ("Community Committee Fall Fair", [], "community"), ("Dance Fitness", ["Seniors"], "sports"), ("Tree Lighting", [], "community"), ("x", ["Orillia events"], "other"), ("x", ["Seniors"], "community"), ("Jazz", ["Community Events"], "music")]
    rows = spark.createDataFrame([(t, c, w) for t, c, w in cases], "t string, c array<string>, w string")
    assert [r["got"] for r in rows.select(rules.classify(F.col("t"), F.col("c")).alias("got")).collect()] == [w for _, _, w in cases]


def test_public(spark):
    rows = [("Garbage Cart Pick-up", [], False, False), ("CLOSED - All Branches", [], False, False), ("Closed Captioned Matinee", [], False, True), ("Remembrance Day", [], True, False), ("Remembrance Day", [], False, True), ("Walk", ["Holiday hours: modified hours"], False, False), (None, [], False, False)]
    df = spark.createDataFrame(rows, "t string, c array<string>, u boolean, w boolean")
    assert all(r["got"] == r["w"] for r in df.select("w", rules.is_public(F.col("t"), F.col("c"), F.col("u")).alias("got")).collect())


def test_places(spark):
    given = ["12 Main St, Oro Medonte", "5 Barrie Street, Midland", "County of Simcoe hall", "Barrie, Simcoe County", "orono", "New-Lowell", "Barrie Road", "", None, "cafés in Tay."]
    assert each(spark, given, places.resolve_municipality) == ["oro-medonte", "midland", "simcoe-county", "barrie", None, "clearview", None, None, None, "tay"]
    assert each(spark, ["2297 Highway 12, Brechin", "2297 Hwy 12", "Main Street", "12", None, "Unit 4b Elm Avenue"], places.street_key) == ["2297 hwy", "2297 hwy", None, None, None, "4b elm"]


def test_times(spark):
    zone = F.lit("America/Toronto")
    given = ["2026-07-01T12:00", "2026-01-01T12:00", "2026-03-08T02:30", "2026-11-01T01:30", "2026-02-30T10:00", "soon"]
    assert each(spark, given, lambda v: times.iso(times.wall_to_utc(v, zone))) == ["2026-07-01T16:00:00.000Z", "2026-01-01T17:00:00.000Z", "2026-03-08T06:30:00.000Z", "2026-11-01T05:30:00.000Z", None, None]
    assert each(spark, ["2026/07/01 9:00", "2026/07/01 09:00:05", " 2026-07-01T09:00 "], times.wall_string) == [None, "2026-07-01T09:00", "2026-07-01T09:00"]
    assert each(spark, ["9:30 AM", "12 pm", "12:05 a.m.", "19:00", "25:00", "noon"], times.parse_clock) == ["09:30", "12:00", "00:05", "19:00", None, None]
    assert each(spark, ["19:30", "00:00", "12:00"], times.format_time) == ["7:30 p.m.", "12:00 a.m.", "12:00 p.m."]
    assert each(spark, ["19:30", "00:00", "12:00"], times.compact_time) == ["7:30pm", "12am", "12pm"]
    days = spark.sql("SELECT DATE'2026-02-10' AS d").select(times.month_grid(F.col("d")).alias("g")).first()["g"]
    assert len(days) % 7 == 0 and str(days[0]) == "2026-02-01" and str(days[-1]) == "2026-02-28"


def slow_hash(value):
    lanes = []
    for h, by in ((0x811C9DC5, 0x01000193), (0x01000193, 0x85EBCA6B)):
        raw = value.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * by) & 0xFFFFFFFF
        lanes.append(f"{h:08x}")
    return "".join(lanes)


def test_hashes(spark):
    given = ["a", "severn:1", "Café", "hello world", "🙂x", "x" * 3000]
    assert each(spark, given, hashes.text_hash) == [slow_hash(g) for g in given]
    assert all(len(c) == 7 for c in each(spark, given, hashes.short_code))


def test_titles_alike(spark):
    def alike(a, b):
        rows = spark.createDataFrame([(a, b)], "a string, b string").select(*[similarity.title_tokens(F.col(c)).alias(c) for c in "ab"])
        grams = lambda c: similarity.trigrams(F.array_join(c, " "))
        return rows.select(similarity.title_similarity(F.array_distinct("a"), F.array_distinct("b"), grams("a"), grams("b")).alias("s")).first()["s"]

    assert alike("The", "Of") == 1.0 and alike("Jazz Night", "Jazz Night at the Park") == 1.0
    assert alike("Orillia Jazz Night 2026", "2nd Annual Jazz Night") == 1.0 and alike("Jazz", "Pottery") < 0.2
    assert alike("Blue Harbour Regatta Day", "Harbour Regatta") >= 0.8


def test_text(spark):
    assert each(spark, ["<p>a&amp;b</p><script>x</script><p>c &#233;&#x41;</p>", "a<br>b", None], text.strip_tags) == ["a&b\nc éA", "a\nb", None]
    assert each(spark, ["x" * 10, "aa bb cc dd ee", "One. Two three four"], lambda v: text.truncate(v, 10)) == ["x" * 10, "aa bb cc…", "One. Two…"]
    assert each(spark, ["Crème Brûlée!", "MÉTIS ‘x’"], text.fold) == ["creme brulee!", "metis 'x'"]
    assert each(spark, ["  É, ok -- fine "], text.slugify) == ["e-ok-fine"]
    assert each(spark, ["HTTPS://www.X.org/a/?q=1#t", "http://x.org/a"], text.canonical_url) == ["x.org/a", "x.org/a"]
    venue, address = text.split_location(F.col("v"))
    rows = spark.createDataFrame([("Hall, 5 Main St, Tay",), ("Hall, upstairs",), ("",)], "v string").select(venue.alias("venue"), address.alias("address")).collect()
    assert [tuple(r) for r in rows] == [("Hall", "Hall, 5 Main St, Tay"), ("Hall, upstairs", None), (None, None)]


def test_folded_lines(spark):
    given = "é" * 100 + "end"
    out = each(spark, [given, "short"], feeds.fold_line)
    assert all(len(part.encode()) <= 75 for part in out[0].split("\r\n")) and out[0].replace("\r\n ", "") == given and out[1] == "short"
    assert each(spark, ["a;b,c\\d\ne"], feeds.escape_text) == ["a\\;b\\,c\\\\d\\ne"]


def test_image_headers(spark):
    webp = lambda kind, rest: b"RIFF\0\0\0\0WEBP" + kind + rest
    given = [b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big"), b"GIF89a" + (3).to_bytes(2, "little") + (4).to_bytes(2, "little"), webp(b"VP8X", b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")), webp(b"VP8 ", b"\0" * 10 + (320).to_bytes(2, "little") + (200).to_bytes(2, "little")), webp(b"VP8L", b"\0" * 4 + b"\x2f" + ((7 - 1) | (9 - 1) << 14).to_bytes(4, "little") + b"\0" * 8), b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08\0\x64\0\xc8" + b"\0" * 10, b"nothing", b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + b"\0" * 8, None]
    out = each(spark, [bytearray(g) if g is not None else None for g in given], images.image_size, "binary")
    assert [tuple(o) if o else None for o in out] == [(640, 480), (3, 4), (100, 50), (320, 200), (7, 9), (200, 100), None, None, None]
