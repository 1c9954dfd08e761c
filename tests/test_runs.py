"""Pairs, clusters, reconciliation and runs on small tables, against brute force and invariants."""

from __future__ import annotations

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fairground.operators import filters, pairs, reconcile
from fairground.operators.graph import components
from fairground.plans.runs import deduplicate, ingest
from fairground.sources import columns
from fairground.sources.adapters import ADAPTERS, drupal_detail, govstack_detail, raw_events
from fairground.storage import Snapshots
from fairground.streaming import incremental

WINDOW = ("2026-06-01", "2026-12-31")


def listing(i, **more):
    row = {"id": f"s{i}:{i}", "source_slug": f"s{i}", "source_kind": "media", "external_id": str(i), "municipality_slug": "tay", "title": "Harbour Jazz Night", "description": None, "category": "music", "source_categories": [], "starts_at": "2026-07-01 23:00:00", "ends_at": None, "local_date": "2026-07-01", "local_time": "19:00", "timezone": "America/Toronto", "time_precision": "exact", "all_day": False, "venue_name": None, "address": None, "cost": "unknown", "cost_text": None, "organizer": None, "image_url": None, "url": f"https://x/{i}", "status": "scheduled", "active": True, "content_hash": f"h{i}", "cluster_id": None}
    return row | more


SCHEMA = "id string, source_slug string, source_kind string, external_id string, municipality_slug string, title string, description string, category string, source_categories array<string>, starts_at string, ends_at string, local_date string, local_time string, timezone string, time_precision string, all_day boolean, venue_name string, address string, cost string, cost_text string, organizer string, image_url string, url string, status string, active boolean, content_hash string, cluster_id string"


def table(spark, rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("starts_at", "ends_at")})


def test_components_match_brute_force(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_pairs_gate_and_score(spark):
    rows = [listing(1), listing(2, url="https://www.x/1/?s=2"), listing(3, municipality_slug="tiny"), listing(4, municipality_slug=None), listing(5, municipality_slug="tiny", address="5 Main St", starts_at="2026-07-01 23:00:00"), listing(6, address="5 Main Street"), listing(7, active=False), listing(8, local_date="2026-06-29", ends_at="2026-07-02 03:00:00"), listing(9, id="s1:9", source_slug="s1", starts_at="2026-07-02 02:00:00")]
    scored = {(r["a"], r["b"]): r for r in pairs.score_pairs(pairs.candidate_pairs(table(spark, rows))).collect()}
    assert ("s1:1", "s2:2") in scored and ("s1:1", "s3:3") not in scored and ("s3:3", "s4:4") in scored
    assert ("s5:5", "s6:6") in scored and scored["s5:5", "s6:6"]["same_place"] and not any("s7:7" in k for k in scored)
    assert ("s1:1", "s1:9") not in scored and scored["s1:1", "s8:8"]["score"] <= 0.84
    assert all(a < b and 0 <= r["score"] <= 1 for (a, b), r in scored.items())


def test_runs_are_a_fixed_point(spark):
    rows = [listing(1, description="long", ends_at="2026-07-02 01:00:00"), listing(2, cost="free", venue_name="Hall", status="cancelled"), listing(3, municipality_slug="tiny"), listing(4, title="Pottery Class")]
    priorities = spark.createDataFrame([("s1", 10), ("s2", 50)], "source_slug string, priority int")
    nothing = spark.createDataFrame([], "a string, b string, hash_a string, hash_b string, verdict string, method string")
    none = spark.createDataFrame([], "id string, created_at timestamp")
    first = deduplicate(table(spark, rows), priorities, none, nothing, spark.createDataFrame([("s1:1", '{"title":"Renamed","organizer":null}')], "id string, fields string"))
    events = {r["id"]: r for r in first.events.collect()}
    assert set(events) == {"s1:1", "s3:3", "s4:4"}
    one = events["s1:1"]
    assert one["title"] == "Renamed" and one["cost"] == "free" and one["venue_name"] == "Hall" and one["status"] == "cancelled" and one["listing_ids"] == ["s1:1", "s2:2"]
    known = [r | {"cluster_id": c} for r, c in zip(rows, ["s1:1", "s1:1", "s3:3", "s4:4"], strict=True)]
    existing = spark.createDataFrame([(e,) for e in [*events, "gone"]], "id string").withColumn("created_at", F.lit("2026-01-01").cast("timestamp"))
    second = deduplicate(table(spark, known), priorities, existing, first.decisions)
    assert second.assignments.count() == 0 and [r["id"] for r in second.closed.collect()] == ["gone"]
    stats = second.stats.first()
    assert stats["pairs"] == stats["cached"] + stats["ambiguous"] and stats["cached"] > 0


def test_reconcile_refuses_empty_batches(spark):
    rows = table(spark, [listing(1), listing(2)])
    plan = {r["id"]: r["action"] for r in reconcile.plan(rows.where("source_slug = 's1'"), rows).collect()}
    assert plan == {"s1:1": "unchanged", "s2:2": "refused"}
    moved = table(spark, [listing(1, starts_at="2026-07-02 00:00:00")])
    decided = reconcile.plan(moved, rows.where("source_slug = 's1'")).first()
    assert decided["changes"] == ["starts_at"] and decided["next_status"] == "rescheduled"


def test_snapshots_and_streams(spark, tmp_path):
    state = Snapshots(spark, f"file://{tmp_path}/state", ["source_slug"])
    assert state.read() is None
    rows = table(spark, [listing(1), listing(2)]).drop("cluster_id")
    rows.write.parquet(f"{tmp_path}/in/one")
    stream = lambda: spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    incremental.reconcile_stream(stream(), state, f"file://{tmp_path}/check", lambda n: f"2026-01-0{n + 1}").awaitTermination()
    assert state.read().where("active").count() == 2
    table(spark, [listing(1, content_hash="new", title="Other")]).drop("cluster_id").write.parquet(f"{tmp_path}/in/two")
    incremental.reconcile_stream(stream(), state, f"file://{tmp_path}/check", lambda n: f"2026-01-0{n + 1}").awaitTermination()
    after = {r["id"]: r for r in state.read().collect()}
    assert after["s1:1"]["title"] == "Other" and str(after["s1:1"]["first_seen_at"])[:10] == "2026-01-01" and after["s2:2"]["active"]


def test_a_crash_between_files_and_pointer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    from fairground import storage

    state = Snapshots(spark, f"file://{tmp_path}/state", ["k"], buckets=4)
    table = lambda rows: spark.createDataFrame(rows, "k long, v string")
    state.write(table([(i, "old") for i in range(20)]))
    touched = state.touched(table([(3, "")]))
    beside = {r["k"] for r in state.read(touched).collect()} - {3}

    def crash(*_, **__):
        raise OSError("gone")

    with monkeypatch.context() as broken:
        broken.setattr(storage, "write_bytes", crash)
        with pytest.raises(OSError):
            state.replace(table([(3, "new")]), touched)
    with open(f"{tmp_path}/state/version-{2:012d}", "w") as half:  # a pointer that was not finished
        half.write('{"number": 2, "sch')
    assert state.current() == 1 and state.read().where("v = 'old'").count() == 20
    state.replace(table([(3, "new"), *((k, "kept") for k in beside)]), touched)
    assert {r["k"]: r["v"] for r in state.read().collect()} == {i: "new" if i == 3 else "kept" if i in beside else "old" for i in range(20)}
    for k in range(5):
        state.append(table([(100 + k, "more")]))
    assert state.read().count() == 25 and len(state._pointers()) <= Snapshots.KEPT + 2
    state.write(table([]))
    assert state.read().count() == 0 and state.read().columns == ["k", "v"]


def test_filters_round_trip():
    f = filters.Filters.parse("?m=tay,nowhere,unspecified&cat=music&cost=free&civic=1&from=2026-01-01&to=bad&q=%22a b%22%20%20Caf%C3%A9&since=2026-13-01")
    assert f.saved() == "m=tay%2Cunspecified&cat=music&cost=free&civic=1&from=2026-01-01&q=%22a+b%22+Caf%C3%A9" and f.since is None
    assert filters.search_terms('"Farmers Market" CAFÉ café x y z w') == ["farmers market", "cafe", "x", "y", "z"]


def test_ingest_isolates_failures(spark):
    feed = lambda *uids: "BEGIN:VCALENDAR\n" + "".join(f"BEGIN:VEVENT\nUID:{u}\nDTSTART:20260701T230000Z\nSUMMARY:Jazz Night\nEND:VEVENT\n" for u in uids) + "END:VCALENDAR"
    made = spark.createDataFrame([("good", "ics", {"timezone": "America/Toronto"}, 0, feed("a", "b", "a")), ("bad", "ics", {}, 0, "<html>"), ("empty", "tribe", {}, 0, '{"events":[]}')], "source_slug string, platform string, options map<string,string>, part int, payload string")
    sources = spark.createDataFrame([(s, "media", None, "America/Toronto") for s in ("good", "bad", "empty")], "slug string, kind string, municipality_slug string, timezone string")
    stored = incremental.with_cursors(table(spark, [listing(1, id="bad:1", source_slug="bad"), listing(2, id="empty:2", source_slug="empty"), listing(3, id="good:c", source_slug="good", external_id="c")]).drop("cluster_id"))
    done = ingest(made, WINDOW, sources, stored, "2026-06-01", ["ics", "tribe"])
    state = {r["id"]: r["active"] for r in done.listings.collect()}
    assert state == {"bad:1": True, "empty:2": True, "good:a": True, "good:b": True, "good:c": False}
    assert [r["source_slug"] for r in done.failed.collect()] == ["bad"] and done.skipped.first()["reason"] == "duplicate external id in batch"


PAYLOADS = {
    "eventbrite": ({"events": {"results": [{"id": "1", "name": " Show ", "url": "u", "start_date": "2026-07-01", "start_time": "19:00:00", "is_cancelled": True, "primary_venue": {"name": "Hall", "address": {"city": "Barrie"}}, "ticket_availability": {"is_free": False, "minimum_ticket_price": {"major_value": "30.00"}, "maximum_ticket_price": {"major_value": "45.50"}}, "tags": [{"prefix": "EventbriteCategory", "display_name": "Music"}]}, {"id": "2", "name": "x", "url": "u", "start_date": "2026-07-01", "is_online_event": True}]}}, {"title": "CANCELLED: Show", "cost_text": "$30–$45.50", "local_start": "2026-07-01T19:00", "categories": ["Music"], "is_free": False}),
    "ticketmaster": ({"_embedded": {"events": [{"id": "t", "name": "Band", "url": "u", "dates": {"start": {"localDate": "2026-07-01", "localTime": "20:00:00"}, "status": {"code": "rescheduled"}}, "priceRanges": [{"min": 0}, {"min": 20, "max": 35.5}], "images": [{"ratio": "16_9", "width": 2048, "url": "big"}, {"ratio": "16_9", "width": 1024, "url": "fit"}], "classifications": [{"segment": {"name": "Music"}, "genre": {"name": "Undefined"}}], "_embedded": {"venues": [{"name": "Arena", "city": {"name": "Barrie"}, "address": {"line1": "1 Ice Rd"}}]}}]}}, {"title": "RESCHEDULED: Band", "cost_text": "$20–$35.50", "image_url": "fit", "address": "1 Ice Rd, Barrie", "categories": ["Music"]}),
    "cityspark": ({"Success": True, "Value": [{"PId": 5, "Name": "Fête!", "DateStart": "2026-07-01T19:00:00Z", "DateEnd": "2026-07-01T21:00:00Z", "HasTime": True, "Free": True, "CityState": "Orillia, ON"}]}, {"local_start": "2026-07-01T19:00", "local_end": "2026-07-01T21:00", "cost_text": "Free", "municipality_hint": "Orillia", "url": "https://p/#/details/fete/5"}),
    "sitefinity": ({"value": [{"Id": "g", "Title": "Fest", "EventStartWithOffset": "2026-07-01T00:00:00-04:00", "EventEndWithOffset": "2026-07-03T00:00:00-04:00", "AllDayEvent": True, "Location": "Park", "Street": "5 Elm", "City": "Barrie", "ItemDefaultUrl": "/x"}]}, {"local_start": "2026-07-01T00:00", "local_end": "2026-07-02T23:59", "venue_name": "Park", "address": "Park, 5 Elm, Barrie"}),
    "growthzone": ('<?xml version="1.0"?><ArrayOfEventDisplay xmlns="http://x"><EventDisplay><EventID>7</EventID><Name>Mixer &amp; More</Name><Status>APPROVED</Status><StartDate>2026-07-01T17:00:00</StartDate><EndDate>2026-07-01T19:00:00</EndDate><Slug>mixer</Slug><AdmissionDesc>&lt;h3&gt;Vendor fee $50&lt;/h3&gt;</AdmissionDesc><MapAddr1>1 Bay St</MapAddr1><MapCity>Barrie</MapCity></EventDisplay><EventDisplay><EventID>8</EventID><Status>PENDING</Status></EventDisplay></ArrayOfEventDisplay>', {"title": "Mixer & More", "address": "1 Bay St, Barrie", "cost_text": None, "url": "https://p/events/details/mixer-7"}),
    "tixhub": ({"index": "<table><tr><td>Multiple Dates</td><td></td><td><a href='b_otix.asp?cboPerformances=1&amp;cboEvent=9&amp;bmultiple=1'>Play</a></td><td>Opera House</td></tr></table>", "runs": {"9": '<option value="11">Wednesday, July 1, 2026 - 7:30 PM</option>'}}, {"external_id": "11", "local_start": "2026-07-01T19:30", "venue_name": "Opera House", "is_free": False}),
    "mat-film-nights": ("<div><h2>Big Film</h2><p>Wednesday, July 1, 2026 (4pm, 7:30 pm)</p><p>About it.</p></div>", {"external_id": "2026-07-01-1600-big-film", "title": "MAT Film Night: Big Film", "description": "About it."}),
    "spaces": ({"cards": '<div class="card card-body" data-id="3" data-page="1"><a href="/e/3" class="x event-details"></a><span class="short-post">Sale</span>IN <a href="/markets">Markets</a><button>b</button><div><div>Jul 1 9:30 AM - Jul 2 5:00 PM</div></div></div>', "details": {"3": '<div id="post" class="card"><div class="card-body"><p>Where: Town Hall</p><p>Cost: $5</p></div></div>'}}, {"external_id": "3@2026-07-01", "local_start": "2026-07-01T09:30", "local_end": "2026-07-02T17:00", "venue_name": "Town Hall", "cost_text": "$5", "categories": ["Markets"]}),
    "eventon": ({"post": {"id": 4, "link": "u", "title": {"rendered": "A &#8211; B"}, "event_type": [1, 2]}, "types": {"1": "Fun"}, "page": '<script type="application/ld+json">{"@type":"Event","startDate":"2026-7-1T9:05-4:00","endDate":"2026-7-1T23:00"}</script><div data-location_name="Hall"></div>'}, {"external_id": "4", "title": "A – B", "local_start": "2026-07-01T09:05", "categories": ["Fun"], "venue_name": "Hall"}),
    "drupal-events": ('<script type="application/json" data-drupal-selector="drupal-settings-json">' + json.dumps({"fullCalendarView": [{"calendar_options": json.dumps({"events": [{"title": "<span class='fc-time'>7p</span>Walk", "url": "/w", "start": "2026-07-01", "end": "2026-07-03"}]})}]}) + "</script>", {"external_id": "/w@2026-07-01T00:00", "title": "Walk", "local_end": "2026-07-02T23:59", "all_day": True}),
}


PAYLOADS |= {
    "tribe": ({"events": [{"id": 4, "title": "Jazz &#8211; Fun &amp; <b>more</b>", "start_date": "2026-07-01 19:00:00", "url": "u", "venue": [], "image": False, "organizer": [{"organizer": "Club"}], "categories": [{"name": "Music"}, {"name": ""}], "description": "<p>One</p><p>&#38;lt; two&nbsp;three</p><script>x</script>"}, {"id": 5, "title": "h", "start_date": "2026-07-01", "url": "u", "hide_from_listings": True}]}, {"external_id": "4", "title": "Jazz – Fun & more", "description": "One\n< two three", "venue_name": None, "image_url": None, "organizer": "Club", "categories": ["Music"], "time_precision": "exact"}),
    "communico": ([{"id": 3, "title": " Craft ", "sub_title": "Part 2", "event_start": "2026-07-01 10:00:00", "registration_cost": "0", "enable_billing": "0", "location": "Main", "image": "a.png", "tagsArray": [" Kids ", ""]}, {"id": 4, "title": "x", "event_start": "y", "location": "Online"}], {"title": "Craft — Part 2", "cost_text": "Free", "is_free": True, "venue_name": "Main", "categories": ["Kids"], "url": "https://https://p/event/3"}),
    "ics": ("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:9\r\nDTSTART;VALUE=DATE:20260701\r\nDTEND;VALUE=DATE:20260703\r\nSUMMARY:Fair\\, big\r\n  one\r\nLOCATION:Hall\\, 5 Elm St\r\nCATEGORIES:Art, Music\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nDTSTART:20260701T000000Z\r\nEND:VEVENT\r\nEND:VCALENDAR", {"external_id": "9", "title": "Fair, big one", "local_start": "2026-07-01T00:00", "local_end": "2026-07-02T23:59", "venue_name": "Hall", "address": "Hall, 5 Elm St", "categories": ["Art", "Music"], "all_day": True}),
    "cfmws": ('<script>var a = "["; var loadedData = [{"event_name": "Swim ]", "event_startdate": "2026-07-01 9:30:00 a.m.", "event_enddate": "2026-07-01 11:00 PM", "event_demo": "All", "event_externalurl": "/s"}, {"event_name": "v", "event_virtual": true}]; draw(loadedData)</script>', {"external_id": "/s@2026-07-01", "title": "Swim ]", "local_start": "2026-07-01T09:30", "local_end": "2026-07-01T23:00", "categories": [], "url": "https://p/s"}),
}


def payload_table(spark, *rows):
    return spark.createDataFrame(list(rows), "source_slug string, platform string, options map<string,string>, part int, payload string")


def test_adapters_of_documents_and_pages(spark):
    """Each platform's first row, all platforms in one table: columns and Python together."""
    text = lambda p: p if isinstance(p, str) else json.dumps(p)
    made = payload_table(spark, *[(k, k, {"origin": "https://p", "timezone": "America/Toronto"}, 0, text(p)) for k, (p, _) in PAYLOADS.items()])
    rows, failed = raw_events(made, WINDOW)
    first = {}
    for r in rows.orderBy("source_slug", "position").collect():
        first.setdefault(r["source_slug"], r.asDict())
    assert failed.collect() == [] and first.keys() == PAYLOADS.keys()
    for k, (_, want) in PAYLOADS.items():
        assert {f: first[k][f] for f in want} == want


def test_documents_that_fail_add_only_their_error(spark):
    bad = [("not json", "tribe"), ('{"events": {}}', "tribe"), ('{"events": [{"id": 1, "title": "t", "start_date": "2026-07-01"}]}', "tribe"), (None, "communico"), ('{"Success": false, "ErrorMessage": "busy"}', "cityspark"), ('{"value": [{"Id": 1, "Title": "t", "EventStartWithOffset": "2026-07-01T10:00", "IsRecurrent": true}]}', "sitefinity"), ("<html>", "growthzone"), ("<ArrayOfEventDisplay><EventDisplay>", "growthzone"), ("<html>", "cfmws"), ("", "ics"), ('{"1": "x"}', "libcal"), ("x", "unknown")]
    fine = [('{"events": []}', "tribe"), ("[]", "communico"), ('{"page": {}}', "ticketmaster"), ('{"Success": true}', "cityspark"), ("<ArrayOfEventDisplay/>", "growthzone"), ("BEGIN:VCALENDAR\nEND:VCALENDAR", "ics")]
    rows, failed = raw_events(payload_table(spark, *[(f"{i}", p, {}, 0, x) for i, (x, p) in enumerate(bad + fine)]), WINDOW)
    assert rows.count() == 0 and sorted(int(r["source_slug"]) for r in failed.collect()) == list(range(len(bad)))
    assert failed.where("source_slug = '4'").first()["error"] == "busy"


def test_first_copies_and_calendars_of_a_library(spark):
    copies = {"Success": True, "Value": [{"PId": k % 3, "Name": f"n{k}", "DateStart": "2026-07-01T19:00:00", "CityState": "Barrie, ON"} for k in range(9)]}
    feed = lambda *uids: "BEGIN:VCALENDAR\n" + "".join(f"BEGIN:VEVENT\nUID:{u}\nDTSTART:20260701T190000\nSUMMARY:{u}\nEND:VEVENT\n" for u in uids) + "END:VCALENDAR"
    made = payload_table(spark, ("c", "cityspark", {}, 0, json.dumps(copies)), ("l", "libcal", {"calendars": "2, 1"}, 0, json.dumps({"1": feed("a", "b"), "2": feed("b", "c"), "3": feed("d")})), ("m", "libcal", {"calendars": "2,9"}, 0, json.dumps({"2": feed("b")})))
    rows, failed = raw_events(made, WINDOW, ["cityspark", "libcal"])
    got = [(r["source_slug"], r["title"]) for r in rows.orderBy("source_slug", "position").collect()]
    assert got == [("c", "n0"), ("c", "n1"), ("c", "n2"), ("l", "b"), ("l", "c"), ("l", "a")] and [r["source_slug"] for r in failed.collect()] == ["m"]


def test_documents_are_read_without_python(spark):
    made = payload_table(spark, ("s", "tribe", {}, 0, '{"events": []}'))
    assert "Python" not in columns.parse(made, WINDOW, ["tribe"])._jdf.queryExecution().executedPlan().toString()


def test_rows_and_details():
    rows = list(ADAPTERS["drupal-events"]('<div class="views-row"><div class="views-field-title"><a href="/a?b=1&amp;c">T</a></div><time datetime="2026-07-01T10:00:00-04:00"></time><time datetime="2026-07-01T12:00:00-04:00"></time></div>', {"mode": "rows", "origin": "https://p"}, WINDOW))
    assert rows[0]["external_id"] == "/a?b=1&c@2026-07-01T10:00" and rows[0]["local_end"] == "2026-07-01T12:00"
    assert govstack_detail('<div class="icrt-calendarContentDetail"><div id="tx_more"><p>All of it</p><button>less</button></div><img id="event_image" src="/i.png"></div>', "h.ca") == {"description": "All of it", "image_url": "https://h.ca/i.png"}
    assert drupal_detail('<article class="node--view-mode-full"><div class="field field--name-body"><div class="field__item">Hi</div></div><div class="field field--name-field-cost"><div class="field__item">$5</div></div></article>', "https://p") == {"description": "Hi", "cost_text": "$5", "image_url": None}


def test_runaway_series_are_dropped(spark):
    days = pd.date_range("2026-06-01", periods=95).strftime("%Y-%m-%d %H:%M:%S")
    body = json.dumps({"events": [{"id": i, "title": "Daily", "start_date": d, "url": "u"} for i, d in enumerate(days)] + [{"id": 999, "title": "Once", "start_date": "2026-07-01 10:00:00", "url": "u"}]})
    made = spark.createDataFrame([("s", "tribe", {}, 0, body)], "source_slug string, platform string, options map<string,string>, part int, payload string")
    assert [r["title"] for r in raw_events(made, WINDOW, ["tribe"])[0].collect()] == ["Once"]
