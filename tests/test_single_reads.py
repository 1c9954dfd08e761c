"""Fields of payloads are read once, however often a rule around them looks at what was read."""

from __future__ import annotations

import pytest

from fairground.sources import columns

WINDOW = ("2026-01-01", "2026-12-31")


@pytest.mark.parametrize(("platform", "marks"), [("tribe", ["$.venue.zip", "$.venue.venue", "$.cost"]), ("sitefinity", ["$.Location", "$.Admission"]), ("ics", ["^DTSTART", "^LOCATION"])])
def test_a_field_is_read_once(spark, platform, marks):
    made = spark.createDataFrame([("s", platform, {}, 0, "{}")], "source_slug string, platform string, options map<string,string>, part int, payload string")
    plan = columns.parse(made, WINDOW, [platform])._jdf.queryExecution().optimizedPlan()
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    text = plan.toString()
    # The options of a line and its text are two reads of one line.
    assert {m: text.count(m) <= 2 if m.startswith("^") else text.count(m) == 1 for m in marks} == dict.fromkeys(marks, True), {m: text.count(m) for m in marks}
