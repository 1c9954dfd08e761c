"""Versions of a table: parts that are merged by levels, crashes at every step, what is swept; tiles of heavy days."""

from __future__ import annotations

import json
import os
import random

import pytest

from fairground import storage
from fairground.operators import pairs
from test_runs import listing, table


def rows(spark, *values):
    return spark.createDataFrame([(v, f"x{v}") for v in values], "k int, v string")


def state(spark, tmp_path, fanout=3, grace=86_400):
    kept = storage.Snapshots(spark, f"file://{tmp_path}/t", ["k"], buckets=2)
    kept.FANOUT, kept.GRACE = fanout, grace
    return kept


def test_a_pointer_stays_small_however_many_batches(spark, tmp_path):
    kept, sizes = state(spark, tmp_path), []
    for n in range(60):
        kept.append(rows(spark, n))
        newest = sorted(p for p in os.listdir(tmp_path / "t") if p.startswith("version-"))[-1]
        files = json.loads((tmp_path / "t" / newest).read_text())["files"]
        sizes.append(max(len(of) for of in files.values()))
        levels = [at for of in files.values() for _, at in of]
        assert all(levels.count(at) <= 2 * (kept.FANOUT - 1) for at in levels)
    assert max(sizes) <= 2 * 4 and sorted(r["k"] for r in kept.read().collect()) == list(range(60))
    named = {p.split("/")[0] for v in os.listdir(tmp_path / "t") if v.startswith("version-") for of in json.loads((tmp_path / "t" / v).read_text())["files"].values() for p, _ in of}
    assert {d for d in os.listdir(tmp_path / "t") if d.startswith("data-")} == named  # nothing else is left


@pytest.mark.parametrize("step", range(4))
def test_a_crash_at_any_step_loses_nothing(spark, tmp_path, monkeypatch, step):
    kept = state(spark, tmp_path, grace=0)
    for n in range(2):
        kept.append(rows(spark, n))
    real = {"_written": storage.Snapshots._written, "write": storage.write_bytes, "_forget": storage.Snapshots._forget}
    calls = []

    def crash(*a):
        raise OSError("the driver is gone")

    def second(*a):
        calls.append(a)
        return real["_written"](*a) if len(calls) < 2 else crash()

    def half(spark_, name, data, replace=True):
        real["write"](spark_, name, data[: len(data) // 2], replace)
        crash()

    what = [(storage.Snapshots, "_written", crash), (storage.Snapshots, "_written", second), (storage, "write_bytes", half), (storage.Snapshots, "_forget", crash)][step]
    with monkeypatch.context() as m:
        m.setattr(*what)
        with pytest.raises(OSError):
            kept.append(rows(spark, 0, 2, 4, 6))
    after = state(spark, tmp_path, grace=0)
    assert sorted(r["k"] for r in after.read().collect()) == ([0, 0, 1, 2, 4, 6] if step == 3 else [0, 1])
    for n in (7, 8, 9):
        after.append(rows(spark, n))
    assert sorted(r["k"] for r in after.read().collect()) == ([0, 0, 1, 2, 4, 6] if step == 3 else [0, 1]) + [7, 8, 9]
    named = {p.split("/")[0] for v in os.listdir(tmp_path / "t") if v.startswith("version-") for of in (json.loads((tmp_path / "t" / v).read_text()) if (tmp_path / "t" / v).read_text().endswith("\n") else {"files": {}})["files"].values() for p, _ in of}
    assert {d for d in os.listdir(tmp_path / "t") if d.startswith("data-")} == named


def test_a_heavy_day_meets_in_tiles(spark):
    rng, found = random.Random(6), []
    for i in range(160):
        more = {"municipality_slug": rng.choice(["tay", "tay", "tiny", None]), "source_slug": f"s{i % 5}", "address": rng.choice([None, "5 Main St", "9 Elm St"])}
        if i % 2:
            day = rng.randrange(1, 28)
            more |= {"local_date": f"2026-07-{day:02d}", "starts_at": f"2026-07-{day:02d} 23:00:00"}
        if i % 9 == 0:
            more["ends_at"] = "2026-07-05 03:00:00"
        found.append(listing(i, id=f"s{i % 5}:{i:03d}", **more))
    df = table(spark, found)
    got = [sorted((r["a_id"], r["b_id"]) for r in pairs.candidate_pairs(df, tile).select("a_id", "b_id").collect()) for tile in (7, 10**6)]
    assert got[0] == got[1] and len(set(got[0])) == len(got[0]) > 500 and all(a < b for a, b in got[0])
    sizes = [(r["a_id"], r["b_id"], r["a_title"], r["b_local_date"]) for r in pairs.candidate_pairs(df, 7).collect()]
    assert len(sizes) == len(got[0])
