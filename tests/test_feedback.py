"""Decisions with feedback, ranks, pages, batches and constrained clusters against sequential brute force."""

from __future__ import annotations

import random
import time
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fairground.operators import clusters, feedback, judging, pairs, ranks
from fairground.operators.constrained import constrained_components

BEGIN = datetime(2026, 1, 1)


def at(seconds):
    return BEGIN + timedelta(seconds=seconds)


def fold(edges, town):
    """Groups by going through (a, b, score, same_place) one after another."""
    root, own = {x: x for e in edges for x in e[:2]}, dict(town)

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b, _, same in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        a, b = find(a), find(b)
        if a == b or (own[a] and own[b] and own[a] != own[b] and not same):
            continue
        low, high = sorted((a, b))
        own[low], root[high] = own[a] or own[b], low
    return {x: find(x) for x in root}


def graph(rng, name):
    ids = [f"{name}-{i:03d}" for i in range(rng.randrange(2, 13))]
    rng.shuffle(ids)
    town = {i: rng.choice(rng.choice(([None, "p", "q", "r"], [None, "p"], ["", "p", "q"]))) for i in ids}
    rate, scores, path = rng.choice((0, 0, 0.1, 0.5, 1)), rng.choice(([1.0], [0.7, 0.8, 0.9], [rng.random() for _ in range(50)])), rng.random() < 0.3
    edges = {}
    for _ in range(rng.randrange(1, 3 * len(ids))):
        at_ = rng.randrange(len(ids) - 1)
        a, b = sorted((ids[at_], ids[at_ + 1]) if path else rng.sample(ids, 2))
        edges[a, b] = (a, b, rng.choice(scores), rng.random() < rate)
    return list(edges.values()), town


def constrained(spark, edges, town):
    out = constrained_components(spark.createDataFrame(list(town.items()), "id string, town string"), spark.createDataFrame(edges, "a string, b string, score double, same_place boolean"))
    return {r["id"]: r["root"] for r in out.collect()}


def test_constrained_rounds_equal_the_fold(spark):
    rng, edges, town, want = random.Random(11), [], {}, {}
    for g in range(2000):
        some, towns = graph(rng, f"{g:04d}")
        edges, town, want = edges + some, town | towns, want | fold(some, towns)
    assert constrained(spark, edges, town) == want


def test_a_long_chain_of_towns(spark):
    rng, n = random.Random(3), 100_000
    ids = [f"{i:06d}" for i in range(n)]
    town = {i: rng.choice((None, "p", "q", "r")) for i in ids}
    edges = [(a, b, 1.0, rng.random() < 0.3) for a, b in zip(ids, ids[1:], strict=False)]
    assert constrained(spark, edges, town) == fold(edges, town)


def test_cluster_roots_guard_towns(spark):
    listings = spark.createDataFrame([("a", "tay"), ("b", "tiny"), ("u", None), ("v", None), ("w", "tay"), ("x", "tay")], "id string, municipality_slug string")
    edges = [("a", "u", 0.95, False), ("b", "u", 0.9, False), ("a", "b", 0.86, False), ("w", "x", 0.9, False)]
    out = {r["id"]: r["root"] for r in clusters.cluster_roots(listings, spark.createDataFrame(edges, "a string, b string, score double, same_place boolean")).collect()}
    assert out == {"a": "a", "u": "a", "b": "b", "v": "v", "w": "w", "x": "w"}
    edges[2] = ("a", "b", 0.86, True)
    out = {r["id"]: r["root"] for r in clusters.cluster_roots(listings, spark.createDataFrame(edges, "a string, b string, score double, same_place boolean")).collect()}
    assert out["a"] == out["b"] == out["u"] == "a"


def brute_limit(rows, most, span, stored=()):
    taken = defaultdict(list)
    for k, t in stored:
        taken[k].append(t)
    out = {}
    for i, k, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        out[i] = sum(1 for x in taken[k] if t - timedelta(seconds=span) < x <= t) < most
        if out[i]:
            taken[k].append(t)
    return out


@pytest.mark.parametrize("most", [1, 3, 5])
def test_a_limit_counts_what_was_taken(spark, most):
    rng = random.Random(most)
    rows = [(f"{i:05d}", rng.choice(["busy", "busy", "busy", "a", "b", None]), at(rng.randrange(40_000))) for i in range(1500)]
    rows += [(f"x{i}", "steady", at(i * 700)) for i in range(120)] + [("y1", "a", None)]
    df = spark.createDataFrame(rows, "id string, sender string, sent timestamp")
    out = {r["id"]: r["accepted"] for r in feedback.greedy_limit(df, "sender", "sent", "id", most).collect()}
    assert out == brute_limit(rows, most, 3600) | {"y1": False}


def test_a_limit_in_batches_is_the_limit_of_all(spark):
    rng = random.Random(9)
    rows = sorted([(f"{i:05d}", rng.choice(["a", "b"]), at(rng.randrange(30_000))) for i in range(400)], key=lambda r: (r[2], r[0]))
    schema, stored, out = "id string, sender string, sent timestamp", [], {}
    for low in range(0, 400, 100):
        batch = spark.createDataFrame(rows[low : low + 100], schema)
        for r in feedback.greedy_limit(batch, "sender", "sent", "id", 2, stored=spark.createDataFrame(stored, "sender string, sent timestamp")).collect():
            out[r["id"]] = r["accepted"]
            stored += [(r["sender"], r["sent"])] * r["accepted"]
    assert out == brute_limit(rows, 2, 3600)


def test_rows_equal_in_everything_count_each(spark):
    df = spark.createDataFrame([("i", "s", at(0))] * 7 + [("j", "t", at(5))], "id string, sender string, sent timestamp")
    assert Counter((r["id"], r["accepted"]) for r in feedback.greedy_limit(df, "sender", "sent", "id", 5).collect()) == {("i", True): 5, ("i", False): 2, ("j", True): 1}
    assert feedback.greedy_limit(df.limit(0), "sender", "sent", "id", 5).count() == 0


def test_caps_count_replays_once(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), f"e{rng.randrange(30)}", at(i // 2), i) for i in range(300)] + [(None, "e", at(1), 1), ("a", None, at(1), 1), ("a", "z", None, 1)]
    stored, want = set(), set()
    for low in (0, 100, 200):
        for u, e, _, _ in sorted((r for r in rows[low : low + 100] if None not in r), key=lambda r: (r[2], r[1])):
            if (u, e) not in want and sum(x == u for x, _ in want) < 12:
                want.add((u, e))
        had = spark.createDataFrame(sorted(stored), "user string, event string")
        asked = spark.createDataFrame(rows[low : low + 100] + rows[:3], "user string, event string, at timestamp, n int")
        stored |= {(r["user"], r["event"]) for r in feedback.capped(had, asked, "user", "event", "at", 12).collect()}
    assert stored == want and max(Counter(u for u, _ in stored).values()) == 12


def brute_sessions(rows, idle, absolute, touch):
    by = defaultdict(list)
    for u, t in rows:
        if u is not None and t is not None:
            by[u].append(t)
    out = []
    for u, times in by.items():
        start = seen = None
        for t in sorted(times):
            if start is None or t >= start + timedelta(seconds=absolute) or t >= seen + timedelta(seconds=idle):
                if start is not None:
                    out[-1][4] = "age" if t >= start + timedelta(seconds=absolute) else "idle"
                start = seen = t
                out.append([u, t, t, 1, None])
            else:
                out[-1][2], out[-1][3] = t, out[-1][3] + 1
                if seen + timedelta(seconds=touch) < t:
                    seen = t
    return Counter(map(tuple, out))


@pytest.mark.parametrize(("idle", "absolute", "touch"), [(9000, 30_000, 3600), (4000, 500_000, 3600), (40_000, 50_000, 100)])
def test_sessions_with_an_age_limit(spark, idle, absolute, touch):
    rng = random.Random(idle)
    rows = [(rng.choice([1, 1, 1, 2, 3]), at(rng.choice((rng.randrange(600_000), 3600 * rng.randrange(100))))) for _ in range(700)] + [(7, at(5)), (None, at(6)), (7, None), (7, at(5))]
    out = feedback.limited_sessions(spark.createDataFrame(rows, "user long, at timestamp"), "user", "at", idle, absolute, touch)
    assert Counter(map(tuple, out.collect())) == brute_sessions(rows, idle, absolute, touch)


def test_ranks_and_pages(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["x", "x", "x", "y", None]), rng.randrange(50)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, part string, v int")
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    got = {r["id"]: r["rank"] for r in ranks.global_ranks(df, ["v", "id"], slices=7).collect()}
    assert got == {r[0]: n for n, r in enumerate(order)}
    for number in (0, 3, 49, 50):
        found = sorted(ranks.page(df, ["v", "id"], number, 10, slices=7).collect(), key=lambda r: r["rank"])
        assert [r["id"] for r in found] == [r[0] for r in order[number * 10 : number * 10 + 10]]
    within = defaultdict(list)
    for r in order:
        within[r[1]].append(r[0])
    got = {r["id"]: r["rank"] for r in ranks.ranks_within(df, "part", ["v", "id"], slices=7).collect()}
    assert got == {i: n for ids in within.values() for n, i in enumerate(ids)}
    assert ranks.global_ranks(df.limit(0), ["id"]).count() == 0 and ranks.page(df.limit(0), ["id"], 0, 5).count() == 0


def test_a_failed_batch_leaves_only_its_pairs_open(spark):
    def third_fails(batch):
        if batch[0]["batch"] % 3 == 2:
            raise TimeoutError("no answer")
        return [None if p["n"] % 7 == 0 else "same" if p["n"] % 2 else "distinct" for p in batch]

    rows = [(f"a{i:03d}", f"b{i:03d}", i) for i in range(73)]
    df = spark.createDataFrame(rows, "a string, b string, n int").repartition(5)
    out = {r["a"]: r for r in judging.judge_batches(df, third_fails, budget=6).collect()}
    for a, _, n in rows:
        want = "over budget" if n >= 60 else "failed" if n // 10 % 3 == 2 else "no answer" if n % 7 == 0 else "answered"
        assert (out[a]["batch"], out[a]["outcome"]) == (n // 10, want) and (out[a]["verdict"] is not None) == (want == "answered")
    decided = df.select("a", "b", "n", F.lit("ambiguous").alias("verdict"), F.lit("rule").alias("method"), F.lit(False).alias("cached"))
    judged = pairs.judge_ambiguous(decided, judging.batched(third_fails, "fake"))
    assert Counter((r["verdict"], r["method"]) for r in judged.collect())["ambiguous", "rule"] == sum(n // 10 % 3 == 2 or n % 7 == 0 for n in range(73))
    assert judging.judge_batches(df.limit(0), third_fails).count() == 0
    short = judging.judge_batches(df, lambda batch: ["same"] * 9)  # a verdict too few
    assert {r["outcome"] for r in short.collect()} == {"failed"}


def test_a_stream_ends_sessions_by_touches_and_by_time(spark, tmp_path):
    from fairground.streaming import incremental

    rng = random.Random(3)
    rows = sorted(((rng.choice([1, 1, 2, 3]), at(rng.randrange(300_000))) for _ in range(150)), key=lambda r: r[1]) + [(9, at(2_000_000))]
    for n in range(3):  # a file a batch, in the order of time
        spark.createDataFrame(rows[n * 51 : n * 51 + 51], "user long, at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("user long, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        ended = incremental.limited_sessions(stream, "user", "at", 9000, 30_000, 3600)
        out = incremental.drain(ended, "append", spark, f"{tmp_path}/out", f"{tmp_path}/state").collect()
    finally:
        spark.conf.unset(store)
    want = Counter(k[:4] for k in brute_sessions(rows, 9000, 30_000, 3600) if k[0] != 9)  # the last one is still open
    assert Counter((int(r["key"]), r["started_at"], r["last_at"], r["touches"]) for r in out) == want
    assert {r["ended_by"] for r in out} == {"age", "idle"}
