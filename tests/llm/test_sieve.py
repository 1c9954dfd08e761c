"""Texts that a join would not keep are left out before its shuffle, and no other."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from fairground.llm import common, minhash, near


def test_a_sieve_keeps_all_that_is_wanted_and_little_else(spark, monkeypatch):
    rows = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("key"), "id", F.lit("x").alias("_text"))
    wanted = rows.where("id % 50 = 0").select("key")
    for most, passed in ((common.SIEVE_MOST, 3_000), (1 << 6, 20_000)):
        monkeypatch.setattr(common, "SIEVE_MOST", most)
        out = common.sifted(rows, "key", wanted)
        assert out.columns == rows.columns and out.join(wanted, "key").count() == 400
        assert out.count() == out.distinct().count() <= passed
    assert common.sifted(rows, "key", wanted.limit(0)).count() == 0


def documents(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(40)) for _ in range(300)]
    return spark.createDataFrame([*enumerate(texts), *((1000 + i, texts[i] + " more") for i in range(5))], "doc_id long, text string")


def passing(monkeypatch, module):
    """Numbers of texts before and after each sieve of that module."""
    seen = []

    def sifted(rows, key, wanted):
        out = common.sifted(rows, key, wanted)
        seen.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(module, "sifted", sifted)
    return seen


def test_near_dedup_shuffles_only_texts_that_are_compared(spark, monkeypatch):
    seen = passing(monkeypatch, near)
    assert {r["doc_id"] for r in near.near_dedup(documents(spark)).collect()} == set(range(300))
    assert len(seen) == 3 and all(before == 305 and after < 60 for before, after in seen)


def test_minhash_shuffles_only_texts_of_shared_buckets(spark, monkeypatch):
    seen = passing(monkeypatch, minhash)
    assert {r["doc_id"] for r in minhash.minhash_dedup(documents(spark)).where("kept").collect()} == set(range(300))
    assert len(seen) == 1 and seen[0][0] == 305 and seen[0][1] < 60


def test_minhash_goes_on_only_with_classes_of_shared_buckets(spark, monkeypatch):
    own, placed, sets = [], [], []

    def with_hot(rows, keys, *rest):
        if keys == ["bucket"]:
            own.append(rows.count())
        return common.with_hot(rows, keys, *rest)

    def mixed_buckets(members, roots, *rest):
        placed.append(roots.count())
        return mixed(members, roots, *rest)

    mixed, few = minhash.mixed_buckets, getattr(common, "few", None)

    def counted(rows, key, *rest):
        out = few(rows, key, *rest)
        if "hashes" in rows.columns:
            sets.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(minhash, "with_hot", with_hot)
    monkeypatch.setattr(minhash, "mixed_buckets", mixed_buckets)
    monkeypatch.setattr(minhash, "few", counted, raising=False)
    assert {r["doc_id"] for r in minhash.minhash_dedup(documents(spark)).where("kept").collect()} == set(range(300))
    assert own[0] < 305 * minhash.BANDS / 4 and max(placed) <= 10  # of 9,760 bands and 305 classes
    assert sets and sets[0][0] <= 10 and sets[-1][1] == 0  # no class is left for the last turn


def test_texts_of_one_row_name_are_one_set(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, "other")], "doc_id long, text string")
    wanted = common.materialize(minhash.signed(docs, "doc_id", "text").groupBy("copy").agg(F.min("key").alias("key")), "wanted")
    out = minhash.whole_sets(docs, "doc_id", "text", wanted)
    assert sorted(len(r["hashes"]) for r in out.collect()) == [1, 2]
    assert "hashpartitioning(copy" not in out._jdf.queryExecution().executedPlan().toString()  # texts are not shuffled twice
