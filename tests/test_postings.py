"""The trigram index against contains(), and what a search reads."""

from __future__ import annotations

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from fairground.operators import postings


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rng = random.Random(2)
    rows = [(f"t{i:03d}", "".join(rng.choice("aab é\n") for _ in range(rng.randrange(60)))) for i in range(300)] + [("n", None), ("e", ""), ("s", "ab")]
    df = spark.createDataFrame(rows, "id string, text string")
    folder = f"file://{tmp_path_factory.mktemp('postings')}/index"
    postings.build(df, folder)
    return rows, df, folder


def test_places_decide_as_contains_does(spark, texts):
    rows, df, folder = texts
    rng = random.Random(5)
    for terms in [["aaa"], ["aaaa"], ["a b"], ["aé a"], ["zzz"], ["aab", "baa"], *[["".join(rng.choice("aab é") for _ in range(rng.randrange(3, 8)))] for _ in range(12)]]:
        got = sorted(r["id"] for r in postings.search(spark, folder, terms).collect())
        assert got == sorted(i for i, t in rows if t and all(x in t for x in terms)), terms
    got = sorted(r["id"] for r in postings.searched(df, F.col("text"), folder, ["aab", "é"]).collect())
    assert got == sorted(i for i, t in rows if t and "aab" in t and "é" in t)
    with pytest.raises(ValueError, match="three"):
        postings.search(spark, folder, ["ab"])


def test_only_the_terms_folders_are_read(spark, texts):
    found = postings.search(spark, texts[2], ["aab é"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    folders = sorted({zlib.crc32(g.encode()) % postings.BUCKETS for g, _ in postings.pieces("aab é")})
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ IN \(" + ",".join(map(str, folders)) + r"\)", plan) and "PushedFilters: [In(gram" in plan


def test_equal_texts_have_postings_once(spark, tmp_path):
    df = spark.createDataFrame([(f"t{i:02d}", f"harbour jazz {i % 3}") for i in range(30)], "id string, text string")
    folder = f"file://{tmp_path}/index"
    postings.build(df, folder)
    written = spark.read.parquet(f"{folder}/postings")
    assert written.select("id").distinct().count() == 3
    assert sorted(r["id"] for r in postings.search(spark, folder, ["jazz 1"]).collect()) == [f"t{i:02d}" for i in range(30) if i % 3 == 1]
