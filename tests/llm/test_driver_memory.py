"""What the driver of a long run holds on to, and what it asks of Spark."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairground.llm import toxicity
from fairground.operators import graph


def held_mb() -> float:
    return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


@pytest.mark.skipif(not Path("/proc/self/status").exists(), reason="memory is read from /proc")
def test_the_toxicity_fit_leaves_the_driver_as_it_was(spark):
    words = F.transform(F.sequence(F.lit(0), F.lit(900)), lambda i: F.conv(F.pmod(F.xxhash64("doc_id", i), F.lit(1 << 40)), 10, 36))
    docs = spark.range(1600).withColumnRenamed("id", "doc_id").withColumn("text", F.array_join(words, " "))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    toxicity.fit_toxicity(docs.limit(50), labels)  # what is loaded once
    before = held_mb()
    model = toxicity.fit_toxicity(docs, labels)
    assert np.count_nonzero(model.weights) > 100_000 and held_mb() - before < 25


def test_components_look_for_a_row_without_a_shuffle(spark, monkeypatch):
    counted = []
    frame = type(spark.range(1))
    monkeypatch.setattr(frame, "count", lambda self, f=frame.count: counted.append(self) or f(self))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    found = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100} and not counted
