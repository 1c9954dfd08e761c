"""Columns whose names have dots, structs with odd fields, and what a worker keeps of earlier runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from fairground.llm import bpe, labels, media, simhash


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(1, "One two <b>x</b>", (2,), 3), (2, None, None, None), (2, None, None, None)], "doc_id long, text string, `a.b` struct<`x y`: int>, `n tokens` int")


def test_columns_with_dots_stay(odd):
    counted = {r["doc_id"]: r for r in bpe.token_counts(odd).collect()}
    assert counted[1].asDict(recursive=True) == {"doc_id": 1, "a.b": {"x y": 2}, "n tokens": 3, "n_tokens": 9} and counted[2]["n_tokens"] == 0
    coded = {r["doc_id"]: r for r in bpe.encode_decode(odd, keep_ids=True).collect()}
    assert len(coded[1]["ids"]) == 9 and coded[1]["a.b"]["x y"] == 2 and coded[2]["ids"] == []
    scored = labels.with_score(odd, lambda texts: np.array([len(t or "") for t in texts]), "a.b")
    assert scored.columns == ["doc_id", "text", "a.b", "n tokens", "_a.b"] and sorted(r["_a.b"] for r in scored.collect()) == [0, 0, 16]
    pages = media.sequences(odd, "text").collect()
    assert [i["text"] for i in next(r for r in pages if r["doc_id"] == 1)["sequence"]] == ["One two x"] and pages[0].asDict().keys() == {"doc_id", "a.b", "n tokens", "sequence"}


def test_a_worker_keeps_one_coder(spark, odd):
    for _ in range(6):
        bpe.encode_decode(odd).collect()

    def kept(batches):
        import sys

        for _ in batches:
            held = getattr(sys.modules.get("_fairground_worker"), "__dict__", {})
            yield pa.RecordBatch.from_arrays([pa.array([sum(k.startswith("coder") for k in held)])], names=["n"])

    assert max(r["n"] for r in spark.range(8).repartition(8).mapInArrow(kept, "n long").collect()) <= 1


def test_a_fingerprint_of_most_rows(spark):
    docs = spark.createDataFrame([(i, "the very same words in all of these" if i % 3 else f"own words {i} of this text alone") for i in range(600)], "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in simhash.simhash_dedup(docs).collect()}
    assert {out[i] for i in range(600) if i % 3} == {1} and len(out) == 600
