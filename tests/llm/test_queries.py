"""Each registered query over the driver's tables: its contract's columns, its rows, and brute force where SQL says nothing."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from fairground.llm import bpe, packing
from fairground.llm.queries import GOOD, ORACLE, QUERIES, TOXIC

SF = "/root/testdata/sf0.01"
CONTRACT = {
    "op2_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op4_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_media": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op6_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op7_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op9_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op10_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op11_alignment": {"doc_id": "bigint", **dict.fromkeys(("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), "bigint"), "groups_sha256": "string"},
    "op12_vector_codes": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
    "op13_minhash": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
}
crc = lambda i: zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def rows(spark):
    held = {}

    def of(name):
        if name not in held:
            held[name] = QUERIES[name](spark, SF)
            held[name] = (held[name].dtypes, held[name].collect())
        return held[name]

    return of


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract_columns_and_one_row_a_document(rows, texts, name):
    kinds, found = rows(name)
    assert CONTRACT.get(name, {}).items() <= dict(kinds).items()
    if name == "op12_vector_codes":
        assert len(found) == len({r["vec_id"] for r in found}) == 500
    else:
        assert sorted(r["doc_id"] for r in found) == sorted(texts)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_gives_the_same_rows(rows, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    out = con.execute(ORACLE[name])
    columns = sorted(c[0] for c in out.description)
    want = Counter(tuple(str(dict(zip([c[0] for c in out.description], r, strict=True))[c]) for c in columns) for r in out.fetchall())
    kinds, found = rows(name)
    assert sorted(c for c, _ in kinds) == columns and Counter(tuple(str(r[c]) for c in columns) for r in found) == want


def test_shards_hold_the_documents(rows, texts):
    found, slots = rows("op2_sharding")[1], defaultdict(list)
    for r in found:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    # A uniform shuffle leaves no trace of the ids: each shard's mean id is near that of all.
    ids = np.array(sorted(texts))
    z = [(np.mean([r["doc_id"] for r in found if r["shard"] == s]) - ids.mean()) / (ids.std() / len(slots[s]) ** 0.5) for s in slots]
    assert max(map(abs, z)) < 4.5 and 0.4 < np.std(z) < 1.8


def test_packing_pads_least(rows):
    found = rows("op3_packing")[1]
    bounds = sorted({r["padded_length"] for r in found})
    histogram = sorted(Counter(r["n_tokens"] for r in found).items())
    assert set(bounds) <= set(packing.optimal_bounds(histogram, packing.BUCKETS)) and len(bounds) == packing.BUCKETS
    assert all(r["padded_length"] == min(b for b in bounds if b >= r["n_tokens"]) and r["bucket"] == bounds.index(r["padded_length"]) for r in found)
    batches = defaultdict(list)
    for r in found:
        batches[r["bucket"], r["batch"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) and len(s) * bounds[b] <= max(packing.BUDGET, bounds[b]) for (b, _), s in batches.items())


@pytest.mark.parametrize(("name", "label", "threshold"), [("op4_quality", "quality", GOOD), ("op7_toxicity", "toxic", TOXIC)])
def test_scores_tell_held_out_labels(spark, rows, name, label, threshold):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = rows(name)[1]
    assert all(r["held_out"] == crc(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= threshold) for r in found)
    held = [(r["score"], labels[r["doc_id"]]) for r in found if r["held_out"] and labels.get(r["doc_id"]) is not None]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert auc > (0.9 if label == "quality" else 0.8), auc


def test_media_columns_are_of_the_whole_text(rows, texts):
    by_text = {}
    for r in rows("op5_media")[1]:
        raw = texts[r["doc_id"]].encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert by_text.setdefault(raw, (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])
        samples = np.frombuffer(payload, np.uint8)
        assert r["feature"].startswith(f"grey8 576x{len(payload) // 576} mean={samples.mean():.4f} sd={samples.std():.4f}")
        lines = [" ".join(x.split()) for x in texts[r["doc_id"]].split("\n") if x.strip()]
        first = bool(texts[r["doc_id"]].split("\n")[0].strip())
        assert (r["position"], r["caption"], r["n_items"]) == (1 + first, f"Text of document {r['doc_id']}", len(lines) + 2)
        assert r["text_chars"] == sum(map(len, lines)) + len(f"Document {r['doc_id']}")


def test_codes_are_the_library_s(rows, texts):
    library = bpe.WordBpe(bpe.vocabulary_path()).library
    packed = {r["doc_id"]: r for r in rows("op8_token_files")[1]}
    start = 0
    for r in sorted(rows("op6_bpe")[1], key=lambda r: r["doc_id"]):
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        file = packed[r["doc_id"]]
        assert (file["start"], file["n_tokens"], file["ids_crc32"]) == (start, len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes()))
        start += len(ids) + 1
