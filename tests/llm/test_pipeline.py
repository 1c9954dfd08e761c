"""The pipeline's stages against what each operator says of its own input."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline as cp
from fairground.llm import line_dedup
from fairground.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


def recall_of(before, gone):
    """The share that went of the documents that go when every pair is compared; no others went."""
    holders, known, root = {}, {}, {}

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, own in sorted((r["doc_id"], shingles(r["text"] or "") or {""}) for r in before.collect()):
        root[i] = i
        for j, n in Counter(j for s in own for j in holders.get(s, ())).items():
            if n / (len(own) + len(known[j]) - n) >= 0.8:
                low, high = sorted((find(i), find(j)))
                root[high] = low
        for s in own:
            holders.setdefault(s, []).append(i)
        known[i] = own
    want = {i for i in root if find(i) != i}
    assert gone <= want
    return len(gone) / max(1, len(want))


def test_stages_pass_on_what_they_keep(spark):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        out = spark.createDataFrame(out.collect(), out.schema)
        seen.append((name, docs, out))
        docs = out
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    share = lambda y, label, ids: sum(labels[i][label] == y for i in ids if i in labels) / sum(i in labels for i in ids)
    for name, before, after in seen[:-1]:
        assert after.columns == cp.COLUMNS
        gone = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()}
        if name == "quality":
            assert share(0, "quality", gone) > 0.95
        if name == "toxicity":
            assert share(1, "toxic", gone) > 0.95
        if name == "line_dedup":
            assert not gone and after.exceptAll(before).count() == line_dedup.line_dedup(before).where("removed_lines > 0").count()
        if name == "near_dedup":
            assert recall_of(before, gone) >= 0.9
    assert seen[-1][2].count() == seen[-1][1].count()
    assert cp.run(spark, SF).count() == seen[-1][2].count()


def test_empty_documents_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = spark.createDataFrame([], stage(spark, docs, SF).schema)
        assert docs.count() == 0


def test_near_copies_are_told_by_text_whatever_the_ids(spark):
    prose = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(4)]
    rows = [(None, prose[0]), (None, prose[1]), (None, prose[1]), (5, prose[2]), (5, prose[2]), (5, prose[3]), (3, prose[3]), (None, prose[3]), (3, prose[3].upper())]
    want = sorted([("None", prose[0]), ("None", prose[1]), ("5", prose[2])])
    for parts in (1, 7):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(parts)
        out = sorted((str(r["doc_id"]), r["text"]) for r in cp.without_near_copies(spark, docs, SF).collect())
        assert [r for r in out if r[0] != "3"] == want
        assert [r[1].lower() for r in out if r[0] == "3"] == [prose[3]] and len(out) == 4


def shingles(text):
    words = text.lower().split()
    return set() if not words else {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_copies_of_similarity_over_four_fifths_go_and_others_stay(spark):
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts, planted = {}, {}
    for k in range(120):
        base = fresh(rng.choice((60, 300, 900)))
        copy, edits = list(base), rng.randint(1, max(2, len(base) // 45))
        for _ in range(edits):
            copy[rng.randrange(len(copy))] = fresh(1)[0]
        texts[2 * k], texts[2 * k + 1] = " ".join(base), " ".join(copy)
        planted[2 * k + 1] = similarity(texts[2 * k], texts[2 * k + 1])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"] for r in cp.without_near_copies(spark, docs, SF).collect()}
    assert set(planted) - out == {i for i, s in planted.items() if s >= 0.8} and set(texts) - set(planted) <= out
    assert sum(0.8 <= s < 0.98 for s in planted.values()) > 40 and sum(s < 0.8 for s in planted.values()) > 10


def test_a_bucket_of_several_groups_loses_no_pair(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:k] + [f"a{g}b{i}" for i in range(30)] + base[k + 30 :] + ([f"c{g}d{n}"] if n else [])) for g, k in enumerate(range(0, 170, 17)) for n in range(4)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                group = [group[j] if g == group[i] else g for g in group]
    least = {min(i for i, h in enumerate(group) if h == g) for g in set(group)}
    assert {r["doc_id"] for r in cp.without_near_copies(spark, docs, SF).collect()} == least and len(least) == 10


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLE) <= set(QUERIES) and cp.ORACLE_SQL is None
