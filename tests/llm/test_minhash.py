"""Min-max hashing near-dedup against all pairs."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from fairground.llm import minhash


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=85):
    """rows: (id, text); (id, n_shingles, component_id, kept) of each."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids: dict = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    low = {r: min((d for d in found if d is not None), default=None) for r, found in ids.items()}
    out = []
    for i, (d, _) in enumerate(rows):
        mine = low[find(i)] if sets[i] else d
        out.append((d, len(sets[i]), mine, d == mine))
    return Counter(out)


def corpus(seed, groups=12, copies=14):
    """Groups whose members replace 0 to 5 % of an original's words: similarities on both sides of 0.85."""
    rng = random.Random(seed)
    texts = []
    for g in range(groups):
        size = rng.choice((4, 8, 30, 90, 250))
        words = [f"w{g}x{rng.randrange(size)}" for _ in range(size)]
        for _ in range(copies):
            rate = rng.choice((0, 0.003, 0.01, 0.02, 0.05))
            texts.append(" ".join(f"n{rng.randrange(10**6)}" if rng.random() < rate else w for w in words))
    rng.shuffle(texts)
    return texts


def check(spark, rows, **kw):
    out = minhash.minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"), **kw).collect()
    assert Counter(map(tuple, out)) == brute(rows, kw.get("similarity", 85))


@pytest.mark.parametrize("seed", [1, 2])
def test_links_of_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 3)  # hot classes and buckets are dealt out
    rows = list(enumerate(corpus(seed)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "a b c d"), (906, "a b c d"), (None, "a b c d"), (None, "lonely text"), (903, "one"), (907, "long " * 20_000 + "tail")]
    rows += [(1000 + i, "the very same text of a hot group of copies") for i in range(150)]
    check(spark, rows)


def test_a_group_near_the_threshold(spark):
    """Copies of one original whose pairs lie around the similarity: first links, then the rest of each bucket."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        mine = list(words)
        for at in rng.sample(range(200), rng.choice((1, 2, 3, 4, 6))):
            mine[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(mine)))
    check(spark, rows)
    check(spark, rows, similarity=90)


def test_odd_tables(spark):
    rows = [("b", "One two three four five", 1, (2,)), ("a", "one two three\tfour five", None, None), (None, "z", 3, (4,))]
    docs = spark.createDataFrame(rows, "`my.id` string, `the text` string, kept int, `a.b` struct<`x y`: int>")
    out = minhash.minhash_dedup(docs, "my.id", "the text").collect()
    assert Counter(map(tuple, out)) == {("b", 1, "a", False): 1, ("a", 1, "a", True): 1, (None, 1, None, True): 1}
    assert minhash.minhash_dedup(docs.limit(0), "my.id", "the text").count() == 0
    with pytest.raises(ValueError, match="similarity"):
        minhash.minhash_dedup(docs, "my.id", "the text", similarity=70)


def test_values_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(4)
    errors = []
    for share in (0.3, 0.6, 0.85, 0.95):
        for n in (40, 400):
            both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            common = int(round(2 * n * share / (1 + share)))
            a, b = both[:common], np.concatenate([both[:common], both[common:]])
            values = minhash.min_max(a), minhash.min_max(b)
            errors.append((values[0] == values[1]).mean() - len(a) / len(b))
    assert abs(np.mean(errors)) < 0.03 and max(map(abs, errors)) < 0.13


def test_a_set_meets_a_tile_at_once(spark, monkeypatch):
    rng, met = random.Random(8), []
    sets = {f"c{i:02}".encode(): sorted(rng.sample(range(40), 34) + [100 + rng.randrange(3)]) for i in range(60)}
    names = sorted(sets)
    pairs = [(a, b) for a in names for b in names if a < b]

    def with_hot(rows, *rest):
        met.append(rows.count())
        return hot(rows, *rest)

    hot = minhash.with_hot
    monkeypatch.setattr(minhash, "with_hot", with_hot)
    monkeypatch.setattr(minhash, "CHUNK", 7)
    monkeypatch.setattr(minhash, "TILE", 16, raising=False)
    stored = minhash.Scratch(spark, "test")
    table = stored.table(spark.createDataFrame(list(sets.items()), "copy binary, hashes array<bigint>"), "sets")
    found = minhash.confirmed(spark.createDataFrame(pairs, "a binary, b binary"), table, 75, stored).collect()
    want = [(a, b) for a, b in pairs if 100 * len(set(sets[a]) & set(sets[b])) >= 75 * len(set(sets[a]) | set(sets[b]))]
    assert 0 < len(want) < len(pairs) and sorted((bytes(r.a), bytes(r.b)) for r in found) == want
    assert len(met) == 1 and met[0] <= 4 * len(names)  # of 1,770 pairs
    assert not minhash.confirmed(spark.createDataFrame([], "a binary, b binary"), table, 75, stored).count()
