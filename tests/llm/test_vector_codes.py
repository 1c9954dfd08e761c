"""Vector codes against plain int64 arithmetic."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from fairground.llm import vector_codes as vc

COLUMNS = "vec_id long, embedding array<float>, label int"


def brute(rows, entries=16, rounds=6):
    """rows: (id, vector, label); those of the result."""
    kept = [(i, np.floor(np.array(v, np.float32).astype(float) * 4096).astype(np.int64), y) for i, v, y in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))[:entries]
    width = len(kept[0][1]) // 8
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in first] for p in range(8)]
    near = lambda x, book: min(range(len(book)), key=lambda e: (int(((x - book[e]) ** 2).sum()), e))
    for _ in range(rounds):
        for p in range(8):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[near(cut(v, p), books[p])].append(cut(v, p))
            for e, members in groups.items():
                books[p][e] = np.array([int(sum(int(m[k]) for m in members)) // len(members) for k in range(width)])
    digest = hashlib.sha256(",".join(str(int(x)) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, y in kept:
        code = [near(cut(v, p), books[p]) for p in range(8)]
        out.append((i, "".join(f"{c:02x}" for c in code), sum(int(((cut(v, p) - books[p][code[p]]) ** 2).sum()) for p in range(8)), y))
    errors = defaultdict(int)
    for _, _, e, y in out:
        errors[y] += e
    return [(i, c, e, errors[y], digest) for i, c, e, y in out]


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


def check(spark, rows, **kw):
    out = vc.compress(spark.createDataFrame(rows, COLUMNS), **kw).collect()
    assert sorted(map(tuple, out), key=key) == sorted(brute(rows, **kw), key=key)


def test_nearest_is_exact():
    rng = np.random.default_rng(1)
    for most in (2, 50, 5000, vc.LARGEST):
        book = rng.integers(-most, most + 1, (16, 8))
        book[9], book[12] = book[4], book[1] + 1
        for vectors in (rng.integers(-most, most + 1, (3000, 8)), book[rng.integers(0, 16, 3000)] + rng.integers(-1, 2, (3000, 8)), (book[rng.integers(0, 16, 3000)] + book[rng.integers(0, 16, 3000)]) // 2):
            want = ((vectors[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
            assert (vc.nearest(vectors, book) == want).all()


def test_rounds_of_all_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 0.2, (9, 16))
    rows = [(int(i), (centres[i % 9] + rng.normal(0, 0.03, 16)).astype(np.float32).tolist(), None if i % 5 == 0 else int(i % 3)) for i in rng.permutation(700)]
    rows += rows[:40]  # repeated rows count
    rows += [(5000 + i, [0.5] * 16, 1) for i in range(500)]  # a hot vector, ties among equals
    rows += [(-3, None, 1), (-2, [None] * 16, 1), (-1, [float("nan")] * 16, 1), (-4, [float("inf")] + [0.0] * 15, 2), (-5, [], 1), (None, [0.25] * 16, 1), (None, [0.125] * 16, None)]
    monkeypatch.setattr(vc, "AT_ONCE", 100)
    check(spark, rows)
    check(spark, rows, entries=3, rounds=2)


def test_few_or_no_vectors(spark):
    check(spark, [(i, [float(i)] * 8, i) for i in range(5)])
    check(spark, [(1, [-0.00001] * 8, None)])
    check(spark, [(1, None, None), (2, [float("nan")] * 8, 3)])
    assert vc.compress(spark.createDataFrame([], COLUMNS)).count() == 0


def test_vectors_that_cannot_be_coded(spark):
    for rows in ([(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)], [(1, [0.0] * 9, 1)], [(1, [1e30] * 8, 1)]):
        with pytest.raises(Exception, match="length|beyond"):
            vc.compress(spark.createDataFrame(rows, COLUMNS)).collect()


def test_odd_names_and_decoding(spark):
    rows = [(f"v{i}", [float(i % 4), 1.0] * 4, float("nan") if i % 2 else -0.5, i) for i in range(20)]
    df = spark.createDataFrame(rows, "`my.id` string, `v v` array<double>, `l.l` double, code int")
    out = vc.compress(df, "my.id", "v v", "l.l").collect()
    assert sorted(r["my.id"] for r in out) == sorted(r[0] for r in rows) and {r["error"] for r in out} == {0}
    books = vc.fit_codebooks(df, "my.id", "v v")
    coded = vc.decode(vc.encode(df, books, "my.id", "v v"), books).collect()
    assert {r["my.id"]: r["approximation"] for r in coded} == {r[0]: r[1] for r in rows}
