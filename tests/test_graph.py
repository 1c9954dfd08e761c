"""Components against union-find, on shapes that are slow or dense."""

from __future__ import annotations

import random

import pytest

from fairground.operators.graph import components


def brute(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in root}


def shapes():
    rng = random.Random(2)
    order = list(range(60))
    rng.shuffle(order)
    yield [(i, i + 1) for i in range(60)]  # a path in order
    yield list(zip(order, order[1:], strict=False))  # a path in no order
    yield [(0, i) for i in range(1, 50)] + [(99, i) for i in range(60, 90)]  # stars
    yield [(a, b) for a in range(25) for b in range(a)] + [(7, 7)]  # a dense group, and a loop
    yield [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]


@pytest.mark.parametrize("edges", list(shapes()))
def test_components(spark, edges):
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: r for n, r in brute(edges).items() if any(a != b and n in (a, b) for a, b in edges)}
    assert out == want


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
