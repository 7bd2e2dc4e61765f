from __future__ import annotations

import random

import pytest

from quillon.llm.components import connected_components, labels


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return sorted((n, find(n)) for n in root)


def chain(n):
    return [(i, i + 1) for i in range(n)]


def star(n):
    return [(5_000, i) for i in range(n)]


def scattered():
    rng = random.Random(1)
    return [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]


@pytest.mark.parametrize("edges", [chain(700), [(b, a) for a, b in chain(300)], star(3000), scattered(), chain(5) * 20 + [(3, 3), (None, 1), (2, None)], [(1, 1)], []])
def test_matches_brute_force(spark, edges):
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == brute(edges)


def test_rounds_are_bounded(spark):
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame(chain(200), "a long, b long"), max_rounds=1)


def test_labels_of_nodes_without_links(spark):
    nodes = spark.createDataFrame([(1, 10), (2, None), (3, 7), (4, None)], "node long, least long")
    roots = connected_components(spark.createDataFrame([(1, 3)], "a long, b long"))
    assert sorted(map(tuple, labels(nodes, roots).collect())) == [(1, 7), (2, None), (3, 7), (4, None)]
