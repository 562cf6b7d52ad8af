"""Clustering coefficients against pairs of neighbours, with hubs, loops and repeats."""

import itertools
import random

import pytest

from sparquill.operators import graph


@pytest.mark.parametrize("seed", [1, 2])
def test_clustering_equals_pairs_of_neighbours(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(150)]
    edges += [("hub", f"n{k}") for k in range(30)] + [(f"n{k}", "sink") for k in range(30)] + [("hub", "sink"), ("hub", "hub"), ("alone", "n1"), edges[0], (None, "n1"), ("n1", None)]
    found = {r.id: (r.neighbours, r.closed, r.coefficient) for r in graph.clustering(spark.createDataFrame(edges, "src string, dst string")).collect()}
    plain = {(a, b) for a, b in edges if a and b and a != b}
    want = {}
    for a in {a for a, _ in plain}:
        near = sorted(b for c, b in plain if c == a)
        closed = sum((x, y) in plain or (y, x) in plain for x, y in itertools.combinations(near, 2))
        want[a] = (len(near), closed, round(closed / (len(near) * (len(near) - 1) / 2), 6) if len(near) > 1 else 0.0)
    assert found == want


def test_no_edges(spark):
    assert graph.clustering(spark.createDataFrame([], "src string, dst string")).count() == 0
