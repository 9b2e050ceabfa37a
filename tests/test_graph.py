"""Connected components against union-find."""

import random

import pytest

from pointloom.operators import graph
from pointloom.plans.scratch import Scratch


@pytest.mark.parametrize("salt", [1, 16])
def test_connected_components(spark, monkeypatch, salt):
    """A chain, a hub of small and one of large ids, chance edges, loops, repeats and nulls."""
    monkeypatch.setattr(graph, "SALT", salt)
    rng = random.Random(31)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(400, 460)] + [(600, k) for k in range(601, 660)] + [(rng.randint(700, 800), rng.randint(700, 800)) for _ in range(90)] + [(5, 5), (1, 2), (2, 1)]
    df = spark.createDataFrame([*edges, (None, 3), (3, None)], "u long, v long")
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert {tuple(r) for r in graph.connected_components(df, Scratch(spark, "graph")).collect()} == {(a, find(a)) for a in root}
    assert graph.connected_components(df.where("false"), Scratch(spark, "graph")).count() == 0
