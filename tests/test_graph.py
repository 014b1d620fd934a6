"""Connected components, intermediate tables."""

import random

import pytest

from estatelake import storage
from estatelake.operators import graph


def brute(edges):
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for n in sorted(near):
        todo = [n] if n not in out else []
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = n
                todo += near[x]
    return out


@pytest.mark.parametrize("parts", [1024, 3])
def test_components_equal_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(graph, "PARTS", parts)
    rng = random.Random(parts)
    edges = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 40)] + [(999, 300 + i) for i in range(40)] + [(5, 5), (None, 7), (8, None)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)] + edges[:9]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute(edges)


def test_components_of_no_edges(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_written_tables_can_be_removed(spark, tmp_path):
    t = storage.written(spark.range(5), "t")
    path = t._written.removeprefix("file://")
    assert t.count() == 5
    storage.forget(t, spark.range(3))
    import os

    assert not os.path.exists(path)
