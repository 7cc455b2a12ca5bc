import random

from fathom.llm import common


def plain(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    for edges in (
        [(i, i + 1) for i in range(60)],
        [(i + 1, i) for i in range(0, 60, 2)] + [(5, 40)],
        [(0, i) for i in range(1, 50)] + [(99, i) for i in range(100, 140)] + [(7, 7), (7, 8), (7, 8)],
        [(rng.randrange(150), rng.randrange(150)) for _ in range(90)],
    ):
        got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got == plain(edges)
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0
