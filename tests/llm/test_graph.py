import random

from palimpsest.llm.common import Workspace
from palimpsest.llm.graph import connected_components


def test_as_union_find(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2001, 2000), (2001, 2002), (7, 7), (-5, 3000)]
    edges += [(rnd.randrange(4000, 4300), rnd.randrange(4000, 4300)) for _ in range(200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    rnd.shuffle(edges)
    got = connected_components(Workspace(spark), spark.createDataFrame(edges + edges[:50], "u long, v long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in root)
    assert connected_components(Workspace(spark), spark.createDataFrame([], "u long, v long")).count() == 0
