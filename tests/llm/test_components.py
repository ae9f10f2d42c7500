import random

from qaflow.llm.components import connected_components


def test_chains_stars_and_noise(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    noise = [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    edges = chain + star + noise + [(None, 5), (7, 7), (2, 1)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in found} == {x: find(x) for x in list(root)}
    assert len(found) == len(root)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
