import random

from paperlake.llm import common as C


def test_components_by_star_rounds_equal_those_of_one_task(spark):
    rng = random.Random(6)
    n = 300
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(170)] + [(i, i + 1) for i in range(200, 240)] + [(5, 5), (1, 2), (2, 1)]
    edges += [(299, i) for i in range(60, 90)]  # a hub
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    nodes = spark.range(n).toDF("node")
    links = spark.createDataFrame(edges, "a long, b long")
    for one_task in (0, 10**6):
        assert {r.node: r.root for r in C.components(nodes, links, one_task).collect()} == {i: find(i) for i in range(n)}
