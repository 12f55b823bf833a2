import random

from actloom.llm.components import components


def brute(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for u, v in edges for x in (u, v)}


def test_stars_paths_and_loops(spark):
    rng = random.Random(4)
    edges = [(7_000, i) for i in range(7_001, 7_900)] + [(9_999, i) for i in range(8_000, 8_500)]  # hubs that are least and greatest
    edges += [(i, i + 1) for i in range(300)] + [(500 + i, 500 + (i * 7) % 90) for i in range(90)]
    edges += [(rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(350)] + [(-5, -5), (-(2**63), 2**63 - 1), (3, 2), (2, 3)]
    edges = [e for e in edges if e[0] != e[1]] + edges[:20]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == brute(edges)
    assert components(spark.createDataFrame([(1, 1)], "u long, v long")).collect() == []
