import random

from proofsheet.operators.graph import connected_components


def union_find(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(up)}


def test_components_against_union_find(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000 + i) for i in range(1, 60)]
    edges = [e for e in edges if e[0] != e[1]]
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == union_find(edges) and len(got) == len({x for e in edges for x in e})


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([(1, 1)], "a bigint, b bigint")).count() == 0
