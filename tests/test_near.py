import random

import numpy as np
import pytest

from proofsheet.operators import near as op
from proofsheet.operators.graph import connected_components


def table(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [float(x) for x in v], "x") for k, v in rows], "id bigint, vec array<double>, key string").repartition(5)


def clustered(rng, n, dim, centres, noise):
    at = rng.normal(size=(centres, dim))
    return [(int(i), at[rng.integers(centres)] + noise * rng.normal(size=dim)) for i in rng.permutation(n)]


def brute(rows, threshold):
    known = [(k, np.array(v, np.float32).astype(float)) for k, v in rows if v is not None and len(v) and np.any(v)]
    m = np.array([v / np.linalg.norm(v) for _, v in known])
    cos = m @ m.T
    keys = [k for k, _ in known]
    return {(min(keys[i], keys[j]), max(keys[i], keys[j])): cos[i, j] for i in range(len(keys)) for j in range(i) if cos[i, j] >= threshold}


def groups(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {k: find(k) for k in up}


@pytest.mark.parametrize(("values", "threshold", "noise"), [(4_000_000, 0.9, 0.15), (400, 0.9, 0.25), (300, 0.2, 1.0)])
def test_pairs_and_groups_equal_brute_force(spark, monkeypatch, values, threshold, noise):
    monkeypatch.setattr(op, "BLOCK_VALUES", values)
    monkeypatch.setattr(op, "EACH", 20)
    monkeypatch.setattr(op, "FEW", 2048 if values > 1000 else 0)
    rows = [*clustered(np.random.default_rng(5), 400, 8, 9, noise), (1000, None), (1001, []), (1002, [0.0] * 8), (1003, np.ones(8)), (1004, np.ones(8)), (1005, 3 * np.ones(8))]
    df, want = table(spark, rows), brute(rows, threshold)
    got = {(r.a, r.b): r.cos for r in op.pairs(df, "id", "vec", threshold).collect()}
    assert len(want) > 100 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    found = connected_components(op.links(df, "id", "vec", threshold), "a", "b").collect()
    assert {r.node: r.component for r in found} == groups(want)


def test_far_cells_are_not_visited_and_a_dense_group_has_few_edges(spark):
    rows = clustered(np.random.default_rng(6), 3000, 16, 12, 0.05)
    df = table(spark, rows)
    cells = min(op.PIVOTS, 3000 // op.EACH)
    assert op.visits(df, "id", "vec", 0.95) < 0.25 * 3000 * (cells - 1) / 2
    pairs, edges = op.pairs(df, "id", "vec", 0.95).count(), op.links(df, "id", "vec", 0.95).count()
    assert pairs > 300_000 and edges < 3000 * cells / 4


def test_empty(spark):
    df = table(spark, [(1, [1.0, 0.0])])
    assert op.pairs(df.filter("false"), "id", "vec", 0.5).count() == 0 and op.links(df, "id", "vec", 0.5).count() == 0


def test_labels_of_long_chains():
    rnd = random.Random(3)
    n = 3000
    order = list(range(n))
    rnd.shuffle(order)
    label = np.arange(n)
    op.joined(label, np.array(order[:-1]), np.array(order[1:]))
    assert set(label.tolist()) == {0}
