"""Joins of vectors that are all far apart, in few copies, and density clusters without their pairs."""

import numpy as np
import pytest

from proofsheet.operators import near
from proofsheet.operators import similarity as S
from tests.test_near import brute, groups, table


def test_rows_that_cells_cannot_part_are_copied_once_for_each_block(spark, monkeypatch):
    monkeypatch.setattr(near, "FEW", 100)
    monkeypatch.setattr(near, "EACH", 10)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=32)) for i in range(1000)]
    df, want = table(spark, rows), brute(rows, 0.45)
    dealt, _ = near._dealt(df, "id", "vec", 0.45)
    assert dealt.count() <= 1000 * near.LEAST_BLOCKS
    assert len(want) > 100 and {(r.a, r.b) for r in near.pairs(df, "id", "vec", 0.45).collect()} == want.keys()


@pytest.mark.parametrize("few", [2048, 50])
def test_density_clusters_take_no_table_of_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(near, "FEW", few)
    monkeypatch.setattr(near, "EACH", 20)
    monkeypatch.setattr(S, "similar_pairs", None)
    rng = np.random.default_rng(8)
    rows = [*((i, rng.normal(size=6)) for i in range(300)), *((i, np.ones(6)) for i in range(300, 340)), (900, None), (901, [0.0] * 6)]
    pairs = brute(rows, 0.9)
    near_to = {k: set() for k, _ in rows}
    for a, b in pairs:
        near_to[a].add(b)
        near_to[b].add(a)
    core = {k for k, of in near_to.items() if len(of) + 1 >= 4}
    named = {k: k for k in core} | groups([(a, b) for a, b in pairs if a in core and b in core])
    want = {k: named[k] if k in core else min((named[o] for o in of if o in core), default=-1) for k, of in near_to.items()}
    got = {r.id: r.cluster_id for r in S.density_groups(table(spark, rows), "id", "vec", 0.9, 4).collect()}
    assert got == want and -1 in want.values() and len(core) < sum(v != -1 for v in want.values())


def test_cosines_of_vectors_of_length_1_are_their_dot_products(spark):
    rng = np.random.default_rng(9)
    m = rng.normal(size=(200, 16))
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32).astype(float)
    got = {(r.a, r.b): r.cos for r in near.pairs(table(spark, list(enumerate(m))), "id", "vec", 0.3).collect()}
    assert len(got) > 100 and all(abs(c - m[a] @ m[b]) < 1e-12 for (a, b), c in got.items())


@pytest.mark.parametrize("values", [4_000_000, 400])
def test_queries_are_not_copied_to_each_row(spark, monkeypatch, values):
    monkeypatch.setattr(S, "BLOCK_VALUES", values)
    monkeypatch.setattr(S, "in_blocks", None)
    rng = np.random.default_rng(10)
    m = rng.normal(size=(300, 8))
    m[5] = m[6] = m[7]
    df = table(spark, list(enumerate(m)))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = {(r.q, r["rank"]): (r.key, r.cos) for r in S.per_query_matches(df, df.filter("id % 20 = 0 or id = 6"), "id", "vec", "id", 4).collect()}
    for q in [*range(0, 300, 20), 6]:
        want = sorted((-round(float(u[q] @ u[i]), 12), i) for i in range(300) if i != q)[:4]
        assert [got[q, r + 1][0] for r in range(4)] == [i for _, i in want] and all(abs(got[q, r + 1][1] + c) < 1e-9 for r, (c, _) in enumerate(want))
    assert len(got) == 4 * 16
