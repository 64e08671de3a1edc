import random
import re

import numpy as np
import pyarrow as pa
import pytest

from proofsheet.llm import partenum as op
from proofsheet.llm import textkernel as tk


def sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(rows):
    found = sets([t for _, t in rows])
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by = {}
    for i, s in enumerate(found):
        for x in s:
            by.setdefault(x, []).append(i)
    seen = set()
    for members in by.values():
        for i in members:
            for j in members:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    if 100 * len(found[i] & found[j]) >= 75 * len(found[i] | found[j]):
                        a, b = find(i), find(j)
                        up[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k if k is not None else -1, len(s), (least.get(find(i)) if s else k) or 0) for i, ((k, _), s) in enumerate(zip(rows, found, strict=True)))


def check(spark, rows):
    got = op.jaccard_components(spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, node int")).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id or 0) for r in got) == brute(rows)


def words(rnd, n, size=3000):
    return [f"w{rnd.randrange(size)}" for _ in range(n)]


def test_signatures_meet_for_every_linked_pair():
    rnd = random.Random(2)
    for size in (1, 2, 3, 4, 5, 7, 9, 15, 16, 17, 40, 63, 64, 100, 127, 128, 200, 500):
        for _ in range(25):
            base = [rnd.randrange(1 << 52) for _ in range(size)]
            a, b = set(base), set(base)
            while True:  # change b as far as the threshold allows
                c = set(b)
                if rnd.random() < 0.5 and len(c) > 1:
                    c.remove(rnd.choice(sorted(c)))
                else:
                    c.add(rnd.randrange(1 << 52))
                if 100 * len(a & c) < 75 * len(a | c):
                    break
                b = c
            often = np.sort(np.array([x for x in a | b if rnd.random() < 0.7], np.uint64))
            values = np.array([*sorted(a), *sorted(b)], np.uint64)
            sig, row = op.signatures(values, np.array([len(a), len(b)]), often)
            # the roles' bits differ with the number of rows, so both are signed together, as in a slice
            assert a == b or set(sig[row == 0].tolist()) & set(sig[row == 1].tolist()), (size, len(a), len(b))


def test_against_brute_force(spark):
    rnd = random.Random(4)
    rows, passage = [], words(rnd, 60, 10**6)
    for i in range(120):
        w = words(rnd, rnd.choice([1, 3, 5, 6, 8, 20, 60, 150, 400]))
        if rnd.random() < 0.3:
            w = w[:40] + passage + w[40:80]
        rows.append((i * 3, " ".join(w)))
        for _ in range(rnd.choice([0, 0, 1, 3])):  # copies with some words changed, which drift apart
            w = [x if rnd.random() > rnd.choice([0, 0.005, 0.02, 0.05]) else "new" + str(rnd.random()) for x in w]
            rows.append((10000 - len(rows), " ".join(w).upper() if rnd.random() < 0.2 else "\n".join(w)))
    rows += [(None, rows[0][1]), (None, "only null here twice ok then"), (None, "only null here twice ok then"), (7, ""), (8, None), (9, " \t"), rows[5], rows[5], (20001, "a"), (20002, "A"), (20003, "a b c d"), (20004, "a b c d e")]
    check(spark, rows)


@pytest.mark.parametrize("few", [0, 4_000_000])
def test_families_that_drift_from_their_pivot(spark, monkeypatch, few):
    monkeypatch.setattr(op, "FEW", few)
    monkeypatch.setattr(op, "SLICE", 16)
    monkeypatch.setattr(op, "OFTEN", 4)
    rnd = random.Random(6)
    base, rows = words(rnd, 100, 10**6), []
    for i in range(90):  # most pairs are near the threshold on either side
        w = list(base)
        for _ in range(3):
            w[rnd.randrange(100)] = f"x{rnd.random()}"
        rows.append((i, " ".join(w)))
    for i in range(40):  # a chain
        base = list(base)
        base[rnd.randrange(100)] = f"y{i}"
        rows.append((500 + i, " ".join(base)))
    monkeypatch.setattr(op, "BLOCK", 7)
    monkeypatch.setattr(op, "LARGE", 20 if few else 50_000)
    check(spark, rows)


def test_empty(spark):
    assert op.jaccard_components(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_signatures_do_not_depend_on_the_slice():
    rnd = random.Random(9)
    texts = [" ".join(words(rnd, 50)) for _ in range(40)]
    values, sizes = tk.shingle_sets(*tk.word_hashes(pa.array(texts)))
    sig, row = op.signatures(values, sizes, np.zeros(0, np.uint64))
    alone = [op.signatures(*tk.shingle_sets(*tk.word_hashes(pa.array([t]))), np.zeros(0, np.uint64))[0] for t in texts[:3]]
    for i, x in enumerate(alone):
        assert set(x.tolist()) == set(sig[row == i].tolist())


def test_sketches_never_differ_more_than_the_sets():
    rnd = np.random.default_rng(1)
    for size in (1, 5, 16, 40, 200, 900):
        a = np.unique(rnd.integers(0, 1 << 52, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * 0.9)], rnd.integers(0, 1 << 52, size // 5 + 1).astype(np.uint64)]))
        w, n = op.sketches(np.concatenate([a, b]), np.array([len(a), len(b)]))
        x, y = w[: n[0]], w[n[0] :]
        while len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


def test_pairs_of_pivots_that_rank_low(spark, monkeypatch):
    """A node with many pivots in buckets of two: those that it shares fewest buckets with are the ones that link."""
    monkeypatch.setattr(op, "PIVOTS", 1)
    rnd, nodes, found = random.Random(7), {}, []
    for at in range(0, 400, 10):
        base = rnd.sample(range(1 << 40), 100)
        nodes[at + 9] = base
        for i in range(rnd.choice([2, 4, 7])):
            own = base[: rnd.choice([20, 60, 88, 95])]
            nodes[at + i] = own + rnd.sample(range(1 << 40), 100 - len(own))
            linked = len(own) >= 88
            found += [(len(found) + k, at + i, at + 9) for k in range(1 if linked else rnd.choice([2, 5]))]
    sizes = np.array([len(x) for x in nodes.values()])
    values = [np.sort(np.array(x, np.uint64)) for x in nodes.values()]
    flat, width = op.sketches(np.concatenate(values), sizes)
    ends = np.cumsum(width)
    rows = spark.createDataFrame([(k, 100, flat[e - w : e].tolist()) for k, e, w in zip(nodes, ends, width, strict=True)], "node bigint, n bigint, sketch array<bigint>")
    held = spark.createDataFrame([(k, v.view(np.int64).tolist()) for k, v in zip(nodes, values, strict=True)], "node bigint, shingles array<bigint>")
    got = op.all_links(spark.createDataFrame(found, "bucket bigint, pivot bigint, node bigint"), rows, lambda wanted: held.join(wanted, "node", "left_semi")).collect()
    want = {(p, n) for _, p, n in found if 100 * len(set(nodes[p]) & set(nodes[n])) >= 75 * len(set(nodes[p]) | set(nodes[n]))}
    assert any(sum(q[2] == n and q[1] != p for q in found) > 1 for p, n in want) and {(r.pivot, r.node) for r in got} == want


def test_against_brute_force_with_one_pivot(spark, monkeypatch):
    monkeypatch.setattr(op, "PIVOTS", 1)
    test_against_brute_force(spark)


def test_four_texts_that_meet_by_a_third_pivot(spark):
    rnd = random.Random(12)
    rows = []
    for at in range(0, 4000, 20):  # families of short texts that differ at their ends
        base = [f"f{at}w{i}" for i in range(rnd.randrange(5, 14))]
        for i in range(rnd.choice([4, 6, 8])):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 2])):
                w = w[1:] if rnd.random() < 0.3 else w[:-1] if rnd.random() < 0.4 else [*w, f"x{rnd.randrange(3)}"] if rnd.random() < 0.5 else [f"y{rnd.randrange(3)}", *w]
            rows.append((at + i, " ".join(w)))
    check(spark, rows)


def test_proposals_that_fail_are_made_again_without_them(spark, monkeypatch):
    """Sketches that allow every pair: only the whole sets decide."""
    monkeypatch.setattr(op, "sketches", lambda values, sizes: (np.zeros(int((sizes > 0).sum()), np.int64), (sizes > 0).astype(np.int64)))
    monkeypatch.setattr(op, "PIVOTS", 1)
    rnd = random.Random(3)
    base, rows = words(rnd, 80, 10**6), []
    for i in range(60):
        w = list(base)
        for _ in range(rnd.choice([1, 2, 3])):
            w[rnd.randrange(80)] = f"x{rnd.random()}"
        rows.append((i, " ".join(w)))
    check(spark, rows)


def test_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(op, "PART_BITS", 10)  # the way of documents of millions of words
    rnd = random.Random(8)
    long = words(rnd, 30_000, 10**6)
    near = [x if rnd.random() > 0.01 else f"n{i}" for i, x in enumerate(long)]
    check(spark, [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:15_000])), (4, " ".join(words(rnd, 30_000, 10**6)))])
