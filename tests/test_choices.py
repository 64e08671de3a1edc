"""Greedy choices and histories, held against plain loops."""

import random

from proofsheet.operators import intervals as I
from proofsheet.operators import windows as W


def plain_reel(rows, least, most):
    """rows: (no, start, end, base, scene), in order."""

    def overlap(a, b):
        short = min(a[2] - a[1], b[2] - b[1])
        return max(0.0, min(a[2], b[2]) - max(a[1], b[1])) / short if short > 0 else 0.0

    def alike(a, b):
        gap = max(0.0, max(a[1], b[1]) - min(a[2], b[2]))
        return max(overlap(a, b), 0.4 if a[4] is not None and a[4] == b[4] and gap <= 3.0 else 0.0)

    pool, out = list(rows), []
    while pool and len(out) < most:
        best, top, nov = None, -1.0, 0.0
        for w in pool:
            n = min(1.0, max(0.0, 1.0 - max([alike(w, c) for c, _, _ in out], default=0.0)))
            if w[3] * n > top:
                best, top, nov = w, w[3] * n, n
        if len(out) >= least and nov < 0.05:
            break
        out.append((best, top, nov))
        pool = [w for w in pool if w is not best and overlap(w, best) <= 0.6]
    return [(w[0], v, n) for w, v, n in sorted(out, key=lambda x: -x[1])]


def test_reel_of_three(spark):
    rows = [(0, 0.0, 10.0, 0.9, "a"), (1, 5.0, 15.0, 0.8, "b"), (2, 40.0, 50.0, 0.6, "c")]
    df = spark.createDataFrame([(7, *r) for r in rows], "clip bigint, window_no bigint, start_s double, end_s double, base double, scene string")
    got = [(r.window_no, r.score, r.novelty) for r in W.reel(df, ["clip"]).orderBy("rank").collect()]
    assert got == [(0, 0.9, 1.0), (2, 0.6, 1.0), (1, 0.4, 0.5)]


def test_reel_against_a_plain_loop(spark):
    rnd, rows, clips = random.Random(8), [], {}
    for clip in range(30):
        own = [(s, s + rnd.choice([0.0, 1, 3, 5, 9]), rnd.choice(["a", "b", None]), round(rnd.random(), 2)) for s in (rnd.randrange(60) / 2 for _ in range(rnd.randrange(1, 60)))]
        clips[clip] = sorted(((i, float(s), float(e), b, c) for i, (s, e, c, b) in enumerate(own)), key=lambda w: (w[1], w[2], w[0]))
        rows += [(clip, *w) for w in clips[clip]]
    df = spark.createDataFrame(rows, "clip bigint, window_no bigint, start_s double, end_s double, base double, scene string").repartition(4)
    for least, most in ((10, 20), (2, 5), (1, 60)):
        got = {}
        for r in W.reel(df, ["clip"], least, most).orderBy("clip", "rank").collect():
            got.setdefault(r.clip, []).append((r.window_no, r.score, r.novelty))
        assert got == {c: plain_reel(w, least, most) for c, w in clips.items()}


def covered(ops):
    """Whole units that are deleted, after each operation in turn; spans are at whole numbers."""
    done, undone = [], []
    for op, s, e in ops:
        if op == "undo":
            if done:
                undone.append(done.pop())
        elif op == "redo":
            if undone:
                done.append(undone.pop())
        elif e > s:
            done.append((op, s, e))
            undone = []
    gone = set()
    for op, s, e in done:
        gone = gone | set(range(s, e)) if op == "delete" else gone - set(range(s, e))
    return gone


def test_an_empty_operation_is_none(spark):
    ops = [(1, 0, "delete", 0.0, 10.0), (1, 1, "restore", 3.0, 3.0), (1, 2, "undo", 0.0, 0.0), (2, 0, "delete", 0.0, 4.0), (2, 1, "undo", 0.0, 0.0), (2, 2, "delete", 9.0, 2.0), (2, 3, "redo", 0.0, 0.0)]
    got = I.replay(spark.createDataFrame(ops, "clip bigint, seq int, op string, s double, e double"), ["clip"]).collect()
    assert [tuple(r) for r in got] == [(2, 0.0, 4.0)]


def test_replay_against_sets(spark):
    rnd, rows, clips = random.Random(9), [], {}
    for clip in range(40):
        ops = [(rnd.choice(["delete", "delete", "restore", "undo", "redo"]), s := rnd.randrange(40), s + rnd.randrange(-1, 9)) for _ in range(rnd.randrange(1, 40))]
        clips[clip] = covered(ops)
        rows += [(clip, i, op, float(s), float(e)) for i, (op, s, e) in enumerate(ops)]
    got = {c: set() for c in clips}
    for r in I.replay(spark.createDataFrame(rows, "clip bigint, seq int, op string, s double, e double"), ["clip"]).collect():
        new = set(range(int(r.s), int(r.e)))
        assert new and not new & got[r.clip]
        got[r.clip] |= new
    assert got == clips
