import math
import random
from collections import Counter

import pytest

from proofsheet.operators import peaks as op

FIELDS = {"sharpness": "sharp", "quality": "final", "blink": "blink", "smile": "smile", "brow": "brow", "faces": "faces"}


def plain(rows):
    """One burst by plain loops: name -> (score, place, kind of reason)."""
    if len(rows) == 1:
        return {rows[0]["name"]: (1.0, 0, op.ALONE)}
    num = lambda v: 0.0 if v is None or math.isnan(v) else float(v)
    less = lambda v: 0.0 if v is None or math.isnan(v) else min(1.0, max(0.0, 1 - v))
    vecs = [r["vector"] for r in rows if r["vector"]]
    mean = [sum(v[i] if i < len(v) else 0.0 for v in vecs) / len(vecs) for i in range(len(vecs[0]))] if vecs else []

    def far(v):
        if not v or len(v) != len(mean):
            return 0.0
        a, b = math.sqrt(sum(x * x for x in v)), math.sqrt(sum(x * x for x in mean))
        return 0.0 if a <= 1e-9 or b <= 1e-9 else 1 - sum(x * y for x, y in zip(v, mean, strict=True)) / (a * b)

    f = [far(r["vector"]) for r in rows]
    spread = [0.0 if max(f) - min(f) < 1e-9 else (x - min(f)) / (max(f) - min(f)) for x in f]
    s = [{"sharpness": num(r["sharp"]), "distinctness": d, "quality": num(r["final"]), "faces": min(1.0, 0.15 * (r["faces"] or 0)), "eyes": less(r["blink"]), "smile": min(1.0, max(0.0, num(r["smile"]))), "brow": less(r["brow"])} for r, d in zip(rows, spread, strict=True)]
    named = Counter(r["scene"].lower() for r in rows if r["scene"])
    w = dict(zip(op.SIGNALS, op.WEIGHTS.get(named.most_common(1)[0][0].strip() if named else None, op.OTHERWISE), strict=True))
    out = []
    for r, x in zip(rows, s, strict=True):
        above = {k: w[k] * (x[k] - sum(y[k] for y in s) / len(s)) for k in op.REASONS}
        best = max(above, key=above.get)
        out.append((sum(w[k] * x[k] for k in op.SIGNALS), x["quality"], r["name"], best if above[best] > 1e-12 else op.NOTHING))
    out.sort(key=lambda t: (-t[0], -t[1], t[2]))
    return {n: (score, i, why) for i, (score, _, n, why) in enumerate(out)}


def test_against_plain_loops(spark):
    rnd = random.Random(11)
    value = lambda: rnd.choice([None, float("nan"), rnd.uniform(-0.3, 1.4)])
    rows = []
    for burst in range(40):
        scenes = [rnd.choice(["Wedding", "sports", " landscape", None, "", "typo"]) for _ in range(3)]
        for i in range(rnd.choice([1, 2, 3, 9, 30])):
            vector = rnd.choice([None, [], [0.0, 0.0, 0.0], [1.0, 2.0], *[[rnd.gauss(0, 1) for _ in range(3)]] * 6])
            rows.append({"run": burst % 2, "burst": burst, "i": i, "name": f"f{burst}_{i}", "vector": vector, "sharp": value(), "final": value(), "blink": value(), "smile": value(), "brow": value(), "faces": rnd.choice([None, 0, 1, 3, 12]), "scene": rnd.choice(scenes), "_far": "x"})
    rows.append({**rows[0], "burst": None, "name": "none"})
    schema = "run int, burst int, i int, name string, vector array<double>, sharp double, final double, blink double, smile double, brow double, faces int, scene string, other string"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema).repartition(5)
    got = {}
    for r in op.ranked(df, ["run", "burst"], "name", FIELDS, "scene", "vector", "i").collect():
        got.setdefault(r.burst, {})[r.name] = (r.peak_score, r.place, r.reason)
    assert None not in got and len(got) == 40
    for burst in range(40):
        want = plain([r for r in rows if r["burst"] == burst])
        for name, (score, place, why) in want.items():
            mine = got[burst][name]
            assert mine[0] == pytest.approx(score, abs=1e-9) and mine[1] == place, (burst, name)
            assert mine[2] == why if why in (op.ALONE, op.NOTHING) else mine[2].split(" ")[0] == op.REASONS[why].split(" ")[0]
    assert op.ranked(df.filter("false"), ["run", "burst"], "name", FIELDS, "scene", "vector", "i").count() == 0


def test_first_scene_of_a_tie(spark):
    df = spark.createDataFrame([(1, 2, "Sports"), (1, 5, "bird"), (1, 1, None), (1, 3, "BIRD"), (1, 4, "sports"), (2, 1, "")], "b int, i int, scene string")
    assert [tuple(r) for r in op.modal_scene(df, ["b"], "scene", "i").collect()] == [(1, "sports")]
