import numpy as np
import pytest

from proofsheet.operators import sound as op


def plain(x, rate, win_s, hop_s):
    """One frame after the other."""
    win, hop = op.lengths(rate, win_s, hop_s)
    x = np.pad(x, (0, max(0, win - len(x))))
    freqs, w, out, last = np.fft.rfftfreq(win, 1 / rate), np.hanning(win), [], None
    for f in range(1 + (len(x) - win) // hop):
        seg = x[f * hop : f * hop + win] * w
        mag = np.abs(np.fft.rfft(seg))
        p = mag**2 + 1e-12
        out.append([np.sqrt(np.mean(seg**2)), min(1, np.exp(np.mean(np.log(p))) / np.mean(p)), (freqs * p).sum() / p.sum(), 0.0 if last is None else np.maximum(0, mag - last).sum()])
        last = mag
    a = np.array(out)
    return np.column_stack([a, np.clip(a[:, 3] / (np.percentile(a[:, 3], 95) + 1e-9), 0, 1)])


def plain_laughter(rms, flat, hop_s):
    n, w = len(rms), max(8, round(1 / hop_s))
    freqs, am = np.fft.rfftfreq(w, hop_s), np.zeros(n)
    for i in range(n):
        a = max(0, i - w // 2)
        seg = rms[a : min(n, a + w)]
        seg = np.pad(seg, (0, w - len(seg)))
        seg = seg - seg.mean()
        if seg.any():
            mag = np.abs(np.fft.rfft(seg * np.hanning(w)))
            am[i] = mag[(freqs >= 3) & (freqs <= 8)].sum() / (mag.sum() + 1e-9)
    if n < 8 or rms.max() < 0.01:
        return []
    mean = lambda x, i: sum(x[j] for j in range(max(0, i - w // 2), min(n, i - w // 2 + w))) / w
    on = [am[i] > 0.45 and mean(rms, i) > max(0.2 * rms.max(), 0.005) and 0.02 < mean(flat, i) < 0.6 for i in range(n)]
    out, i = [], 0
    while i < n:
        j = i
        while j < n and on[j]:
            j += 1
        if j > i and (j - i) * hop_s + 1e-9 >= 0.6:
            out.append((round(i * hop_s, 3), round(j * hop_s, 3), round(float(am[i:j].mean()), 3)))
        i = max(j, i + 1)
    return out


def clips():
    rng, t = np.random.default_rng(5), np.arange(6000) / 800
    laugh = (1 + np.sin(2 * np.pi * 5 * t)) * rng.normal(size=6000) * 0.2 + np.sin(2 * np.pi * 90 * t)
    return {
        "noise": rng.normal(size=3001), "tone": np.sin(np.arange(2000) / 7), "silent": np.zeros(500), "short": rng.normal(size=9), "one": np.array([0.5]),
        "laugh": laugh * np.where((t > 2) & (t < 5), 1.0, 0.02) * (1 + 0.9 * np.sin(2 * np.pi * 5 * t)), "window": rng.normal(size=40), None: rng.normal(size=300),
    }


@pytest.mark.parametrize(("block", "win_s", "hop_s"), [(4096, 0.05, 0.05), (7, 0.05, 0.02), (3, 0.02, 0.05), (1, 0.05, 0.05)])
def test_frames_equal_a_plain_loop(spark, block, win_s, hop_s):
    rows = [(k, i, float(v), "x") for k, x in clips().items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "clip string, i int, x double, _x string").repartition(5)
    found = op.frames(df, ["clip"], "i", "x", 800, win_s, hop_s, block)
    got = {}
    for r in found.orderBy("clip", "frame").collect():
        assert r.frame == len(got.setdefault(r.clip, [])) and r.t == pytest.approx(r.frame * hop_s)
        got[r.clip].append([r.rms, r.flatness, r.centroid, r.flux, r.onset])
    assert got.keys() == clips().keys()
    for k, x in clips().items():
        np.testing.assert_allclose(np.array(got[k]), plain(x, 800, win_s, hop_s), rtol=1e-7, atol=1e-9, err_msg=str(k))


@pytest.mark.parametrize("block", [4096, 30, 5])
def test_laughter_equals_a_plain_loop(spark, block):
    rng, rows, want = np.random.default_rng(6), [], []
    for clip in range(12):
        n = [400, 7, 8, 15, 19, 20, 21, 60, 333, 200, 500, 90][clip]
        t = np.arange(n) * 0.05
        rms = 0.3 + 0.25 * np.sin(2 * np.pi * (4 + clip % 3) * t) * (rng.random(n) < 0.97) + 0.02 * rng.random(n)
        rms = np.where((t > 5) & (t < 8), 0.05 * rng.random(n), rms) * (0.001 if clip == 9 else 1)
        flat = np.where(t % 9 < 7, 0.3, 0.9)
        rows += [(clip, f, f * 0.05, float(rms[f]), float(flat[f])) for f in range(n)]
        want += [(clip, *x) for x in plain_laughter(rms, flat, 0.05)]
    df = spark.createDataFrame(rows, "clip int, frame bigint, t double, rms double, flatness double")
    got = sorted(map(tuple, op.laughter(df, ["clip"], 0.05, block).collect()))
    assert len(want) > 8 and [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 0.0011 for g, w in zip(got, want, strict=True))


def test_laughter_of_sound(spark):
    rows = [("laugh", i, float(v)) for i, v in enumerate(clips()["laugh"])]
    found = op.laughter(op.frames(spark.createDataFrame(rows, "clip string, i int, x double"), ["clip"], "i", "x", 800), ["clip"])
    (only,) = found.collect()
    assert 1.5 < only.s < 2.6 and 4.4 < only.e < 5.5


def test_odd_samples_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("a", 3, float("nan")), ("a", 4, 2.0), ("a", -1, 9.0)], "clip string, i int, x double")
    (row,) = op.frames(df, ["clip"], "i", "x", 100).collect()
    assert [row.rms, row.flatness] == pytest.approx(plain(np.array([1.0, 0, 0, 0, 2.0]), 100, 0.05, 0.05)[0, :2])
    none = op.frames(df.filter("false"), ["clip"], "i", "x", 100)
    assert none.count() == 0 and op.laughter(none, ["clip"]).count() == 0
