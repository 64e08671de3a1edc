"""Signals of clips in time order: salience, shake, blur, tempo, profiles of taste, and tracks on a map.

Statistics of a clip (percentiles, medians) are aggregated and joined back, so that only neighbours need a window. Where rows are
sorted by clip and time anyway (tempo, loud runs), they come from windows over the whole clip, since a join would sort once more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.operators.windows import local_event, motion_continuity, robust_norm, smoothness

#: Blends of salience and of the temporal score, and where a frame is blurred against its clip's median.
SALIENCE = {"moment": 0.5, "appearance": 0.3, "faces": 0.2}
TEMPORAL = {"motion": 0.35, "stability": 0.25, "burst": 0.40}
SHAKEN, BLURRED, BLUR_AT = 0.45, 0.55, 0.5
#: Zones of 8-bit brightness begin here.
ZONES = [0, 23, 46, 69, 92, 115, 140, 163, 186, 209, 232]
#: A silent peak, the least strength of a tempo, the beats a minute that are looked for.
SILENT, STRONG, BEATS = 0.01, 0.30, (60.0, 180.0)
#: Weight of a judge's score, and how far a profile may tilt a rank.
JUDGED, TILT = 0.6, 0.15


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def salience(df: DataFrame, keys: list[str], order: list[str], moment: str, appearance: str, faces: str) -> DataFrame:
    """df with salience: the moment, the change of appearance and the change of the number of faces."""
    step = F.abs(F.col(faces) - F.lag(faces).over(Window.partitionBy(*keys).orderBy(*order)))
    rows = df.withColumn("_faces", F.coalesce(step, F.lit(0)).cast("double"))
    rows = robust_norm(robust_norm(rows, keys, appearance, "_a"), keys, "_faces", "_f")
    out = SALIENCE["moment"] * clamp(F.col(moment)) + SALIENCE["appearance"] * F.col("_a") + SALIENCE["faces"] * F.col("_f")
    return rows.withColumn("salience", out).drop("_faces", "_a", "_f")


def temporal(df: DataFrame, keys: list[str], order: list[str], dx: str, dy: str, steady: str, scale: float, moment: str, appearance: str, faces: str, still: float = 0.64) -> DataFrame:
    """df with continuity, stability, burst and their blend, score_temporal."""
    rows = salience(df, keys, order, moment, appearance, faces)
    rows = rows.withColumns({"continuity": motion_continuity(rows, keys, order, dx, dy, still=still), "burst": local_event(keys, order, "salience")})
    rows = smoothness(rows, keys, order, steady, scale).withColumnRenamed("smoothness", "stability")
    blend = TEMPORAL["motion"] * F.col("continuity") + TEMPORAL["stability"] * F.col("stability") + TEMPORAL["burst"] * F.col("burst")
    return rows.withColumn("score_temporal", clamp(blend))


def shake(df: DataFrame, keys: list[str], size: str, continuity: str) -> DataFrame:
    """df with shake: fast motion that goes nowhere."""
    return robust_norm(df, keys, size, "_size").withColumn("shake", clamp(F.col("_size") * (1 - clamp(F.col(continuity))))).drop("_size")


def blur(df: DataFrame, keys: list[str], sharpness: str) -> DataFrame:
    """df with blur: 0 at the clip's median sharpness, 1 at half of it."""
    middle = df.groupBy(*keys).agg(F.median(sharpness).alias("_mid"))
    loss = clamp((1 - F.col(sharpness) / F.col("_mid")) / (1 - BLUR_AT))
    return df.join(middle, keys).withColumn("blur", F.when(F.col("_mid") > 0, loss).otherwise(0.0)).drop("_mid")


def rotation(df: DataFrame, keys: list[str], axes: list[str], out: str = "imu") -> DataFrame:
    """df with the length of the angular velocity over its 95th percentile, at most 1."""
    length = F.sqrt(reduce(lambda a, b: a + b, [F.col(a) * F.col(a) for a in axes]))
    return robust_norm(df.withColumn("_length", length), keys, "_length", out).drop("_length")


def resampled(series: DataFrame, times: DataFrame, keys: list[str], index: str, value: str, time: str, duration: str) -> DataFrame:
    """times with value: a series of even steps over the duration, interpolated at each time and clamped at its ends.

    series: index 0 .. n - 1 and value by key; times: time and duration by key. Both neighbours come by joins on the index.
    """
    last = series.groupBy(*keys).agg(F.max(index).alias("_last"))
    at = clamp(F.col(time) / F.col(duration) * F.col("_last"), 0.0, float("inf"))
    rows = times.join(last, keys, "left").withColumn("_at", F.when(F.col(duration) > 0, F.least(at, F.col("_last").cast("double"))))
    low = series.select(*keys, F.col(index).alias("_i"), F.col(value).alias("_low"))
    high = series.select(*keys, F.col(index).alias("_j"), F.col(value).alias("_high"))
    rows = rows.withColumns({"_i": F.floor("_at"), "_j": F.ceil("_at")}).join(low, [*keys, "_i"], "left").join(high, [*keys, "_j"], "left")
    between = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.col("_i"))
    return rows.withColumn(value, F.coalesce(between, F.lit(0.0))).drop("_last", "_at", "_i", "_j", "_low", "_high")


def projected(points: DataFrame, keys: list[str], lat: str, lon: str, width: float = 320, height: float = 190, pad: float = 14) -> DataFrame:
    """points with x and y: tracks fitted into a box, north up, by an equirectangular map. A track in one place has none."""
    known = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    box = known.groupBy(*keys).agg(*[f(c).alias(f"_{n}{c2}") for c, c2 in ((lat, "a"), (lon, "o")) for n, f in (("lo", F.min), ("hi", F.max))])
    narrow = F.greatest(F.lit(0.01), F.cos(F.radians((F.col("_loa") + F.col("_hia")) / 2)))
    box = box.withColumn("_c", narrow).withColumns({"_dx": (F.col("_hio") - F.col("_loo")) * F.col("_c"), "_dy": F.col("_hia") - F.col("_loa")})
    w, h = float(width - 2 * pad), float(height - 2 * pad)
    fit = F.least(F.when(F.col("_dx") > 0, w / F.col("_dx")), F.when(F.col("_dy") > 0, h / F.col("_dy")))
    rows = known.join(box.withColumn("_s", fit), keys).filter("_s is not null")
    x = pad + (w - F.col("_dx") * F.col("_s")) / 2 + (F.col(lon) - F.col("_loo")) * F.col("_c") * F.col("_s")
    y = pad + (h - F.col("_dy") * F.col("_s")) / 2 + (F.col("_hia") - F.col(lat)) * F.col("_s")
    return rows.withColumns({"x": x, "y": y}).select(*points.columns, "x", "y")


def window_signals(frames: DataFrame, keys: list[str], motion: str, stability: str, burst: str, quality: str) -> DataFrame:
    """Of each window: mean motion and stability, the highest burst, mean quality."""
    return frames.groupBy(*keys).agg(F.avg(motion).alias("motion"), F.avg(stability).alias("stability"), F.max(burst).alias("burst"), F.avg(quality).alias("quality"))


SIGNALS = ["motion", "stability", "burst", "quality"]


def taste(windows: DataFrame, keys: list[str], decision: str) -> DataFrame:
    """What a shooter's kept windows have more of than the culled ones, by signal. Null if there are none of either."""
    mean = lambda s, d: F.avg(F.when(F.col(decision) == d, F.coalesce(s, F.lit(0.0))))
    decided = F.count_if(F.col(decision).isin("keep", "cull"))
    return windows.groupBy(*keys).agg(decided.alias("n"), *[(mean(s, "keep") - mean(s, "cull")).alias(s) for s in SIGNALS])


def tilted(windows: DataFrame, keys: list[str], preference: dict[str, float]) -> DataFrame:
    """windows with tilt: a factor near 1 for signals above the clip's median that the profile prefers."""
    middle = windows.groupBy(*keys).agg(*[F.median(s).alias(f"_{s}") for s in SIGNALS])
    bias = reduce(lambda a, b: a + b, [F.coalesce(p * (F.col(s) - F.col(f"_{s}")), F.lit(0.0)) for s, p in preference.items()])
    return windows.join(middle, keys).withColumn("tilt", 1 + clamp(bias, -TILT, TILT)).drop(*[f"_{s}" for s in SIGNALS])


def judged(candidates: DataFrame, verdicts: DataFrame, key: list[str], proxy: str, score: str) -> DataFrame:
    """candidates with blended (the proxy and a judge's score of 0 to 100) and moved; unjudged ones keep their proxy."""
    p = F.coalesce(F.col(proxy), F.lit(0.0))
    blended = F.coalesce((1 - JUDGED) * p + JUDGED * F.col(score) / 100, p)
    return candidates.join(verdicts, key, "left").withColumns({"blended": blended, "moved": F.abs(blended - p) > 1e-9})


def reasons(strengths: list[tuple[Column, Column, Column]], most: int = 3) -> Column:
    """The strongest fragments, joined by ' + '. strengths: condition, strength and text, in the order of ties."""
    rows = F.array_compact(F.array(*[F.when(c, F.struct((-s).alias("s"), F.lit(i).alias("i"), t.alias("t"))) for i, (c, s, t) in enumerate(strengths)]))
    return F.array_join(F.transform(F.slice(F.sort_array(rows), 1, most), lambda x: x["t"]), " + ")


def zone_shares(df: DataFrame, keys: list[str], luma: str) -> DataFrame:
    """Share of each zone of brightness by key, empty zones too."""
    zone = F.size(F.filter(F.array(*[F.lit(z) for z in ZONES]), lambda z: z <= F.col(luma))) - 1
    counts = df.groupBy(*keys).agg(*[F.count_if(zone == i).alias(f"z{i}") for i in range(len(ZONES))])
    total = F.greatest(reduce(lambda a, b: a + b, [F.col(f"z{i}") for i in range(len(ZONES))]), F.lit(1))
    return counts.select(*keys, F.posexplode(F.array(*[F.col(f"z{i}") / total for i in range(len(ZONES))])).alias("zone", "share"))


def divergence(p: DataFrame, q: DataFrame, keys: list[str], eps: float = 1e-9) -> DataFrame:
    """Kullback-Leibler divergence of the shares of p from those of q (by zone), with eps added to both."""
    known = p.join(F.broadcast(q.select("zone", F.col("share").alias("_q"))), "zone")  # q: one row per zone
    total = 1 + eps * len(ZONES)
    a, b = (F.col("share") + eps) / total, (F.col("_q") + eps) / total
    return known.groupBy(*keys).agg(F.sum(a * F.ln(a / b)).alias("divergence"))


def _there(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def _lags(hop: float) -> range:
    return range(max(1, round(60 / BEATS[1] / hop)), round(60 / BEATS[0] / hop))


def _onsets(df: DataFrame, keys: list[str], order: list[str], onset: str, hop: float) -> DataFrame:
    """df with _n, the clip's rows, _o, the onset less the clip's mean, and the _o of so many rows before. One sort: no means are joined."""
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.filter(_there(keys)).withColumns({"_mean": F.avg(onset).over(whole), "_n": F.count("*").over(whole), **{f"_{k}": F.lag(onset, k).over(w) for k in _lags(hop)}})
    return rows.withColumns({"_o": F.col(onset) - F.col("_mean"), **{f"_{k}": F.col(f"_{k}") - F.col("_mean") for k in _lags(hop)}})


def _correlations(hop: float) -> dict[str, Column]:
    return {"_s": F.sum(F.col("_o") * F.col("_o"))} | {f"_s{k}": F.sum(F.col("_o") * F.col(f"_{k}")) for k in _lags(hop)}


def _tempo(hop: float) -> dict[str, Column]:
    """tempo and strength from _n and the sums of _correlations."""
    # lags stay below the last one that the clip has
    best = F.array_max(F.array_compact(F.array(*[F.when(F.lit(k) < F.col("_n") - 1, F.struct((F.coalesce(F.col(f"_s{k}"), F.lit(0.0)) / F.col("_s")).alias("s"), F.lit(-k).alias("k"))) for k in _lags(hop)])))
    found = F.when((F.col("_n") >= 16) & (F.col("_s") > 0), best)
    return {"tempo": F.coalesce(F.round(60.0 / (-found["k"] * hop), 1), F.lit(0.0)), "strength": F.coalesce(clamp(found["s"]), F.lit(0.0))}


def tempo(df: DataFrame, keys: list[str], order: list[str], onset: str, hop: float) -> DataFrame:
    """tempo (beats a minute) and strength by key: the lag of the highest autocorrelation of the onsets; 0 if there is none."""
    sums = _onsets(df.select(*dict.fromkeys([*keys, *order, onset])), keys, order, onset, hop).groupBy(*keys).agg(F.max("_n").alias("_n"), *[c.alias(n) for n, c in _correlations(hop).items()])
    return sums.select(*keys, *[c.alias(n) for n, c in _tempo(hop).items()])


def with_tempo(df: DataFrame, keys: list[str], order: list[str], onset: str, hop: float) -> DataFrame:
    """df with the tempo and strength of each row's key: sums over the clip's rows where they stand sorted, instead of a join with `tempo`."""
    whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = _onsets(df, keys, order, onset, hop).withColumns({n: c.over(whole) for n, c in _correlations(hop).items()})
    return rows.withColumns(_tempo(hop)).select(*df.columns, "tempo", "strength")


def beats(df: DataFrame, tempos: DataFrame, keys: list[str], time: str, onset: str, most: int = 2000) -> DataFrame:
    """The beats of each key that has a clear tempo, in phase with its strongest onset (the first of equals)."""
    ends = df.groupBy(*keys).agg(F.max_by(time, F.struct(onset, -F.col(time))).alias("_p"), F.max(time).alias("_e"))
    rows = ends.join(tempos.filter((F.col("tempo") > 0) & (F.col("strength") >= STRONG)), keys).withColumn("_d", 60.0 / F.col("tempo"))
    rows = rows.withColumn("_p", F.pmod("_p", "_d"))
    count = F.least(F.floor((F.col("_e") - F.col("_p")) / F.col("_d")), F.lit(most - 1))
    return rows.filter("_p <= _e").select(*keys, F.explode(F.transform(F.sequence(F.lit(0), count.cast("int")), lambda i: F.col("_p") + i * F.col("_d"))).alias("beat"))


def loud_runs(df: DataFrame, keys: list[str], time: str, loudness: str, sounds: Column, confidence: Column, floor: float, hop: float, least: float) -> DataFrame:
    """Runs of rows that sound so and are louder than a share of the clip's peak: s, e, n and mean confidence. Silent clips have none."""
    w = Window.partitionBy(*keys).orderBy(time)
    peak = F.max(loudness).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    loud = F.col(loudness) > F.greatest(floor * F.col("_peak"), F.lit(0.5 * SILENT))
    # what is not needed behind the sort stays out of it
    rows = df.filter(_there(keys)).select(*keys, time, loudness, sounds.alias("_sounds"), clamp(confidence).alias("_conf"))
    rows = rows.withColumn("_peak", peak).filter(F.col("_peak") >= SILENT).withColumn("_on", F.col("_sounds") & loud)
    rows = rows.withColumn("_new", F.when(F.lag("_on").over(w).eqNullSafe(F.col("_on")), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    runs = rows.filter("_on").groupBy(*keys, "_run").agg(F.min(time).alias("s"), (F.max(time) + hop).alias("e"), F.avg("_conf").alias("confidence")).drop("_run")
    return runs.filter(F.col("e") - F.col("s") + 1e-9 >= least)
