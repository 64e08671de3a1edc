"""Signals of clips: temporal scores, quality segments, tempo, profiles of taste, tracks on a map."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from proofsheet.operators import signals as G
from proofsheet.operators import windows as W
from proofsheet.operators.intervals import true_runs
from proofsheet.plans.catalog import query
from proofsheet.plans.frames import FRAME_SQL, KEYS, ORDER, frames
from proofsheet.plans.similar import geo

_C = "(PARTITION BY clip_id ORDER BY t, frame)"
_W2 = "(PARTITION BY clip_id ORDER BY t, frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
_W4 = "(PARTITION BY clip_id ORDER BY t, frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)"
_UNIT = "least(greatest({}, 0.0), 1.0)"

SALIENCE_SQL = f"""{FRAME_SQL}, fa AS (SELECT *, CAST(coalesce(abs(k % 4 - lag(k % 4) OVER {_C}), 0) AS DOUBLE) AS fa FROM v_frame),
 top AS (SELECT clip_id, quantile_cont(abs(sharp), 0.95) AS ps, quantile_cont(fa, 0.95) AS pf FROM fa GROUP BY clip_id),
 sal AS (SELECT fa.*, 0.5 * {_UNIT.format('score_final')} + 0.3 * CASE WHEN ps > 0 THEN least(abs(sharp) / ps, 1.0) ELSE 0.0 END + 0.2 * CASE WHEN pf > 0 THEN least(fa / pf, 1.0) ELSE 0.0 END AS salience FROM fa JOIN top ON top.clip_id = fa.clip_id)"""
TEMPORAL_SQL = f"""{SALIENCE_SQL}, ch AS (SELECT *, coalesce(abs(sharp - lag(sharp) OVER {_C}), 0.0) AS ch FROM sal),
 tp AS (SELECT *, CASE WHEN avg(sqrt(dx * dx + dy * dy)) OVER {_W2} < 0.64 OR sum(sqrt(dx * dx + dy * dy)) OVER {_W2} <= 0 THEN 1.0 ELSE least(sqrt(power(sum(dx) OVER {_W2}, 2) + power(sum(dy) OVER {_W2}, 2)) / sum(sqrt(dx * dx + dy * dy)) OVER {_W2}, 1.0) END AS continuity,
 exp(-avg(ch) OVER {_W2} / 0.5) AS stability, CASE WHEN stddev_pop(salience) OVER {_W4} < 1e-9 THEN 0.0 ELSE {_UNIT.format(f'(salience - avg(salience) OVER {_W4}) / stddev_pop(salience) OVER {_W4} / 2')} END AS burst FROM ch),
 ts AS (SELECT *, {_UNIT.format('0.35 * continuity + 0.25 * stability + 0.40 * burst')} AS score_temporal FROM tp)"""


def _faces(spark, sf):
    return frames(spark, sf).withColumn("faces", F.col("k") % 4)


def scored(spark, sf):
    return G.temporal(_faces(spark, sf), KEYS, ORDER, "dx", "dy", "sharp", 0.5, "score_final", "sharp", "faces")


@query(f"WITH {SALIENCE_SQL} SELECT frame, salience FROM sal")
def salience(spark, sf):
    return G.salience(_faces(spark, sf), KEYS, ORDER, "score_final", "sharp", "faces").select("frame", "salience")


@query(f"WITH {TEMPORAL_SQL} SELECT frame, continuity, stability, burst, score_temporal FROM ts")
def temporal_scores(spark, sf):
    return scored(spark, sf).select("frame", "continuity", "stability", "burst", "score_temporal")


_DAYS = f"""{TEMPORAL_SQL}, wn AS (SELECT *, CAST(floor((t - min(t) OVER (PARTITION BY clip_id)) / 48.0) AS BIGINT) AS window_no FROM ts)"""


@query(f"WITH {_DAYS} SELECT clip_id, window_no, count(*) AS n, avg(score_final) AS mean_final, max(score_temporal) AS peak, arg_max(frame, (score_temporal, -frame)) AS best_frame FROM wn GROUP BY ALL")
def temporal_windows(spark, sf):
    return W.tumbling(scored(spark, sf), KEYS, "t", 48.0, "score_final", "score_temporal", "frame")


_SHAKE = f"""{TEMPORAL_SQL}, q AS (SELECT clip_id, quantile_cont(sqrt(dx * dx + dy * dy), 0.95) AS pm, median(sharp) AS mid, quantile_cont(sqrt((k % 11 - 5) * (k % 11 - 5) + (k % 13 - 6) * (k % 13 - 6) + (k % 3 - 1) * (k % 3 - 1)), 0.95) AS pg FROM ts GROUP BY clip_id),
 sb AS (SELECT ts.*, {_UNIT.format('CASE WHEN pm > 0 THEN least(sqrt(dx * dx + dy * dy) / pm, 1.0) ELSE 0.0 END * (1 - continuity)')} AS shake, CASE WHEN mid > 0 THEN {_UNIT.format('(1 - sharp / mid) / 0.5')} ELSE 0.0 END AS blur,
 CASE WHEN pg > 0 THEN least(sqrt((k % 11 - 5) * (k % 11 - 5) + (k % 13 - 6) * (k % 13 - 6) + (k % 3 - 1) * (k % 3 - 1)) / pg, 1.0) ELSE 0.0 END AS imu FROM ts JOIN q ON q.clip_id = ts.clip_id)"""


def _quality(spark, sf):
    rows = scored(spark, sf).withColumns({"size": F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), "gx": F.col("k") % 11 - 5, "gy": F.col("k") % 13 - 6, "gz": F.col("k") % 3 - 1})
    return G.rotation(G.blur(G.shake(rows, KEYS, "size", "continuity"), KEYS, "sharp"), KEYS, ["gx", "gy", "gz"])


@query(f"WITH {_SHAKE} SELECT frame, shake, blur, imu FROM sb")
def shake_and_blur(spark, sf):
    return _quality(spark, sf).select("frame", "shake", "blur", "imu")


_RUNS = "SELECT '{0}' AS kind, clip_id, min(t) AS s, max(t) + 1.0 AS e, count(*) AS n FROM (SELECT *, sum(CASE WHEN was = f THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id ORDER BY t) AS run FROM (SELECT *, lag(f) OVER (PARTITION BY clip_id ORDER BY t) AS was FROM (SELECT clip_id, t, {1} AS f FROM sb))) WHERE f GROUP BY clip_id, run HAVING max(t) + 1.0 - min(t) >= 24"


@query(f"WITH {_SHAKE} {_RUNS.format('shake', 'greatest(shake, imu) >= 0.45')} UNION ALL {_RUNS.format('blur', 'blur >= 0.55')}")
def quality_segments(spark, sf):
    rows = _quality(spark, sf).withColumns({"shaken": F.greatest("shake", "imu") >= G.SHAKEN, "blurred": F.col("blur") >= G.BLURRED})
    runs = [true_runs(rows, KEYS, "t", flag, 1.0, 24.0).select(F.lit(kind).alias("kind"), "clip_id", "s", "e", "n") for kind, flag in (("shake", "shaken"), ("blur", "blurred"))]
    return runs[0].union(runs[1])


@query(f"""WITH {FRAME_SQL}, i AS (SELECT clip_id, frame, sharp, row_number() OVER {_C} - 1 AS i, t - min(t) OVER (PARTITION BY clip_id) AS ra, max(t) OVER (PARTITION BY clip_id) - min(t) OVER (PARTITION BY clip_id) AS d, count(*) OVER (PARTITION BY clip_id) - 1 AS last FROM v_frame),
 x AS (SELECT *, CASE WHEN d > 0 THEN least(greatest(ra / d * last, 0.0), last) END AS x FROM i)
 SELECT x.frame, coalesce(a.sharp + (b.sharp - a.sharp) * (x - floor(x)), 0.0) AS sharp FROM x LEFT JOIN i a ON a.clip_id = x.clip_id AND a.i = CAST(floor(x) AS BIGINT) LEFT JOIN i b ON b.clip_id = x.clip_id AND b.i = CAST(ceil(x) AS BIGINT)""")
def resampled_series(spark, sf):
    f = frames(spark, sf)
    series = f.select("clip_id", "sharp", (F.row_number().over(Window.partitionBy("clip_id").orderBy(*ORDER)) - 1).alias("i"))
    ends = f.groupBy("clip_id").agg(F.min("t").alias("t0"), (F.max("t") - F.min("t")).alias("d"))
    times = f.join(ends, "clip_id").select("clip_id", "frame", (F.col("t") - F.col("t0")).alias("at"), "d")
    return G.resampled(series, times, KEYS, "i", "sharp", "at", "d").select("frame", "sharp")


@query("""WITH geo AS (SELECT event_id AS photo_id, event_id % 5 AS track, 40 + (event_id * 7 % 97) * 0.01 AS lat, 2 + (event_id * 13 % 101) * 0.01 AS lon FROM events),
 b AS (SELECT track, min(lat) AS la, max(lat) AS ha, min(lon) AS lo, greatest(0.01, cos(radians((min(lat) + max(lat)) / 2))) AS c, (max(lon) - min(lon)) * greatest(0.01, cos(radians((min(lat) + max(lat)) / 2))) AS dx, max(lat) - min(lat) AS dy FROM geo GROUP BY track),
 f AS (SELECT *, least(CASE WHEN dx > 0 THEN 292 / dx END, CASE WHEN dy > 0 THEN 162 / dy END) AS s FROM b)
 SELECT photo_id, geo.track, 14 + (292 - dx * s) / 2 + (lon - lo) * c * s AS x, 14 + (162 - dy * s) / 2 + (ha - lat) * s AS y FROM geo JOIN f ON f.track = geo.track WHERE s IS NOT NULL""")
def projected_track(spark, sf):
    points = geo(spark, sf).select("photo_id", (F.col("photo_id") % 5).alias("track"), "lat", "lon")
    return G.projected(points, ["track"], "lat", "lon").select("photo_id", "track", "x", "y")


_SIGNALS = f"""{_DAYS}, sg AS (SELECT clip_id, window_no, avg(continuity) AS motion, avg(stability) AS stability, max(burst) AS burst, avg(score_final) AS quality FROM wn GROUP BY ALL)"""


def signals(spark, sf):
    start = frames(spark, sf).groupBy("clip_id").agg(F.min("t").alias("t0"))
    rows = scored(spark, sf).join(start, "clip_id").withColumn("window_no", F.floor((F.col("t") - F.col("t0")) / 48.0))
    return G.window_signals(rows, ["clip_id", "window_no"], "continuity", "stability", "burst", "score_final")


@query(f"WITH {_SIGNALS} SELECT clip_id, window_no, motion, stability, burst, quality FROM sg")
def window_signals(spark, sf):
    return signals(spark, sf)


PREFERENCE = {"motion": 0.2, "stability": -0.1, "burst": 0.3, "quality": 0.4}


@query(f"""WITH {_SIGNALS}, md AS (SELECT clip_id, median(motion) AS m, median(stability) AS s, median(burst) AS b, median(quality) AS q FROM sg GROUP BY clip_id)
 SELECT sg.clip_id, window_no, 1 + least(greatest(0.2 * (motion - m) + -0.1 * (stability - s) + 0.3 * (burst - b) + coalesce(0.4 * (quality - q), 0.0), -0.15), 0.15) AS tilt FROM sg JOIN md ON md.clip_id = sg.clip_id""")
def profile_tilt(spark, sf):
    return G.tilted(signals(spark, sf), KEYS, PREFERENCE).select("clip_id", "window_no", "tilt")


_DECIDED = "CASE window_no % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'cull' ELSE 'maybe' END"
_GAP = ", ".join(f"avg(coalesce({s}, 0.0)) FILTER ({_DECIDED} = 'keep') - avg(coalesce({s}, 0.0)) FILTER ({_DECIDED} = 'cull') AS {s}" for s in G.SIGNALS)


@query(f"WITH {_SIGNALS} SELECT clip_id, count(*) FILTER ({_DECIDED} <> 'maybe') AS n, {_GAP} FROM sg GROUP BY clip_id")
def reel_taste(spark, sf):
    decided = F.when(F.col("window_no") % 3 == 0, "keep").when(F.col("window_no") % 3 == 1, "cull").otherwise("maybe")
    return G.taste(signals(spark, sf).withColumn("decision", decided), KEYS, "decision")


@query(f"""WITH {_SIGNALS}, j AS (SELECT clip_id, window_no, coalesce(quality, 0.0) AS p, CASE WHEN window_no % 2 = 0 THEN CAST((window_no * 37) % 101 AS DOUBLE) END AS s FROM sg), b AS (SELECT *, coalesce(0.4 * p + 0.6 * s / 100, p) AS blended FROM j)
 SELECT clip_id, window_no, blended, abs(blended - p) > 1e-9 AS moved, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY blended DESC, window_no) AS INT) AS rank FROM b""")
def judged_rerank(spark, sf):
    s = signals(spark, sf)
    verdicts = s.filter("window_no % 2 = 0").select("clip_id", "window_no", ((F.col("window_no") * 37) % 101).cast("double").alias("judge"))
    rows = G.judged(s, verdicts, ["clip_id", "window_no"], "quality", "judge")
    return rows.select("clip_id", "window_no", "blended", "moved", F.row_number().over(Window.partitionBy("clip_id").orderBy(F.round("blended", W.DIGITS).desc(), "window_no")).alias("rank"))


#: Fragments of reasons, and the words of scenes.
FRAGMENTS = {"burst": "精彩瞬间", "motion": "平稳运镜", "stability": "画面稳定", "quality": "高画质", "none": "稳定可用片段"}


@query(f"""WITH {_SIGNALS}, fr AS (SELECT *, list_filter([CASE WHEN burst >= 0.4 THEN {{'s': -burst, 'i': 0, 't': '精彩瞬间'}} END, CASE WHEN motion >= 0.8 THEN {{'s': -(motion * 0.9), 'i': 1, 't': '平稳运镜'}} END, CASE WHEN stability >= 0.85 THEN {{'s': -(stability * 0.85), 'i': 2, 't': '画面稳定'}} END, CASE WHEN quality >= 0.6 THEN {{'s': -quality, 'i': 3, 't': '高画质'}} END], lambda x: x IS NOT NULL) AS f FROM sg)
 SELECT clip_id, window_no, CASE WHEN len(f) = 0 THEN '稳定可用片段' ELSE array_to_string(list_transform(list_sort(f)[1:2], lambda x: x.t), ' + ') END AS why FROM fr""")
def window_reasons(spark, sf):
    c = lambda n: F.col(n)
    why = G.reasons([(c("burst") >= 0.4, c("burst"), F.lit(FRAGMENTS["burst"])), (c("motion") >= 0.8, c("motion") * 0.9, F.lit(FRAGMENTS["motion"])), (c("stability") >= 0.85, c("stability") * 0.85, F.lit(FRAGMENTS["stability"])), (c("quality") >= 0.6, c("quality"), F.lit(FRAGMENTS["quality"]))], 2)
    return signals(spark, sf).select("clip_id", "window_no", F.when(why == "", FRAGMENTS["none"]).otherwise(why).alias("why"))


_ZONES = "[" + ", ".join(map(str, G.ZONES)) + "]"
_ZONE_SQL = f"""{FRAME_SQL}, z AS (SELECT scene, len(list_filter({_ZONES}, lambda x: x <= frame % 256)) - 1 AS zone FROM v_frame),
 zs AS (SELECT z.scene, zone, count(*) / max(n) AS share FROM z JOIN (SELECT scene, count(*) AS n FROM z GROUP BY scene) c ON c.scene = z.scene GROUP BY z.scene, zone), za AS (SELECT zone, count(*) / max(n) AS share FROM z, (SELECT count(*) AS n FROM z) GROUP BY zone),
 grid AS (SELECT scene, zone FROM (SELECT DISTINCT scene FROM z), (SELECT unnest(range(0, {len(G.ZONES)})) AS zone))"""


def _lit(spark, sf):
    return frames(spark, sf).withColumn("luma", F.col("frame") % 256)


@query(f"WITH {_ZONE_SQL} SELECT grid.scene, CAST(grid.zone AS INT) AS zone, coalesce(share, 0.0) AS share FROM grid LEFT JOIN zs ON zs.scene = grid.scene AND zs.zone = grid.zone")
def zone_shares(spark, sf):
    return G.zone_shares(_lit(spark, sf), ["scene"], "luma")


@query(f"""WITH {_ZONE_SQL}, pq AS (SELECT grid.scene, (coalesce(zs.share, 0.0) + 1e-9) / (1 + 11e-9) AS p, (coalesce(za.share, 0.0) + 1e-9) / (1 + 11e-9) AS q FROM grid LEFT JOIN zs ON zs.scene = grid.scene AND zs.zone = grid.zone LEFT JOIN za ON za.zone = grid.zone)
 SELECT scene, sum(p * ln(p / q)) AS divergence FROM pq GROUP BY scene""")
def zone_divergence(spark, sf):
    rows = _lit(spark, sf)
    whole = G.zone_shares(rows.withColumn("one", F.lit(1)), ["one"], "luma").drop("one")
    return G.divergence(G.zone_shares(rows, ["scene"], "luma"), whole, ["scene"])


_LAGS = list(range(7, 20))
_TEMPO = f"""{FRAME_SQL}, on_ AS (SELECT clip_id, t, frame, k - avg(k) OVER (PARTITION BY clip_id) AS o, count(*) OVER (PARTITION BY clip_id) AS n FROM v_frame),
 lg AS (SELECT *, {', '.join(f'lag(o, {k}) OVER {_C} AS l{k}' for k in _LAGS)} FROM on_), ac AS (SELECT clip_id, max(n) AS n, sum(o * o) AS s, {', '.join(f'coalesce(sum(o * l{k}), 0.0) AS a{k}' for k in _LAGS)} FROM lg GROUP BY clip_id),
 bl AS (SELECT clip_id, CASE WHEN n >= 16 AND s > 0 THEN list_max(list_filter([{', '.join(f"CASE WHEN {k} < n - 1 THEN {{'s': a{k} / s, 'k': -{k}}} END" for k in _LAGS)}], lambda x: x IS NOT NULL)) END AS b FROM ac),
 tmp AS (SELECT clip_id, coalesce(round(60.0 / (-b.k * 0.05), 1), 0.0) AS tempo, coalesce({_UNIT.format('b.s')}, 0.0) AS strength FROM bl)"""


def tempos(spark, sf):
    return G.tempo(frames(spark, sf), KEYS, ORDER, "k", 0.05)


@query(f"WITH {_TEMPO} SELECT clip_id, tempo, strength FROM tmp")
def clip_tempo(spark, sf):
    return tempos(spark, sf)


@query(f"""WITH {_TEMPO}, pk AS (SELECT clip_id, arg_max(t, (k, -t)) AS p, max(t) AS e FROM v_frame GROUP BY clip_id), pd AS (SELECT pk.clip_id, e, 60.0 / tempo AS d, p - floor(p / (60.0 / tempo)) * (60.0 / tempo) AS p FROM pk JOIN tmp ON tmp.clip_id = pk.clip_id WHERE tempo > 0 AND strength >= 0.3)
 SELECT clip_id, count(*) AS n FROM (SELECT clip_id, unnest(range(0, CAST(least(floor((e - p) / d), 1999) AS BIGINT) + 1)) AS i FROM pd WHERE p <= e) GROUP BY clip_id""")
def beat_grid(spark, sf):
    return G.beats(frames(spark, sf), tempos(spark, sf), KEYS, "t", "k").groupBy("clip_id").agg(F.count("*").alias("n"))


def _sound_sql(kind, sounds, conf, floor, least, gate=""):
    return f"""SELECT '{kind}' AS kind, clip_id, min(t) AS s, max(t) + 1.0 AS e, avg(conf) AS confidence FROM (SELECT *, sum(CASE WHEN was = f THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id ORDER BY t) AS run FROM (SELECT *, lag(f) OVER (PARTITION BY clip_id ORDER BY t) AS was FROM
 (SELECT v.clip_id, t, {sounds} AND sharp > greatest({floor} * pk, 0.005) AS f, {_UNIT.format(conf)} AS conf FROM v_frame v JOIN (SELECT clip_id, max(sharp) AS pk FROM v_frame GROUP BY clip_id HAVING max(sharp) >= 0.01) p ON p.clip_id = v.clip_id {gate}))) WHERE f GROUP BY clip_id, run HAVING max(t) + 1.0 - min(t) + 1e-9 >= {least}"""


@query(f"WITH {_TEMPO} {_sound_sql('applause', 'score_final > 0.30', '(score_final - 0.30) / 0.70', 0.35, 0.6)} UNION ALL " + _sound_sql("music", "score_final < 0.12", "(0.12 - score_final) / 0.12", 0.12, 3.0, "JOIN tmp ON tmp.clip_id = v.clip_id JOIN (SELECT clip_id, stddev_pop(sharp) < 0.5 * (avg(sharp) + 1e-9) AS steady FROM v_frame GROUP BY clip_id) st ON st.clip_id = v.clip_id WHERE strength >= 0.3 OR steady"))
def sound_events(spark, sf):
    """Applause is flat and loud; music is tonal, and its clip has a tempo or an even loudness. Sharpness stands in for loudness."""
    f = frames(spark, sf)
    flat = F.col("score_final")
    # all statistics of a clip come from rows that are sorted once: nothing is joined back
    whole = Window.partitionBy(*KEYS).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    even = F.stddev_pop("sharp").over(whole) < 0.5 * (F.avg("sharp").over(whole) + 1e-9)
    paced = G.with_tempo(f.select(*KEYS, *ORDER, "k", "sharp", "score_final"), KEYS, ORDER, "k", 0.05).withColumn("even", even)
    musical = paced.filter((F.col("strength") >= G.STRONG) | F.col("even"))
    applause = G.loud_runs(f, KEYS, "t", "sharp", flat > 0.30, (flat - 0.30) / 0.70, 0.35, 1.0, 0.6)
    music = G.loud_runs(musical, KEYS, "t", "sharp", flat < 0.12, (0.12 - flat) / 0.12, 0.12, 1.0, 3.0)
    return applause.withColumn("kind", F.lit("applause")).unionByName(music.withColumn("kind", F.lit("music"))).select("kind", "clip_id", "s", "e", "confidence")
