"""Frames in time order: motion, stability, events, windows, reels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from proofsheet.operators import windows as W
from proofsheet.plans.catalog import query
from proofsheet.plans.views import PHOTO_SQL, photos

FRAME_SQL = f"""{PHOTO_SQL}, v_frame AS (SELECT run_id AS clip_id, photo_id AS frame, scene, score_final, sharp, k, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9 AS t, k % 7 - 3.0 AS dx, k % 5 - 2.0 AS dy FROM v_photo)"""


def frames(spark, sf):
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3.6e9
    return photos(spark, sf).select(F.col("run_id").alias("clip_id"), F.col("photo_id").alias("frame"), "scene", "score_final", "sharp", "k", hours.alias("t"), (F.col("k") % 7 - 3.0).alias("dx"), (F.col("k") % 5 - 2.0).alias("dy"))


KEYS, ORDER = ["clip_id"], ["t", "frame"]
_OVER = "(PARTITION BY clip_id ORDER BY t, frame ROWS BETWEEN {0} PRECEDING AND {0} FOLLOWING)"
_W2, _W4 = _OVER.format(2), _OVER.format(4)


@query(f"""WITH {FRAME_SQL} SELECT frame, CASE WHEN avg(sqrt(dx * dx + dy * dy)) OVER {_W2} < 0.64 OR sum(sqrt(dx * dx + dy * dy)) OVER {_W2} <= 0 THEN 1.0
 ELSE least(sqrt(power(sum(dx) OVER {_W2}, 2) + power(sum(dy) OVER {_W2}, 2)) / sum(sqrt(dx * dx + dy * dy)) OVER {_W2}, 1.0) END AS continuity FROM v_frame""")
def motion_continuity(spark, sf):
    f = frames(spark, sf)
    return f.select("frame", W.motion_continuity(f, KEYS, ORDER, "dx", "dy", still=0.64).alias("continuity"))


@query(f"""WITH {FRAME_SQL}, d AS (SELECT *, coalesce(abs(sharp - lag(sharp) OVER (PARTITION BY clip_id ORDER BY t, frame)), 0.0) AS d FROM v_frame) SELECT frame, exp(-avg(d) OVER {_W2} / 0.5) AS smoothness FROM d""")
def temporal_stability(spark, sf):
    return W.smoothness(frames(spark, sf), KEYS, ORDER, "sharp", 0.5).select("frame", "smoothness")


@query(f"""WITH {FRAME_SQL} SELECT frame, CASE WHEN stddev_pop(sharp) OVER {_W4} < 1e-9 THEN 0.0 ELSE least(greatest((sharp - avg(sharp) OVER {_W4}) / stddev_pop(sharp) OVER {_W4} / 2, 0.0), 1.0) END AS event FROM v_frame""")
def burst_event(spark, sf):
    return frames(spark, sf).select("frame", W.local_event(KEYS, ORDER, "sharp").alias("event"))


@query(f"""WITH {FRAME_SQL}, p AS (SELECT clip_id, quantile_cont(abs(dx), 0.95) AS top FROM v_frame GROUP BY clip_id) SELECT frame, CASE WHEN top > 0 THEN least(abs(dx) / top, 1.0) ELSE 0.0 END AS value FROM v_frame f JOIN p ON p.clip_id = f.clip_id""")
def robust_norm(spark, sf):
    return W.robust_norm(frames(spark, sf), KEYS, "dx", "value").select("frame", "value")


@query(f"""WITH {FRAME_SQL} SELECT frame, coalesce((score_final - min(score_final) OVER (PARTITION BY clip_id)) / nullif(max(score_final) OVER (PARTITION BY clip_id) - min(score_final) OVER (PARTITION BY clip_id), 0), 0.0) AS value FROM v_frame""")
def min_max_norm(spark, sf):
    return frames(spark, sf).select("frame", W.min_max(KEYS, "score_final").alias("value"))


@query(f"""WITH {FRAME_SQL}, w AS (SELECT *, CAST(floor((t - min(t) OVER (PARTITION BY clip_id)) / 48.0) AS BIGINT) AS window_no FROM v_frame),
 r AS (SELECT *, row_number() OVER (PARTITION BY clip_id, window_no ORDER BY sharp DESC, frame) AS rn FROM w)
 SELECT clip_id, window_no, count(*) AS n, avg(score_final) AS mean_final, max(sharp) AS peak, max(CASE WHEN rn = 1 THEN frame END) AS best_frame FROM r GROUP BY ALL""")
def tumbling_windows(spark, sf):
    return W.tumbling(frames(spark, sf), KEYS, "t", 48.0, "score_final", "sharp", "frame")


_SLIDE = f"""{FRAME_SQL}, z AS (SELECT *, t - min(t) OVER (PARTITION BY clip_id) AS at_h FROM v_frame),
 s AS (SELECT *, unnest(range(CAST(greatest(0, floor((at_h - 72.0) / 24.0) + 1) AS BIGINT), CAST(floor(at_h / 24.0) AS BIGINT) + 1)) AS window_no FROM z)"""


@query(f"""WITH {_SLIDE} SELECT clip_id, window_no, count(*) AS n, avg(score_final) AS mean_final, max(sharp) AS peak,
 least(greatest(0.30 * least(greatest(1 - stddev_pop(score_final) / 0.25, 0.0), 1.0) + 0.20 * least(count(*) / 3.0, 1.0) + 0.25 * least(greatest(max(sharp), 0.0), 1.0) + 0.25, 0.0), 1.0) AS confidence FROM s GROUP BY ALL""")
def sliding_windows(spark, sf):
    return slid(spark, sf).drop("scene")


def slid(spark, sf):
    # each frame's score is put in places once, not in each of its windows
    rows = W.sliding(frames(spark, sf).withColumn("places", W.in_places("score_final")), KEYS, "t", 72.0, 24.0)
    return rows.groupBy("clip_id", "window_no").agg(F.count("*").alias("n"), W.steady_mean("score_final", F.col("places")).alias("mean_final"), F.max("sharp").alias("peak"), W.confidence("score_final", "sharp", F.lit(1.0)).alias("confidence"), F.min("scene").alias("scene"))


@query(f"""WITH {FRAME_SQL}, c AS (SELECT *, CAST(1 + k % 4 AS DOUBLE) AS dur FROM v_frame) SELECT clip_id, frame, dur FROM (SELECT *, coalesce(sum(dur) OVER (PARTITION BY clip_id ORDER BY score_final DESC, frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY clip_id ORDER BY score_final DESC, frame) AS rn FROM c) WHERE before < 12 AND rn <= 6""")
def assembly_prefix(spark, sf):
    f = frames(spark, sf).withColumn("dur", 1.0 + F.col("k") % 4)
    keep = W.prefix_until(KEYS, [F.desc("score_final"), "frame"], "dur", 12.0, 6)
    return f.withColumn("_keep", keep).filter("_keep").select("clip_id", "frame", "dur")


@query(f"""WITH {FRAME_SQL}, m AS (SELECT clip_id, median(sharp) AS ms, median(score_final) AS mf FROM v_frame GROUP BY clip_id) SELECT frame, CASE WHEN greatest(ms - sharp, mf - score_final) < 0.05 THEN NULL WHEN ms - sharp >= mf - score_final THEN 'sharp' ELSE 'score' END AS why FROM v_frame f JOIN m ON m.clip_id = f.clip_id""")
def why_low(spark, sf):
    f = frames(spark, sf)
    m = f.groupBy("clip_id").agg(F.median("sharp").alias("ms"), F.median("score_final").alias("mf"))
    a, b = F.col("ms") - F.col("sharp"), F.col("mf") - F.col("score_final")
    return f.join(m, "clip_id").select("frame", F.when(F.greatest(a, b) < 0.05, None).when(a >= b, "sharp").otherwise("score").alias("why"))


_LIKE = "greatest(CASE WHEN least(w.e - w.s, c.e - c.s) > 0 THEN greatest(least(w.e, c.e) - greatest(w.s, c.s), 0.0) / least(w.e - w.s, c.e - c.s) ELSE 0.0 END, CASE WHEN w.scene = c.scene AND greatest(w.s, c.s) - least(w.e, c.e) <= 3.0 THEN 0.4 ELSE 0.0 END)"
_SHARE = "CASE WHEN least(w.e - w.s, best.e - best.s) > 0 THEN greatest(least(w.e, best.e) - greatest(w.s, best.s), 0.0) / least(w.e - w.s, best.e - best.s) ELSE 0.0 END"


@query(f"""WITH RECURSIVE {_SLIDE}, a AS (SELECT clip_id, window_no, (avg(score_final) + max(sharp)) / 2 * least(greatest(0.30 * least(greatest(1 - stddev_pop(score_final) / 0.25, 0.0), 1.0) + 0.20 * least(count(*) / 3.0, 1.0) + 0.25 * least(greatest(max(sharp), 0.0), 1.0) + 0.25, 0.0), 1.0) AS base, min(scene) AS scene FROM s GROUP BY ALL),
 g AS (SELECT clip_id, list({{'no': window_no, 's': window_no * 24.0, 'e': window_no * 24.0 + 72.0, 'scene': scene, 'base': base}} ORDER BY window_no) AS pool FROM a GROUP BY clip_id),
 r AS (SELECT clip_id, 0 AS n, pool, [] :: STRUCT("no" BIGINT, s DOUBLE, e DOUBLE, scene VARCHAR, base DOUBLE, nov DOUBLE, val DOUBLE)[] AS chosen FROM g
 UNION ALL SELECT clip_id, n + 1, list_filter(pool, lambda w: w."no" <> best."no" AND {_SHARE} <= 0.6), list_append(chosen, best) FROM
 (SELECT *, list_reduce(scored, lambda x, y: CASE WHEN y.val > x.val THEN y ELSE x END) AS best FROM
 (SELECT clip_id, n, pool, chosen, list_transform(list_transform(pool, lambda w: struct_insert(w, nov := CAST(least(greatest(1 - coalesce(list_max(list_transform(chosen, lambda c: {_LIKE})), 0.0), 0.0), 1.0) AS DOUBLE))), lambda w: struct_insert(w, val := w.base * w.nov)) AS scored FROM r WHERE n < 20 AND len(pool) > 0)) WHERE n < 10 OR best.nov >= 0.05),
 last AS (SELECT clip_id, unnest(chosen) AS c FROM (SELECT clip_id, arg_max(chosen, n) AS chosen FROM r GROUP BY clip_id))
 SELECT clip_id, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY c.val DESC, c."no") AS INT) AS rank, c."no" AS window_no, c.val AS score, c.nov AS novelty FROM last""")
def reel_candidates(spark, sf):
    """Base: mean quality and peak, halved, times confidence."""
    base = (F.col("mean_final") + F.col("peak")) / 2 * F.col("confidence")
    w = slid(spark, sf).select("clip_id", "window_no", (F.col("window_no") * 24.0).alias("start_s"), (F.col("window_no") * 24.0 + 72.0).alias("end_s"), base.alias("base"), "scene")
    return W.reel(w, KEYS)


@query(f"""WITH {FRAME_SQL}, g AS (SELECT clip_id, t - lag(t) OVER (PARTITION BY clip_id ORDER BY t, frame) AS gap FROM v_frame), m AS (SELECT clip_id, median(gap) AS med FROM g WHERE gap IS NOT NULL GROUP BY clip_id),
 a AS (SELECT g.clip_id, med, median(abs(gap - med)) AS mad FROM g JOIN m ON m.clip_id = g.clip_id WHERE gap IS NOT NULL GROUP BY ALL),
 s AS (SELECT f.clip_id, f.frame, f.t, CASE WHEN f.t - lag(f.t) OVER (PARTITION BY f.clip_id ORDER BY f.t, f.frame) > greatest(120.0 / 3600, med + 3 * 1.4826 * mad) THEN 1 ELSE 0 END AS b FROM v_frame f LEFT JOIN a ON a.clip_id = f.clip_id)
 SELECT clip_id, frame, CAST(sum(b) OVER (PARTITION BY clip_id ORDER BY t, frame) AS BIGINT) AS scene_no FROM s""")
def adaptive_scenes(spark, sf):
    f = frames(spark, sf)
    w = Window.partitionBy("clip_id").orderBy(*ORDER)
    g = f.withColumn("gap", F.col("t") - F.lag("t").over(w))
    m = g.filter("gap is not null").groupBy("clip_id").agg(F.median("gap").alias("med"))
    mad = g.filter("gap is not null").join(m, "clip_id").groupBy("clip_id", "med").agg(F.median(F.abs(F.col("gap") - F.col("med"))).alias("mad"))
    far = F.coalesce(F.col("gap") > F.greatest(F.lit(120.0 / 3600), F.col("med") + 3 * 1.4826 * F.col("mad")), F.lit(False))
    return g.join(mad, "clip_id", "left").withColumn("b", far.cast("bigint")).select("clip_id", "frame", F.sum("b").over(w).alias("scene_no"))
