"""Bursts, peaks and scene sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from proofsheet.operators import peaks as P
from proofsheet.operators.sessions import by_scene, cluster_bursts
from proofsheet.plans.catalog import query
from proofsheet.plans.views import PHOTO_SQL, photos, table

GAP_S = 14400

BURST_SQL = f"""{PHOTO_SQL}, flagged AS (SELECT *, CASE WHEN lag(scene) OVER w = scene AND epoch_us(ts) - epoch_us(lag(ts) OVER w) <= {GAP_S * 1000000} THEN 0 ELSE 1 END AS brk
 FROM v_photo WINDOW w AS (PARTITION BY run_id ORDER BY ts, photo_id)),
 burst AS (SELECT * EXCLUDE (brk), sum(brk) OVER (PARTITION BY run_id ORDER BY ts, photo_id) - 1 AS cluster_id FROM flagged)"""


def bursts(spark, sf):
    return cluster_bursts(photos(spark, sf), ["run_id"], "ts", "photo_id", "scene", GAP_S)


@query(f"WITH {BURST_SQL} SELECT run_id, photo_id, CAST(cluster_id AS BIGINT) AS cluster_id FROM burst")
def burst_sessions(spark, sf):
    return bursts(spark, sf).select("run_id", "photo_id", F.col("cluster_id").cast("long").alias("cluster_id"))


PEAK = "0.40 * score_final + 0.25 * sharp + 0.20"


def peaks(spark, sf):
    """Rank within a burst by the blend; a missing blink counts as fully open eyes, hence the constant 0.20."""
    w = Window.partitionBy("run_id", "cluster_id").orderBy(F.col("peakness").desc(), "ts", "photo_id")
    return bursts(spark, sf).withColumn("peakness", F.expr(PEAK)).withColumn("peak_rank", F.row_number().over(w) - 1)


PEAK_SQL = f"""{BURST_SQL}, peak AS (SELECT *, {PEAK} AS peakness, row_number() OVER (PARTITION BY run_id, cluster_id ORDER BY {PEAK} DESC, ts, photo_id) - 1 AS peak_rank FROM burst)"""


@query(f"WITH {PEAK_SQL} SELECT run_id, CAST(cluster_id AS BIGINT) AS cluster_id, photo_id, CAST(peak_rank AS INT) AS peak_rank FROM peak WHERE peak_rank = 0")
def burst_peaks(spark, sf):
    return peaks(spark, sf).filter("peak_rank = 0").select("run_id", F.col("cluster_id").cast("long").alias("cluster_id"), "photo_id", "peak_rank")


#: Seconds and similarity by scene for the test tables, whose frames are hours apart and whose vectors are alike at random.
GAPS, ALIKE = {"a": 7200.0, "b": 20000.0}, {"a": 0.0, "b": 0.1}
_SHOT = """sh AS (SELECT vec_id, embedding, vec_id % 5 AS run_id, CASE vec_id // 5 % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'a' ELSE 'b' END AS scene, TIMESTAMP '2024-01-01' + to_seconds(CAST(vec_id * 1000 AS BIGINT)) AS ts FROM embeddings),
 lg AS (SELECT *, lag(scene) OVER w AS ls, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap, list_dot_product(CAST(lag(embedding) OVER w AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS cos FROM sh WINDOW w AS (PARTITION BY run_id ORDER BY ts, vec_id))"""


@query(f"""WITH {_SHOT}, br AS (SELECT *, CASE WHEN ls = scene AND gap <= CASE scene WHEN 'a' THEN 7200000000 ELSE 20000000000 END AND cos >= CASE scene WHEN 'a' THEN 0.0 ELSE 0.1 END THEN 0 ELSE 1 END AS brk FROM lg)
 SELECT run_id, vec_id, CAST(sum(brk) OVER (PARTITION BY run_id ORDER BY ts, vec_id) - 1 AS BIGINT) AS cluster_id FROM br""")
def similar_bursts(spark, sf):
    """Bursts that need the same scene, closeness in time and similarity, the last two by scene."""
    i = F.col("vec_id")
    shots = table(spark, sf, "embeddings").select("vec_id", "embedding", (i % 5).alias("run_id"), F.when(F.floor(i / 5) % 3 <= 1, "a").otherwise("b").alias("scene"), F.timestamp_seconds(1704067200 + i * 1000).alias("ts"))
    found = cluster_bursts(shots, ["run_id"], "ts", "vec_id", "scene", by_scene("scene", GAPS, 0), vector="embedding", similar=by_scene("scene", ALIKE, 0))
    return found.select("run_id", "vec_id", F.col("cluster_id").cast("long").alias("cluster_id"))


#: Bursts of eight vectors; signals with gaps, below 0 and above 1; scenes in odd spelling.
_BLEND_FIELDS = {"sharpness": "sharp", "quality": "final", "blink": "blink", "smile": "smile", "brow": "brow", "faces": "faces"}


def blend_rows(spark, sf):
    i = F.col("vec_id")
    share = lambda k, n, less: ((i * k) % n - less) / 100.0
    scenes = F.array(*[F.lit(x) for x in ("Wedding", "sports", " bird ", None, "", "portrait", "unknown")])
    return table(spark, sf, "embeddings").select(
        (i % 3).alias("run_id"), F.when(i % 97 > 0, F.floor(i / 24)).alias("cluster_id"), i.alias("vec_id"), F.concat(F.lit("f"), i).alias("name"), F.when(i % 11 > 0, F.col("embedding")).alias("embedding"),
        share(37, 101, 0).alias("sharp"), share(53, 101, 0).alias("final"), F.when(i % 7 > 0, share(29, 120, 10)).alias("blink"), F.when(i % 6 > 0, share(31, 130, 15)).alias("smile"), F.when(i % 5 > 0, share(43, 110, 5)).alias("brow"),
        (i % 9).alias("faces"), F.get(scenes, (F.floor(i / 5) % 7).cast("int")).alias("scene"),
    )


_PRESETS = "CASE trim(modal) " + " ".join(f"WHEN '{k}' THEN [{', '.join(map(str, v))}]" for k, v in P.WEIGHTS.items()) + f" ELSE [{', '.join(map(str, P.OTHERWISE))}] END"
_ORDERED = ["smile", "eyes", "brow", "sharpness", "distinctness", "quality", "faces"]
_ABOVE = {s: f"w[{P.SIGNALS.index(s) + 1}] * ({s} - avg({s}) OVER b)" for s in _ORDERED}
_BLENDED = f"""bl AS (SELECT vec_id % 3 AS run_id, vec_id // 24 AS cluster_id, vec_id, 'f' || vec_id AS name, CASE WHEN vec_id % 11 > 0 THEN CAST(embedding AS DOUBLE[]) END AS v, ((vec_id * 37) % 101) / 100.0 AS sharpness, ((vec_id * 53) % 101) / 100.0 AS quality,
 CASE WHEN vec_id % 7 > 0 THEN least(greatest(1.0 - ((vec_id * 29) % 120 - 10) / 100.0, 0.0), 1.0) ELSE 0.0 END AS eyes, CASE WHEN vec_id % 6 > 0 THEN least(greatest(((vec_id * 31) % 130 - 15) / 100.0, 0.0), 1.0) ELSE 0.0 END AS smile,
 CASE WHEN vec_id % 5 > 0 THEN least(greatest(1.0 - ((vec_id * 43) % 110 - 5) / 100.0, 0.0), 1.0) ELSE 0.0 END AS brow, vec_id % 9 AS n_faces, least(1.0, (vec_id % 9) * 0.15) AS faces, ['wedding', 'sports', ' bird ', NULL, NULL, 'portrait', 'unknown'][vec_id // 5 % 7 + 1] AS scene FROM embeddings WHERE vec_id % 97 > 0),
 md AS (SELECT run_id, cluster_id, arg_min(scene, (-n, f)) AS modal FROM (SELECT run_id, cluster_id, scene, count(*) AS n, min(vec_id) AS f FROM bl WHERE scene IS NOT NULL GROUP BY ALL) GROUP BY ALL),
 ce AS (SELECT run_id, cluster_id, list(a ORDER BY p) AS c FROM (SELECT run_id, cluster_id, p, avg(v[p]) AS a FROM (SELECT run_id, cluster_id, v, unnest(range(1, len(v) + 1)) AS p FROM bl WHERE v IS NOT NULL) GROUP BY ALL) GROUP BY ALL),
 fa AS (SELECT bl.*, {_PRESETS} AS w, coalesce(1.0 - list_dot_product(v, c) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(c, c))), 0.0) AS far FROM bl LEFT JOIN md USING (run_id, cluster_id) LEFT JOIN ce USING (run_id, cluster_id)),
 di AS (SELECT *, count(*) OVER b AS n, CASE WHEN max(far) OVER b - min(far) OVER b < 1e-9 THEN 0.0 ELSE (far - min(far) OVER b) / (max(far) OVER b - min(far) OVER b) END AS distinctness FROM fa WINDOW b AS (PARTITION BY run_id, cluster_id)),
 up AS (SELECT *, {', '.join(f'{x} AS up_{s}' for s, x in _ABOVE.items())}, CASE WHEN n = 1 THEN 1.0 ELSE {' + '.join(f'w[{k + 1}] * {s}' for k, s in enumerate(P.SIGNALS))} END AS peak_score FROM di WINDOW b AS (PARTITION BY run_id, cluster_id)),
 st AS (SELECT *, row_number() OVER (PARTITION BY run_id, cluster_id ORDER BY peak_score DESC, quality DESC, name) - 1 AS place, greatest({', '.join(f'up_{s}' for s in _ORDERED)}) AS top FROM up)"""
_WHY = f"CASE WHEN n = 1 THEN '{P.ALONE}' WHEN top <= 0 THEN '{P.NOTHING}' " + " ".join(f"WHEN up_{s} = top THEN printf('{P.REASONS[s]}', {'n_faces' if s == 'faces' else s if s == 'quality' else s + ' * 100'})" for s in _ORDERED) + " END"


@query(f"WITH {_BLENDED} SELECT run_id, cluster_id, name, peak_score, CAST(place AS INT) AS place, {_WHY} AS reason FROM st")
def burst_blend(spark, sf):
    return P.ranked(blend_rows(spark, sf), ["run_id", "cluster_id"], "name", _BLEND_FIELDS, "scene", "embedding", "vec_id").select("run_id", "cluster_id", "name", "peak_score", "place", "reason")


@query(f"""WITH {_BLENDED}, mk AS (SELECT vec_id, row_number() OVER (PARTITION BY run_id, cluster_id ORDER BY quality DESC, vec_id) = 1 AS peak FROM bl)
 SELECT 'f' || e.vec_id AS name, CASE WHEN peak AND n > 1 THEN {_WHY} END AS burst_peak_reason FROM embeddings e LEFT JOIN st ON st.vec_id = e.vec_id LEFT JOIN mk ON mk.vec_id = e.vec_id""")
def burst_peak_reasons(spark, sf):
    """The peaks are those of another ranking; the blend only tells why."""
    keys = ["run_id", "cluster_id"]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("final"), "vec_id")) == 1
    rows = blend_rows(spark, sf).withColumn("is_peak", first & F.col("cluster_id").isNotNull())
    return P.annotated(rows, keys, "name", _BLEND_FIELDS, "scene", "embedding", "vec_id", "is_peak").select("name", "burst_peak_reason")
