"""Scores, decisions, rubric and styles."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofsheet.functions import columns as C
from proofsheet.operators import decision as D
from proofsheet.plans.catalog import query
from proofsheet.plans.views import METRICS_SQL, metrics


def _scene(values: dict, default) -> str:
    return "CASE scene " + " ".join(f"WHEN '{s}' THEN {v}" for s, v in values.items() if s) + f" ELSE {default} END"


_W = {n: _scene({s: w[i] for s, w in D.WEIGHTS.items()}, D.WEIGHTS[""][i]) for i, n in enumerate(D.DIMENSIONS)}
_BONUS = " ".join(f"{'+' if sign > 0 else '-'} CASE WHEN scene = '{s}' AND list_contains(flags, '{f}') THEN {d} ELSE 0.0 END" for t, sign in ((D.BONUSES, 1), (D.PENALTIES, -1)) for s, fs in t.items() for f, d in fs.items())
FUSED_SQL = f"""{METRICS_SQL}, v_dims AS (SELECT *, CASE WHEN coalesce(lap, lap_global, 0) > 0 THEN least(coalesce(lap, lap_global) / (2 * {_scene(D.SHARP, D.SHARP[''])}), 1.0) ELSE 0.0 END AS sharpness,
 greatest(1 - least(hi / 20, 0.5) - least(sh / 20, 0.5) - CASE WHEN luma < 40 OR luma > 220 THEN 0.3 ELSE 0.0 END, 0.0) AS exposure,
 0.5 * least(greatest((laion - 2) / 7, 0.0), 1.0) + 0.5 * least(greatest(sharp, 0.0), 1.0) AS aesthetic FROM v_metrics),
 v_fused AS (SELECT *, least(greatest(sharpness * {_W['sharpness']} + 0.5 * {_W['composition']} + exposure * {_W['exposure']} + aesthetic * {_W['aesthetic']} + coalesce(moment, 0.5) * {_W['moment']} {_BONUS}, 0.0), 1.0) AS final FROM v_dims)"""


def fused(spark, sf):
    c = F.col
    m = metrics(spark, sf)
    m = m.withColumns({"sharpness": D.sharpness(c("lap"), c("lap_global"), c("scene")), "exposure": D.exposure(c("hi"), c("sh"), c("luma")), "aesthetic": D.aesthetic(c("laion"), c("sharp"))})
    dims = {"sharpness": c("sharpness"), "composition": F.lit(None).cast("double"), "exposure": c("exposure"), "aesthetic": c("aesthetic"), "moment": c("moment")}
    return m.withColumn("final", D.fused(dims, c("scene"), c("flags")))


@query(f"WITH {FUSED_SQL} SELECT photo_id, sharpness, exposure, aesthetic, final FROM v_fused")
def fuse_scores(spark, sf):
    return fused(spark, sf).select("photo_id", "sharpness", "exposure", "aesthetic", "final")


def _decide_sql(keep: float, cull: float, tolerated: tuple = (), rescue: str = "'maybe'") -> str:
    hard = ", ".join(f"'{f}'" for f in D.HARD if f not in tolerated and f not in ("no_clear_subject", "severely_blurry"))
    return f"""CASE WHEN list_has_any(flags, [{hard}]) {"" if "severely_blurry" in tolerated else "OR list_contains(flags, 'severely_blurry')"}
 {"" if "no_clear_subject" in tolerated else "OR (list_contains(flags, 'no_clear_subject') AND scene NOT IN ('landscape', 'wildlife', 'aerial', 'street', 'unknown'))"} THEN 'cull'
 WHEN final >= {keep} THEN 'keep' WHEN final <= {cull} THEN 'cull' ELSE {rescue} END"""


@query(f"WITH {FUSED_SQL} SELECT photo_id, {_decide_sql(0.65, 0.40)} AS decision FROM v_fused")
def fuse_decide(spark, sf):
    return fused(spark, sf).select("photo_id", D.decide(F.col("final"), F.col("flags"), F.col("scene")).alias("decision"))


_STRICT = {s: _decide_sql(*D.thresholds(s)) for s in D.PRESETS}


@query(f"WITH {FUSED_SQL} SELECT photo_id, " + ", ".join(f"{x} AS {s}" for s, x in _STRICT.items()) + " FROM v_fused")
def decide_strictness(spark, sf):
    return fused(spark, sf).select("photo_id", *[D.decide(F.col("final"), F.col("flags"), F.col("scene"), s).alias(s) for s in D.PRESETS])


@query(f"WITH {FUSED_SQL} SELECT photo_id, {_decide_sql(*D.thresholds('standard', -0.05, 0.02, 0.03), tolerated=('severely_blurry',))} AS decision FROM v_fused")
def decide_vertical(spark, sf):
    return fused(spark, sf).select("photo_id", D.decide(F.col("final"), F.col("flags"), F.col("scene"), keep_delta=-0.05, cull_delta=0.02, shift=0.03, tolerated=["severely_blurry"]).alias("decision"))


@query(f"WITH {FUSED_SQL} SELECT photo_id, {_decide_sql(0.65, 0.40, rescue="CASE WHEN sharp >= 0.5 THEN 'keep' ELSE 'cull' END")} AS decision FROM v_fused")
def decide_rescored(spark, sf):
    return fused(spark, sf).select("photo_id", D.decide(F.col("final"), F.col("flags"), F.col("scene"), p_keep=F.col("sharp")).alias("decision"))


@query(f"""WITH {FUSED_SQL}, j AS (SELECT *, {_decide_sql(0.65, 0.40)} AS d, CASE photo_id % 4 WHEN 0 THEN 'keep' WHEN 1 THEN 'maybe' WHEN 2 THEN 'cull' END AS judge FROM v_fused),
 t AS (SELECT *, list_has_any(flags, ['closed_eyes', 'severely_blurry']) OR (list_contains(flags, 'no_clear_subject') AND scene NOT IN ('wildlife', 'unknown')) AS hit FROM j)
 SELECT photo_id, CASE WHEN hit AND judge IN ('keep', 'maybe') AND NOT k % 5 <= 2 THEN judge ELSE d END AS rescue, CASE WHEN judge IS NOT NULL AND NOT (judge = 'keep' AND hit AND k % 5 <= 2) THEN judge ELSE d END AS primary_judge FROM t""")
def decide_judged(spark, sf):
    judge = F.when(F.col("photo_id") % 4 == 0, "keep").when(F.col("photo_id") % 4 == 1, "maybe").when(F.col("photo_id") % 4 == 2, "cull")
    f = fused(spark, sf)
    both = [D.decide(F.col("final"), F.col("flags"), F.col("scene"), judge=judge, technical=F.col("k") % 5, authority=a).alias(n) for a, n in (("rescue", "rescue"), ("primary", "primary_judge"))]
    return f.select("photo_id", *both)


@query(f"""WITH {METRICS_SQL}, a AS (SELECT photo_id, CASE WHEN photo_id % 4 = 0 THEN NULL ELSE 1.0 + k % 5 END AS x, 1.0 + photo_id % 5 AS y, CASE WHEN photo_id % 6 = 0 THEN NULL ELSE 4.0 END AS z FROM v_metrics)
 SELECT photo_id, CASE WHEN least(coalesce(x, 9), coalesce(y, 9), coalesce(z, 9)) <= 2 THEN 'cull' WHEN least(coalesce(x, 9), y, coalesce(z, 9)) >= 4 THEN 'keep' ELSE 'maybe' END AS overall, (coalesce(x, 0) + y + coalesce(z, 0)) / (CASE WHEN x IS NULL THEN 0 ELSE 1 END + 1 + CASE WHEN z IS NULL THEN 0 ELSE 1 END) AS mean_stars FROM a""")
def axes_to_overall(spark, sf):
    m = metrics(spark, sf)
    stars = F.create_map(F.lit("x"), F.when(F.col("photo_id") % 4 != 0, 1.0 + F.col("k") % 5), F.lit("y"), 1.0 + F.col("photo_id") % 5, F.lit("z"), F.when(F.col("photo_id") % 6 != 0, 4.0))
    rated = F.filter(F.map_values("stars"), lambda x: x.isNotNull())
    return m.select("photo_id", stars.alias("stars")).select("photo_id", D.axes_overall(F.col("stars")).alias("overall"), F.try_divide(F.aggregate(rated, F.lit(0.0), lambda s, x: s + x), F.size(rated)).alias("mean_stars"))


@query(f"""WITH {METRICS_SQL}, c AS (SELECT photo_id, lap >= 15 AS a, hi < 5 AS b, NOT list_contains(flags, 'closed_eyes') AS c FROM v_metrics)
 SELECT photo_id, least(greatest(1 + 4 * (CASE WHEN a THEN 2.0 ELSE 0 END + CASE WHEN b THEN 1.0 ELSE 0 END + CASE WHEN c THEN 1.5 ELSE 0 END) / (CASE WHEN a IS NULL THEN 0 ELSE 2.0 END + 2.5), 1.0), 5.0) AS stars FROM c""")
def rubric_stars(spark, sf):
    checks = [(F.col("lap") >= 15, 2.0), (F.col("hi") < 5, 1.0), (~F.array_contains("flags", "closed_eyes"), 1.5)]
    return metrics(spark, sf).select("photo_id", D.rubric_axis(checks).alias("stars"))


@query(f"""WITH {METRICS_SQL}, s AS (SELECT photo_id, luma / 255.0 AS l, hi / 20.0 AS h, sh / 20.0 AS d, k % 12 AS mono, sharp, lap FROM v_metrics)
 SELECT photo_id, array_to_string(list_filter([CASE WHEN mono < 6 THEN 'mono' END, CASE WHEN l < 0.3 AND d > 0.03 AND h > 0.005 THEN 'low_key' END, CASE WHEN l > 0.55 AND h < 0.05 THEN 'high_key' END,
 CASE WHEN h > 0.25 AND d > 0.25 AND sharp > 0.2 THEN 'silhouette' END, CASE WHEN sharp > 0.4 THEN 'long_exposure' END, CASE WHEN sharp > 0.4 AND lap > 80 AND sharp > 0.05 THEN 'rear_curtain_sync' END,
 CASE WHEN l < 0.3 AND NOT (d > 0.03 AND h > 0.005) THEN 'night' END], lambda x: x IS NOT NULL), ',') AS modes FROM s""")
def style_modes(spark, sf):
    c = F.col
    r = {"mean_luma": c("luma") / 255.0, "highlight_clip_pct": c("hi") / 20.0, "shadow_clip_pct": c("sh") / 20.0, "mono_delta": c("k") % 12, "zone_clip": c("sharp"), "long_exposure": c("sharp"), "laplacian_subject": c("lap"), "subject_fraction": c("sharp")}
    return metrics(spark, sf).select("photo_id", F.array_join(D.style_modes(r), ",").alias("modes"))


@query(f"""WITH {FUSED_SQL}, q AS (SELECT scene, list_sort(list(final)) AS s, count(*) AS n FROM v_fused GROUP BY scene HAVING count(*) >= 20)
 SELECT scene, n, 0.5 * s[CAST(floor(n * 0.75) AS INT) + 1] + 0.5 * 0.65 AS keep_min, 0.5 * s[CAST(floor(n * 0.25) AS INT) + 1] + 0.5 * 0.40 AS cull_max FROM q""")
def adaptive_maybe_band(spark, sf):
    return D.adaptive_band(fused(spark, sf), ["scene"], "final")


@query(f"WITH {METRICS_SQL} SELECT photo_id, 2 * 6371.0088 * asin(sqrt(least(power(sin(radians(1.0 - sharp) / 2), 2) + cos(radians(sharp)) * cos(radians(1.0)) * power(sin(radians(luma / 10 - 5.0) / 2), 2), 1.0))) AS km FROM v_metrics")
def haversine(spark, sf):
    return metrics(spark, sf).select("photo_id", C.haversine_km(F.col("sharp"), F.lit(5.0), F.lit(1.0), F.col("luma") / 10).alias("km"))


@query(f"""WITH {METRICS_SQL} SELECT photo_id, CASE WHEN k BETWEEN 5 AND 8 THEN 'dawn' WHEN k BETWEEN 9 AND 11 THEN 'morning' WHEN k BETWEEN 12 AND 14 THEN 'midday' WHEN k BETWEEN 15 AND 17 THEN 'afternoon' WHEN k BETWEEN 18 AND 20 THEN 'evening' ELSE 'night' END AS part,
 CASE WHEN k = 0 THEN NULL WHEN k < 1.9 THEN 'wide' WHEN k < 3 THEN 'fast' WHEN k < 6 THEN 'medium' ELSE 'narrow' END AS aperture, bit_count(xor(photo_id, CAST(k AS BIGINT))) AS distance,
 least(greatest(0.5 + (sharp - 0.5) / 2.0, 0.0), 1.0) AS calibrated, CASE WHEN lap IS NULL THEN score_final ELSE 0.3 * lap + 0.7 * score_final END AS blended, CASE WHEN abs(hi) <= 2 THEN 1.0 ELSE greatest(1 - (hi - 2) / 10, 0.0) END AS level FROM v_metrics""")
def scalar_functions(spark, sf):
    c = F.col
    return metrics(spark, sf).select("photo_id", C.time_of_day(c("k")).alias("part"), C.aperture_group(c("k")).alias("aperture"), C.hamming(c("photo_id"), c("k").cast("bigint")).alias("distance"), C.calibrated(c("sharp"), 2.0).alias("calibrated"), C.blend(c("lap"), c("score_final"), 0.3).alias("blended"), C.ramp(c("hi"), 2.0, 12.0).alias("level"))
