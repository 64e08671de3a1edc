"""Stars by axis from the whole rubric."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofsheet.operators import rubric as R
from proofsheet.plans.catalog import query
from proofsheet.plans.views import METRICS_SQL, metrics

#: Stand-in metrics, since the tables have none: a multiple of the photo's number, between 0 and this, and missing at times.
_SCALE = {m: 1.0 for m in R.METRICS} | {"laplacian_subject": 120.0, "laplacian_global": 120.0, "horizon_tilt_deg": 5.0, "laion_aes": 10.0, "highlight_clip_pct": 0.1, "shadow_clip_pct": 0.3, "canon_zone_clip_pct": 0.1}
_STEP = {m: 7 + 6 * i for i, m in enumerate(R.METRICS)}


def judged(spark, sf):
    i = F.col("photo_id")
    made = {m: F.when((i + k) % 9 != 0, (i * k % 101) / 100.0 * _SCALE[m]) for m, k in _STEP.items() if m not in ("face_count", "laion_aes")}
    return metrics(spark, sf).drop("laion").withColumns({**made, "laion_aes": F.when(i % 5 != 0, (i * 3 % 101) / 10.0), "face_count": F.when(i % 6 != 0, (i % 3).cast("double")), "is_burst_peak": F.when(i % 4 == 0, True).when(i % 4 == 1, False), "burst_peak_reason": F.when(i % 8 == 0, "sharp").when(i % 8 == 4, " ")})


def _when(pairs):
    return F.create_map(*[F.lit(x) for p in pairs for x in p]) if pairs else F.create_map().cast("map<string,string>")


_STYLES = {1: [("not_blown_highlights", "suppress"), ("canon_thirds_concentration", "boost"), ("subject_in_focus", "invert")], 2: [("not_crushed_shadows", "invert")]}
_GENRES = {0: [("not_crushed_shadows", "suppress"), ("has_clear_subject", "boost")]}


def _check_sql(name):
    bound = {n: f"{m} {op} {v}" for n, m, op, v in R.BOUNDS}
    flag = {n: f"NOT list_contains(flags, '{f}')" for n, f in R.FLAGS} | {n: f"CASE WHEN coalesce(face_count, 0) <> 0 THEN NOT list_contains(flags, '{f}') END" for n, f in R.FACE_FLAGS}
    return (bound | flag | {
        "subject_in_focus": "coalesce(laplacian_subject, laplacian_global) >= 60", "horizon_within_2deg": "abs(horizon_tilt_deg) <= 2", "no_distracting_clutter": "subject_fraction BETWEEN 0.05 AND 0.85",
        "action_at_peak": "CASE photo_id % 8 WHEN 0 THEN true WHEN 1 THEN false WHEN 5 THEN false END", "emotion_present": "CASE WHEN wedding_moment_confidence IS NOT NULL THEN wedding_moment_confidence >= 0.5 WHEN coalesce(face_count, 0) <> 0 THEN face_max_smile >= 0.30 END",
    }).get(name)


def _axis_sql(axis):
    rows = []
    for name, w in R.AXES[axis]:
        test = _check_sql(name)
        if not test:
            continue
        ways = {1: dict(_STYLES[1]).get(name), 2: dict(_STYLES[2]).get(name)}
        genre = dict(_GENRES[0]).get(name)
        way = "CASE WHEN photo_id < 0 THEN '' " + "".join(f"WHEN photo_id % 3 = {k} THEN '{v}' " for k, v in ways.items() if v) + (f"WHEN photo_id % 2 = 0 THEN '{genre}' " if genre else "") + "ELSE '' END"
        rows.append(f"{{'n': '{name}', 'h': CASE {way} WHEN 'suppress' THEN NULL WHEN 'invert' THEN NOT ({test}) ELSE ({test}) END, 'w': CASE WHEN {way} = 'boost' AND ({test}) THEN {2 * w}::DOUBLE ELSE {w}::DOUBLE END}}")
    return f"list_filter([{', '.join(rows)}], lambda x: x.h IS NOT NULL) AS {axis}"


_MADE = ", ".join(f"CASE WHEN (photo_id + {k}) % 9 <> 0 THEN (photo_id * {k} % 101) / 100.0::DOUBLE * {_SCALE[m]}::DOUBLE END AS {m}" for m, k in _STEP.items() if m not in ("face_count", "laion_aes"))
_SUM = "coalesce(list_sum(list_transform({}, lambda x: x.w)), 0.0::DOUBLE)"
_STAR = lambda a: f"least(greatest(round((1 + 4 * ({_SUM.format(f'list_filter({a}, lambda x: x.h)')} / {_SUM.format(a)})) * CASE WHEN '{a}' = 'light' AND photo_id % 2 = 0 THEN 1.3 ELSE 1.0 END, 2), 1.0), 5.0)"


@query(f"""WITH {METRICS_SQL}, mt AS (SELECT photo_id, flags, {_MADE}, CASE WHEN photo_id % 5 <> 0 THEN (photo_id * 3 % 101) / 10.0::DOUBLE END AS laion_aes, CASE WHEN photo_id % 6 <> 0 THEN photo_id % 3 END AS face_count FROM v_metrics), ax AS (SELECT photo_id, {', '.join(_axis_sql(a) for a in R.AXES)} FROM mt)
 SELECT photo_id, {', '.join(f"CASE WHEN len({a}) > 0 THEN {_STAR(a)} END AS {a}" for a in R.AXES)}, array_to_string(list_transform(list_filter(composition, lambda x: NOT x.h), lambda x: x.n), ',') AS failed FROM ax""")
def rubric_axes(spark, sf):
    i = F.col("photo_id")
    style = F.when(i % 3 == 1, _when(_STYLES[1])).when(i % 3 == 2, _when(_STYLES[2])).otherwise(_when([]))
    genre = F.when(i % 2 == 0, _when(_GENRES[0])).otherwise(_when([]))
    emphasis = F.when(i % 2 == 0, F.create_map(F.lit("light"), F.lit(1.3))).otherwise(F.create_map().cast("map<string,double>"))
    rows = judged(spark, sf).withColumns({"o": R.merged_overrides(genre, style), "e": emphasis})
    scored = rows.select("photo_id", *[R.axis_score(a, F.col("o"), F.col("e")).alias(a) for a in R.AXES])
    return scored.select("photo_id", *[F.col(f"{a}.stars").alias(a) for a in R.AXES], F.array_join("composition.failed", ",").alias("failed"))
