"""The rubric: named checks on a photo's metrics and flags, weighed to stars by axis, with overrides by style and genre."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The checks of each axis and their weights.
AXES = {
    "technical": [("not_severely_blurry", 1.0), ("not_severely_overexposed", 1.0), ("not_severely_underexposed", 0.5), ("subject_in_focus", 1.0), ("face_not_motion_blurred", 0.8), ("canon_zone_full_range", 0.7), ("canon_no_zone_clipping", 0.6), ("canon_midgray_anchored", 0.4)],
    "subject": [("has_clear_subject", 1.0), ("subject_eyes_open", 0.5), ("subject_pose_natural", 0.8), ("not_random_passersby", 0.5)],
    "composition": [("horizon_within_2deg", 0.8), ("rule_of_thirds_close", 0.5), ("subject_not_at_edge", 1.0), ("no_distracting_clutter", 0.8), ("canon_thirds_concentration", 0.6), ("canon_balanced_weight", 0.5), ("canon_lead_room_ok", 0.5), ("canon_figure_ground_pop", 0.7)],
    "light": [("not_blown_highlights", 1.0), ("not_crushed_shadows", 0.8), ("color_temperature_clean", 0.5)],
    "moment": [("not_blink_or_mid_yawn", 0.5), ("action_at_peak", 0.8), ("emotion_present", 0.8)],
    "aesthetic": [("clipiqa_above_median", 0.5), ("laion_aes_above_median", 0.8), ("no_subject_environment_conflict", 0.5)],
}
#: Checks that compare a metric; a missing metric skips the check.
BOUNDS = [
    ("canon_zone_full_range", "canon_zone_distribution_kl", "<", 0.5), ("canon_no_zone_clipping", "canon_zone_clip_pct", "<", 0.05), ("canon_midgray_anchored", "canon_midgray_offset", "<", 0.15),
    ("rule_of_thirds_close", "rule_of_thirds_offset", "<=", 0.20), ("subject_not_at_edge", "composition_score", ">=", 0.4), ("canon_thirds_concentration", "canon_thirds_concentration", ">=", 0.45),
    ("canon_balanced_weight", "canon_balance", ">=", 0.6), ("canon_lead_room_ok", "canon_lead_room", ">=", 0.45), ("canon_figure_ground_pop", "canon_figure_ground", ">=", 0.4),
    ("not_blown_highlights", "highlight_clip_pct", "<", 0.05), ("not_crushed_shadows", "shadow_clip_pct", "<", 0.20), ("clipiqa_above_median", "clipiqa", ">=", 0.55), ("laion_aes_above_median", "laion_aes", ">=", 5.5),
]
#: Checks that a flag fails, everywhere or only where there are faces.
FLAGS = [("not_severely_blurry", "severely_blurry"), ("not_severely_overexposed", "severely_overexposed"), ("not_severely_underexposed", "severely_underexposed"), ("has_clear_subject", "no_clear_subject")]
FACE_FLAGS = [("face_not_motion_blurred", "motion_blur_on_face"), ("subject_eyes_open", "closed_eyes"), ("not_blink_or_mid_yawn", "closed_eyes")]
#: Focus, tilt in degrees, share of the subject, moment and smile.
FOCUS, TILT, SHARE, MOMENT, SMILE = 60.0, 2.0, (0.05, 0.85), 0.5, 0.30

#: Columns that the checks read, besides flags (an array), is_burst_peak (boolean) and burst_peak_reason (text).
METRICS = sorted({m for _, m, _, _ in BOUNDS} | {"laplacian_subject", "laplacian_global", "horizon_tilt_deg", "subject_fraction", "face_count", "wedding_moment_confidence", "face_max_smile"})


def checks() -> dict[str, Column]:
    """Each check by name: true, false, or null where it does not apply. Checks without a detector are not here."""
    c = F.col
    flagged = lambda f: F.coalesce(F.array_contains("flags", f), F.lit(False))
    faces = F.coalesce(c("face_count"), F.lit(0.0)) != 0
    out = {n: {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}[op](c(m), v) for n, m, op, v in BOUNDS}
    out |= {n: ~flagged(f) for n, f in FLAGS} | {n: F.when(faces, ~flagged(f)) for n, f in FACE_FLAGS}
    smiling = F.when(faces, c("face_max_smile") >= SMILE)
    reason = F.coalesce(F.trim("burst_peak_reason") != "", F.lit(False))
    return out | {
        "subject_in_focus": F.coalesce("laplacian_subject", "laplacian_global") >= FOCUS,
        "horizon_within_2deg": F.abs("horizon_tilt_deg") <= TILT,
        "no_distracting_clutter": c("subject_fraction").between(*SHARE),
        "action_at_peak": F.when(~c("is_burst_peak"), False).when(c("is_burst_peak") & reason, True),
        "emotion_present": F.when(c("wedding_moment_confidence").isNotNull(), c("wedding_moment_confidence") >= MOMENT).otherwise(smiling),
    }


def axis_score(axis: str, overrides: Column, emphasis: Column) -> Column:
    """stars (null if no check applies), share of passed weight, and the failed checks of an axis.

    overrides: a map of check to suppress (left out), boost (a passed check counts twice) or invert; emphasis: a map of axis
    to a factor on the stars, 1 where there is none.
    """
    known = checks()
    passed, weighed, applied, names = F.lit(0.0), F.lit(0.0), F.lit(False), []
    for name, weight in AXES[axis]:
        if name not in known:
            continue
        way = F.try_element_at(overrides, F.lit(name))
        hit = F.when(way.eqNullSafe(F.lit("suppress")), None).when(way.eqNullSafe(F.lit("invert")), ~known[name]).otherwise(known[name])
        w = F.when(way.eqNullSafe(F.lit("boost")) & hit, 2 * weight).otherwise(weight)
        # plain sums instead of arrays of checks, which are compiled with the rest of the row
        passed = passed + F.when(hit, w).otherwise(0.0)
        weighed = weighed + F.when(hit.isNotNull(), w).otherwise(0.0)
        applied = applied | hit.isNotNull()
        names.append(F.when(~hit, name))
    share = F.when(applied, passed / weighed)
    factor = F.coalesce(F.try_element_at(emphasis, F.lit(axis)), F.lit(1.0))
    stars = F.when(share.isNotNull(), F.least(F.greatest(F.round((1 + 4 * share) * factor, 2), F.lit(1.0)), F.lit(5.0)))
    failed = F.array_compact(F.array(*names))
    return F.struct(stars.alias("stars"), share.alias("share"), failed.alias("failed"))


def merged_overrides(genre: Column, style: Column) -> Column:
    """Overrides of both; a style's win over a genre's."""
    kept = F.map_filter(genre, lambda k, v: ~F.map_contains_key(style, k))
    return F.map_concat(kept, style)


def mean_stars(scores: list[Column]) -> Column:
    """The mean of the rated axes."""
    rated = F.array_compact(F.array(*[s["stars"] for s in scores]))
    return F.try_divide(reduce(lambda a, b: a + b, [F.coalesce(s["stars"], F.lit(0.0)) for s in scores]), F.size(rated))
