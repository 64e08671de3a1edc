"""Scores and keep/maybe/cull decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.functions.columns import clamp

DIMENSIONS = ["sharpness", "composition", "exposure", "aesthetic", "moment"]

#: Weights by scene in the order of DIMENSIONS ('' is the default), bonuses and penalties by flag, and sharpness thresholds.
WEIGHTS = {
    "": [0.25, 0.20, 0.20, 0.25, 0.10],
    "portrait": [0.25, 0.20, 0.20, 0.10, 0.25],
    "wildlife": [0.40, 0.25, 0.15, 0.10, 0.10],
    "event": [0.20, 0.15, 0.15, 0.10, 0.40],
    "stilllife": [0.35, 0.30, 0.25, 0.05, 0.05],
}
BONUSES = {
    "portrait": {"open_eyes": 0.10, "smile": 0.05, "eye_contact": 0.05},
    "wildlife": {"look_space_correct": 0.10, "wings_spread": 0.15, "eye_contact": 0.10, "rare_species": 0.05},
    "event": {"peak_pose": 0.20, "eye_contact": 0.05, "crowd_reaction": 0.05},
    "stilllife": {"symmetry": 0.10, "clean_bg": 0.10, "color_accuracy": 0.05},
}
PENALTIES = {
    "portrait": {"closed_eyes": 0.30, "motion_blur_on_face": 0.50},
    "wildlife": {"cropped_subject": 0.15, "rear_view": 0.05, "small_in_frame": 0.10},
    "event": {"motion_blur_on_face": 0.40, "back_to_camera": 0.05, "obstructed_subject": 0.15},
    "stilllife": {"distracting_bg": 0.15, "wb_inconsistent": 0.10, "subject_tilted": 0.05},
}
SHARP = {"": 15.0, "portrait": 15.0, "wildlife": 25.0, "event": 12.0, "stilllife": 20.0}
PRESETS = {"standard": (0.65, 0.40), "strict": (0.70, 0.50), "lenient": (0.55, 0.30)}
HARD = ["closed_eyes", "motion_blur_on_face", "severely_overexposed", "no_clear_subject", "severely_blurry"]
#: Burst gaps in seconds and least similarities by scene.
BURSTS = {"stilllife": (300.0, 0.90), "wildlife": (1.0, 0.96), "event": (1.0, 0.94), "portrait": (2.0, 0.93), "landscape": (5.0, 0.94), "street": (2.0, 0.94)}


def by_scene(scene: Column, values: dict, default) -> Column:
    """The value of a scene, compiled into one case expression."""
    out = None
    for name, value in values.items():
        if name:
            out = F.when(scene == name, value) if out is None else out.when(scene == name, value)
    return F.lit(default) if out is None else out.otherwise(default)


def sharpness(subject: Column, whole: Column, scene: Column) -> Column:
    """Laplacian variance of the subject, else of the frame, against twice the scene's threshold."""
    lap = F.coalesce(subject, whole, F.lit(0.0))
    return F.when(lap > 0, F.least(lap / (2 * by_scene(scene, SHARP, SHARP[""])), F.lit(1.0))).otherwise(0.0)


def exposure(highlights: Column, shadows: Column, luma: Column) -> Column:
    hi, sh, mean = F.coalesce(highlights, F.lit(0.0)), F.coalesce(shadows, F.lit(0.0)), F.coalesce(luma, F.lit(128.0))
    return F.greatest(1 - F.least(hi / 20, F.lit(0.5)) - F.least(sh / 20, F.lit(0.5)) - F.when((mean < 40) | (mean > 220), 0.3).otherwise(0.0), F.lit(0.0))


def aesthetic(laion: Column, clip: Column) -> Column:
    return 0.5 * clamp((F.coalesce(laion, F.lit(5.0)) - 2) / 7) + 0.5 * clamp(F.coalesce(clip, F.lit(0.5)))


def fused(dims: dict[str, Column], scene: Column, flags: Column) -> Column:
    """Weighted sum of the dimensions (missing ones count one half), with bonuses and penalties of flags, in [0, 1]."""
    total = F.lit(0.0)
    for i, name in enumerate(DIMENSIONS):
        weight = by_scene(scene, {s: w[i] for s, w in WEIGHTS.items()}, WEIGHTS[""][i])
        total = total + F.coalesce(dims[name], F.lit(0.5)) * weight
    for table, sign in ((BONUSES, 1), (PENALTIES, -1)):
        for name, deltas in table.items():
            for flag, delta in deltas.items():
                total = total + F.when((scene == name) & F.array_contains(flags, flag), sign * delta).otherwise(0.0)
    return clamp(total)


def personal_weights(weights: Column, preference: Column) -> Column:
    """A map of weights tilted by preferences (one sixth is neutral, between one half and twice), with the same sum."""
    tilted = F.transform_values(weights, lambda k, w: w * clamp(F.coalesce(F.element_at(preference, k), F.lit(1 / 6)) / (1 / 6), 0.5, 2.0))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x)
    return F.transform_values(tilted, lambda k, w: w * total(weights) / total(tilted))


def thresholds(strictness: str, keep_delta: float = 0.0, cull_delta: float = 0.0, shift: float = 0.0) -> tuple[float, float]:
    """Keep and cull bounds: preset, then vertical deltas, then the personal shift, clamped after each."""
    unit = lambda x: min(1.0, max(0.0, x))
    keep, cull = PRESETS[strictness]
    return unit(unit(keep + keep_delta) + shift), unit(unit(cull + cull_delta) + shift / 2)


def hard_flags(scene: Column, tolerated: list[str] = (), tiny: list[str] = ("landscape", "wildlife", "aerial", "street")) -> Column:
    """Flags that cull whatever the score. A scene of 'unknown' is exempt from the subject rule; a null scene is not."""
    hard = F.array(*[F.lit(f) for f in HARD if f not in tolerated])
    no_subject = F.coalesce(scene.isin(*tiny, "unknown"), F.lit(False))
    hard = F.when(no_subject, F.array_remove(hard, "no_clear_subject")).otherwise(hard)
    return F.when(F.coalesce(scene == "landscape", F.lit(False)), F.array_remove(hard, "severely_blurry")).otherwise(hard)


def decide(score: Column, flags: Column, scene: Column, strictness: str = "standard", *, keep_delta: float = 0.0, cull_delta: float = 0.0, shift: float = 0.0, tolerated: list[str] = (), p_keep: Column | None = None, judge: Column | None = None, technical: Column | None = None, authority: str = "shadow") -> Column:
    """The decision table: judge with authority, hard flags, score, and the rescorer for what is left at maybe."""
    keep, cull = thresholds(strictness, keep_delta, cull_delta, shift)
    triggered = F.size(F.array_intersect(F.coalesce(flags, F.array().cast("array<string>")), hard_flags(scene, tolerated))) > 0
    out = F.when(triggered, "cull").when(score >= keep, "keep").when(score <= cull, "cull")
    left = F.lit("maybe") if p_keep is None else F.when(p_keep >= 0.5, "keep").when(p_keep < 0.5, "cull").otherwise("maybe")
    out = out.otherwise(left)
    if judge is not None and authority != "shadow":
        low = F.coalesce((technical if technical is not None else F.lit(None).cast("double")) <= 2, F.lit(False))
        known = judge.isin("keep", "maybe", "cull")
        wins = triggered & judge.isin("keep", "maybe") & ~low if authority == "rescue" else known & ~((judge == "keep") & triggered & low)
        out = F.when(F.coalesce(wins, F.lit(False)), judge).otherwise(out)
    return out


def axes_overall(stars: Column, keep: float = 4.0, cull: float = 2.0) -> Column:
    """From the rated axes of a map: one at cull or less culls, all at keep or more keep, else maybe."""
    rated = F.filter(F.map_values(stars), lambda x: x.isNotNull())
    return F.when(F.exists(rated, lambda x: x <= cull), "cull").when((F.size(rated) > 0) & F.forall(rated, lambda x: x >= keep), "keep").otherwise("maybe")


def rubric_axis(checks: list[tuple[Column, float]], emphasis: float = 1.0) -> Column:
    """Stars of an axis: the weighted share of passed checks (null is not applicable), 1 to 5; null if none applies."""
    applies = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), w).otherwise(0.0) for c, w in checks])
    passed = reduce(lambda a, b: a + b, [F.when(c, w).otherwise(0.0) for c, w in checks])
    return F.when(applies > 0, clamp((1 + 4 * passed / applies) * emphasis, 1.0, 5.0))


#: Fixed values of the style rules.
MONO, ZONE_IV, ZONE_VI, DARK, LIGHT = 6.0, 0.30, 0.55, 0.25, 0.25


def style_modes(r: dict[str, Column]) -> Column:
    """The set of styles of a row, by thresholds on its metrics."""
    zero = lambda c: F.coalesce(r[c], F.lit(0.0))
    low = (r["mean_luma"] < ZONE_IV) & (zero("shadow_clip_pct") > 0.03) & (zero("highlight_clip_pct") > 0.005)
    long_ = zero("long_exposure") > 0.4
    return F.array_compact(F.array(
        F.when(r["mono_delta"] < MONO, "mono"), F.when(low, "low_key"),
        F.when((r["mean_luma"] > ZONE_VI) & (zero("highlight_clip_pct") < 0.05), "high_key"),
        F.when((zero("highlight_clip_pct") > LIGHT) & (zero("shadow_clip_pct") > DARK) & (zero("zone_clip") > 0.20), "silhouette"),
        F.when(long_, "long_exposure"), F.when(long_ & (r["laplacian_subject"] > 80) & (zero("subject_fraction") > 0.05), "rear_curtain_sync"),
        F.when((r["mean_luma"] < 0.30) & ~F.coalesce(low, F.lit(False)), "night"),
    ))


def adaptive_band(df: DataFrame, keys: list[str], score: str, target: float | None = None) -> DataFrame:
    """Keep and cull bounds of each key from truncated quartiles, half-way to .65 and .40; for 20 rows and more.

    Rows of equal score are counted together before the order, so a key comes as its different scores, never as one list.
    """
    at = df.filter(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("_s")).agg(F.count("*").alias("_k"))
    up = Window.partitionBy(*keys).orderBy("_s")
    at = at.withColumns({"_upto": F.sum("_k").over(up), "_n": F.sum("_k").over(Window.partitionBy(*keys))})
    q = lambda p: F.min(F.when(F.col("_upto") > F.floor(F.col("_n") * p), F.col("_s")))
    out = at.groupBy(*keys).agg(F.max("_n").alias("n"), q(0.75).alias("_high"), q(0.25).alias("_low")).filter("n >= 20")
    return out.select(*keys, "n", (0.5 * F.col("_high") + 0.5 * 0.65).alias("keep_min"), (0.5 * F.col("_low") + 0.5 * 0.40).alias("cull_max"))

