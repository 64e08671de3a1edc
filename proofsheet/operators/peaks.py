"""The peak of a burst by a blend of seven signals, weighted by the burst's scene, with the reason for each frame's place.

Sharpness, quality and what faces show count as they are; distinctness is the distance of a frame's vector to the mean vector
of its own burst, spread over 0..1 within the burst. The scene that most frames of a burst have (the first of those
on a tie) picks the weights. The reason is the signal that stands furthest above the burst's mean, times its weight.

Ranges and centroids are aggregated and joined back; only means and the rank are windows over a burst.

Defined results: missing, NaN and unreadable signals are 0, and so is the distance of a frame without a vector, of a zero
vector and of one that has not the length of the burst's first; where all distances are one, distinctness is 0; a frame
alone scores 1; rows of null cluster are in no burst and left out; equal scores go by quality, then by name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of sharpness, distinctness, quality, faces, open eyes, smiles and smooth brows by scene.
SIGNALS = ["sharpness", "distinctness", "quality", "faces", "eyes", "smile", "brow"]
WEIGHTS = {
    "wedding": (0.00, 0.00, 0.05, 0.05, 0.30, 0.60, 0.00),
    "sports": (0.65, 0.20, 0.10, 0.05, 0.00, 0.00, 0.00),
    "event": (0.40, 0.10, 0.10, 0.05, 0.25, 0.10, 0.00),
    "wildlife": (0.55, 0.30, 0.10, 0.05, 0.00, 0.00, 0.00),
    "bird": (0.55, 0.30, 0.10, 0.05, 0.00, 0.00, 0.00),
    "landscape": (0.70, 0.10, 0.15, 0.05, 0.00, 0.00, 0.00),
    "portrait": (0.25, 0.05, 0.05, 0.05, 0.30, 0.25, 0.05),
}
OTHERWISE = (0.40, 0.05, 0.05, 0.05, 0.25, 0.15, 0.05)
#: A face counts so many hundredths, up to the most.
PER_FACE, MOST_FACES = 15, 100
#: The reasons, the first of equals counts; of a frame alone, and of one that stands above in nothing.
REASONS = {"smile": "笑容明显 (%.0f%%)", "eyes": "眼睛睁开 (%.0f%%)", "brow": "表情放松 (%.0f%%)", "sharpness": "簇内最锐 (%.0f%%)", "distinctness": "姿态/动作差异最大 (%.0f%%)", "quality": "综合分高 (%.2f)", "faces": "有人脸 (%d 张)"}
ALONE, NOTHING = "唯一帧 — 自动入选", "簇内默认"


def _known(name: str) -> Column:
    return F.coalesce(F.nanvl(F.col(name).try_cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def _unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def _less(name: str) -> Column:
    """1 less the value, in 0..1; 0 if it is missing."""
    value = F.nanvl(F.col(name).try_cast("double"), F.lit(None).cast("double"))
    return F.coalesce(_unit(1.0 - value), F.lit(0.0))


def weights_of(scene: Column) -> Column:
    """The weights that a scene picks, as an array in the order of SIGNALS."""
    table = lambda w: F.array(*[F.lit(float(x)) for x in w])
    name = F.lower(F.trim(scene))
    return reduce(lambda rest, kv: F.when(name == kv[0], table(kv[1])).otherwise(rest), WEIGHTS.items(), table(OTHERWISE))


def _joined(rows: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    there = sums.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(there[f"_of_{k}"]) for k in keys])
    return rows.join(there, on, "left").drop(*[f"_of_{k}" for k in keys])


def modal_scene(rows: DataFrame, keys: list[str], scene: str, order: str) -> DataFrame:
    """keys and _scene: the most frequent scene in lower case, of equals the one that comes first."""
    named = rows.filter(F.coalesce(F.col(scene), F.lit("")) != "").groupBy(*keys, F.lower(scene).alias("_name")).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return named.groupBy(*keys).agg(F.min_by("_name", F.struct(-F.col("_n"), "_first")).alias("_scene"))


def distances(rows: DataFrame, keys: list[str], vector: str, order: str) -> DataFrame:
    """rows with _far: 1 less the cosine of the vector and the mean vector of its burst."""
    filled = rows.filter(F.size(vector) > 0)
    whole = filled.groupBy(*keys).agg(F.count("*").alias("_vectors"), F.min_by(F.size(vector), order).alias("_width"))
    # summed by place before the shuffle, so a burst of any size comes as one number per place and task
    sums = filled.select(*keys, F.posexplode(vector).alias("_p", "_v")).groupBy(*keys, "_p").agg(F.sum("_v").alias("_v"))
    sums = sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_v"))), lambda x: x["_v"]).alias("_sum"))
    mean = _joined(sums, whole, keys).withColumn("_mean", F.transform(F.slice("_sum", F.lit(1), F.col("_width")), lambda x: x / F.col("_vectors"))).select(*keys, "_mean")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda t, x: t + x)
    v, m = F.col(vector), F.col("_mean")
    long = F.sqrt(dot(v, v)), F.sqrt(dot(m, m))
    far = F.when((F.size(v) == F.size(m)) & (long[0] > 1e-9) & (long[1] > 1e-9), 1.0 - dot(v, m) / (long[0] * long[1]))
    return _joined(rows, mean, keys).withColumn("_far", F.coalesce(far, F.lit(0.0))).drop("_mean")


def ranked(rows: DataFrame, keys: list[str], name: str, fields: dict[str, str], scene: str, vector: str, order: str) -> DataFrame:
    """rows with peak_score, place (from 0) and reason within each burst.

    keys: run and burst, of which the last is the burst; fields: the columns of sharpness, quality, blink, smile, brow and
    faces (their number); order: what comes first in a burst.
    """
    burst = distances(rows.filter(F.col(keys[-1]).isNotNull()), keys, vector, order)
    smile = F.coalesce(F.nanvl(F.col(fields["smile"]).try_cast("double"), F.lit(None).cast("double")), F.lit(0.0))
    burst = burst.withColumns({
        "_sharpness": _known(fields["sharpness"]), "_quality": _known(fields["quality"]), "_eyes": _less(fields["blink"]), "_smile": _unit(smile), "_brow": _less(fields["brow"]),
        "_hundredths": F.least(F.lit(MOST_FACES), F.coalesce(F.col(fields["faces"]), F.lit(0)) * PER_FACE),
    })
    burst = burst.withColumn("_faces", F.col("_hundredths") / 100)
    span = burst.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_far").alias("_lo"), F.max("_far").alias("_hi"))
    burst = _joined(burst, span, keys).withColumn("_distinctness", F.when(F.col("_hi") - F.col("_lo") < 1e-9, 0.0).otherwise((F.col("_far") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))))
    burst = _joined(burst, modal_scene(rows, keys, scene, order), keys).withColumn("_w", weights_of(F.col("_scene")))
    # summed in the burst's order, and faces in whole hundredths, so that last digits, which decide between level signals, don't depend on how rows are dealt
    whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    burst = burst.withColumns({f"_mean_{s}": F.avg(f"_{s}").over(whole) for s in SIGNALS if s != "faces"} | {"_mean_faces": F.sum("_hundredths").over(whole) / (F.col("_n") * 100)})
    weight = {s: F.col("_w")[i] for i, s in enumerate(SIGNALS)}
    blend = reduce(lambda a, b: a + b, [weight[s] * F.col(f"_{s}") for s in SIGNALS])
    above = {s: weight[s] * (F.col(f"_{s}") - F.col(f"_mean_{s}")) for s in REASONS}
    most = F.greatest(*above.values())
    shown = {s: F.col(fields["faces"]).cast("int") if s == "faces" else F.col(f"_{s}") if s == "quality" else F.col(f"_{s}") * 100 for s in REASONS}
    reason = reduce(lambda rest, s: F.when(above[s] == most, F.format_string(REASONS[s], shown[s])).otherwise(rest), reversed(REASONS), F.lit(None))
    alone = F.col("_n") == 1
    scored = burst.withColumns({"peak_score": F.when(alone, 1.0).otherwise(blend), "reason": F.when(alone, ALONE).when(most > 0, reason).otherwise(NOTHING)})
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("peak_score"), F.desc("_quality"), name)) - 1
    return scored.withColumn("place", place).select(*[F.col(c) for c in rows.columns], "peak_score", "place", "reason")


def annotated(rows: DataFrame, keys: list[str], name: str, fields: dict[str, str], scene: str, vector: str, order: str, peak: str) -> DataFrame:
    """rows with burst_peak_reason on those that are marked as their burst's peak, in bursts of two or more."""
    found = ranked(rows, keys, name, fields, scene, vector, order)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    told = _joined(found, sizes, keys).withColumn("burst_peak_reason", F.when(F.col(peak) & (F.col("_n") > 1), F.col("reason")))
    out = told.select(*[F.col(c) for c in rows.columns], "burst_peak_reason")
    return out.unionByName(rows.filter(F.col(keys[-1]).isNull()).withColumn("burst_peak_reason", F.lit(None).cast("string")))
