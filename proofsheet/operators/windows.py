"""Features of frames in time order, and windows of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Digits that values are compared in: means of the same numbers agree in them, whatever the order of their sums.
DIGITS = 12


def in_places(value: str) -> Column:
    """The value in 18 places; null for NaN, infinities, and 1e20 and above."""
    return F.col(value).try_cast("decimal(38,18)")


def steady_mean(value: str, places: Column) -> Column:
    """The mean, summed in 18 places without rounding, so that its last digits don't depend on how rows are dealt; for scores, not for values near 0 alone.

    places: the value by in_places. Where a value has none, or the sum is too large, the plain mean.
    """
    return F.when(F.count(value) == F.count(places), F.coalesce(F.try_avg(places).cast("double"), F.avg(value))).otherwise(F.avg(value))


def centred(keys: list[str], order: list, half: int):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half)


def motion_continuity(df: DataFrame, keys: list[str], order: list, dx: str, dy: str, half: int = 2, still: float = 0.0) -> Column:
    """Length of the summed motion over the summed lengths, in a centred window; a still window is 1."""
    w = centred(keys, order, half)
    size = F.sqrt(F.col(dx) * F.col(dx) + F.col(dy) * F.col(dy))
    total = F.sum(size).over(w)
    along = F.sqrt(F.pow(F.sum(dx).over(w), F.lit(2)) + F.pow(F.sum(dy).over(w), F.lit(2)))
    return F.when((F.avg(size).over(w) < still) | (total <= 0), 1.0).otherwise(F.least(along / total, F.lit(1.0)))


def smoothness(df: DataFrame, keys: list[str], order: list, value: str, scale: float, half: int = 2) -> DataFrame:
    """exp(-mean |change| / scale) over a centred window."""
    change = F.coalesce(F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))), F.lit(0.0))
    return df.withColumn("_d", change).withColumn("smoothness", F.exp(-F.avg("_d").over(centred(keys, order, half)) / scale)).drop("_d")


def local_event(keys: list[str], order: list, value: str, half: int = 4) -> Column:
    """How far a value stands out of its window: half its z score, in [0, 1]."""
    w = centred(keys, order, half)
    sd = F.stddev_pop(value).over(w)
    return F.when(sd < 1e-9, 0.0).otherwise(F.least(F.greatest((F.col(value) - F.avg(value).over(w)) / sd / 2, F.lit(0.0)), F.lit(1.0)))


def robust_norm(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """|x| over its 95th percentile within the key, at most 1. The percentile is joined back: no window over a whole key."""
    top = df.groupBy(*keys).agg(F.percentile(F.abs(F.col(value)), F.lit(0.95)).alias("_top"))
    return df.join(top, keys).withColumn(out, F.when(F.col("_top") > 0, F.least(F.abs(F.col(value)) / F.col("_top"), F.lit(1.0))).otherwise(0.0)).drop("_top")


def min_max(keys: list[str], value: str) -> Column:
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.coalesce(F.try_divide(F.col(value) - low, F.nullif(high - low, F.lit(0.0))), F.lit(0.0))


def tumbling(df: DataFrame, keys: list[str], time: str, length: float, final: str, temporal: str, tie: str) -> DataFrame:
    """Windows that begin at the key's first time: mean and peak score, and the best frame. Empty windows are left out."""
    start = df.groupBy(*keys).agg(F.min(time).alias("_t0"))
    rows = df.join(start, keys).withColumn("window_no", F.floor((F.col(time) - F.col("_t0")) / length))
    best = F.max_by(tie, F.struct(temporal, -F.col(tie)))
    return rows.groupBy(*keys, "window_no").agg(F.count("*").alias("n"), F.avg(final).alias("mean_final"), F.max(temporal).alias("peak"), best.alias("best_frame"))


def sliding(df: DataFrame, keys: list[str], time: str, length: float, stride: float) -> DataFrame:
    """Each row once per window [start, start + length) that holds it; starts are multiples of stride from the key's first time."""
    start = df.groupBy(*keys).agg(F.min(time).alias("_t0"))
    rows = df.join(start, keys).withColumn("_at", F.col(time) - F.col("_t0"))
    low = F.greatest(F.lit(0), F.floor((F.col("_at") - length) / stride) + 1).cast("bigint")
    return rows.withColumn("window_no", F.explode(F.sequence(low, F.floor(F.col("_at") / stride).cast("bigint")))).drop("_t0", "_at")


def confidence(final: str, temporal: str, stability: Column) -> Column:
    """Trust in a window of frames: even quality, enough frames, a peak, steadiness."""
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return unit(0.30 * unit(1 - F.stddev_pop(final) / 0.25) + 0.20 * unit(F.count("*") / 3.0) + 0.25 * unit(F.max(temporal)) + 0.25 * unit(F.avg(stability)))


def prefix_until(keys: list[str], order: list, length: str, target: float, most: int) -> Column:
    """Whether a row is in the ordered prefix that first reaches a total length (the row that crosses it included)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return (before < target) & (F.row_number().over(w) <= most)


def reel(df: DataFrame, keys: list[str], least: int = 10, most: int = 20, overlap: float = 0.6, floor: float = 0.05, gap_s: float = 3.0, same: float = 0.4) -> DataFrame:
    """Greedy choice of diverse windows of each clip: base score times novelty, overlapping ones dropped.

    Novelty is 1 less the largest likeness to a window chosen before: the overlap over the shorter of the two, or `same` if
    their scenes are one (null is none) and at most gap_s lies between them. Windows that overlap a choice by more than
    `overlap` go; once `least` are chosen, a best one of a novelty under `floor` ends the choice. Of equal values the first by
    start, end and number is taken; values are equal up to DIGITS, since sums of the same frames may differ in their last digits.

    df has start_s, end_s, base, scene and a window_no per key. Each choice depends on those before, so a clip is one group;
    a clip's windows are few and clips run in parallel.
    """
    import pandas as pd

    schema = ", ".join([f"{k} bigint" for k in keys] + ["rank int", "window_no bigint", "score double", "novelty double"])

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pool = list(pdf.sort_values(["start_s", "end_s", "window_no"]).itertuples(index=False))
        chosen: list = []
        share = lambda a, b: max(0.0, min(a.end_s, b.end_s) - max(a.start_s, b.start_s)) / short if (short := min(a.end_s - a.start_s, b.end_s - b.start_s)) > 0 else 0.0
        one = lambda a, b: same if pd.notna(a.scene) and a.scene == b.scene and max(a.start_s, b.start_s) - min(a.end_s, b.end_s) <= gap_s else 0.0
        while pool and len(chosen) < most:
            scored = [(w.base * (nov := min(1.0, max(0.0, 1 - max([max(share(w, c), one(w, c)) for _, _, c in chosen], default=0.0)))), nov, w) for w in pool]
            value, novelty, best = max(scored, key=lambda x: round(x[0], DIGITS))
            if len(chosen) >= least and novelty < floor:
                break
            chosen.append((value, novelty, best))
            pool = [w for w in pool if w is not best and share(w, best) <= overlap]
        chosen.sort(key=lambda x: (-round(x[0], DIGITS), x[2].start_s, x[2].end_s, x[2].window_no))
        rows = [{**{k: getattr(w, k) for k in keys}, "rank": i + 1, "window_no": w.window_no, "score": v, "novelty": n} for i, (v, n, w) in enumerate(chosen)]
        return pd.DataFrame(rows, columns=[*keys, "rank", "window_no", "score", "novelty"])

    return df.groupBy(*keys).applyInPandas(pick, schema)
