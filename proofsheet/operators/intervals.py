"""Intervals: union, difference, containment and band joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: gaps and remainders up to this many seconds don't count.
GAP = 0.04


def union_spans(df: DataFrame, keys: list[str], start: str = "s", end: str = "e", gap: float = GAP) -> DataFrame:
    """Spans merged where they touch, overlap or are at most gap apart."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.filter(F.col(end) > F.col(start)).withColumn("_new", F.when(F.col(start) - reach <= gap, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w))
    return rows.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def subtract_spans(base: DataFrame, holes: DataFrame, keys: list[str], start: str = "s", end: str = "e", gap: float = GAP) -> DataFrame:
    """What holes leave of each base span; remainders up to gap are dropped. Both sides are merged first."""
    b, h = union_spans(base, keys, start, end), union_spans(holes, keys, start, end)
    # points where the two covers change, swept in order
    points = b.select(*keys, F.col(start).alias("x"), F.lit(1).alias("db"), F.lit(0).alias("dh")).union(b.select(*keys, F.col(end), F.lit(-1), F.lit(0)))
    points = points.union(h.select(*keys, F.col(start), F.lit(0), F.lit(1))).union(h.select(*keys, F.col(end), F.lit(0), F.lit(-1)))
    points = points.groupBy(*keys, "x").agg(F.sum("db").alias("db"), F.sum("dh").alias("dh"))
    w = Window.partitionBy(*keys).orderBy("x")
    run = points.withColumns({"b": F.sum("db").over(w), "h": F.sum("dh").over(w), "next": F.lead("x").over(w)})
    kept = run.filter("b > 0 and h = 0 and next is not null").select(*keys, F.col("x").alias(start), F.col("next").alias(end))
    return union_spans(kept, keys, start, end, 0.0).filter(F.col(end) - F.col(start) > gap)


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, width: float) -> DataFrame:
    """Rows of equal keys whose times are at most width apart: an equi-join on bins of that width and their neighbours."""
    a = left.withColumn("_bin", F.floor(F.col(left_time) / width))
    b = right.withColumn("_bin", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.floor(F.col(right_time) / width) + d)))
    return a.join(b, [*keys, "_bin"]).filter(F.abs(F.col(left_time) - F.col(right_time)) <= width).drop("_bin")


def containing(points: DataFrame, spans: DataFrame, keys: list[str], time: str, start: str, end: str, bin_s: float) -> DataFrame:
    """Points with the spans that hold them (both ends included). Spans are cut into bins; bin_s about their usual length."""
    a = points.withColumn("_bin", F.floor(F.col(time) / bin_s))
    b = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_s), F.floor(F.col(end) / bin_s))))
    return a.join(b, [*keys, "_bin"], "inner").filter((F.col(time) >= F.col(start)) & (F.col(time) <= F.col(end))).drop("_bin")


def count_before(points: DataFrame, cuts: DataFrame, keys: list[str], time: str, cut: str) -> DataFrame:
    """points with the number of cuts at or before each: one sorted pass over both."""
    a = points.withColumns({"_cut": F.lit(0), "_x": F.col(time)})
    b = cuts.select(*keys, F.lit(1).alias("_cut"), F.col(cut).alias("_x"))
    w = Window.partitionBy(*keys).orderBy("_x", F.desc("_cut"))
    return a.unionByName(b, allowMissingColumns=True).withColumn("shot_index", F.sum("_cut").over(w)).filter("_cut = 0").drop("_cut", "_x")


def spaced(times: Column, least: float) -> Column:
    """Of ordered times those at least so far after the last one kept."""
    return F.aggregate(F.sort_array(times), F.array().cast("array<double>"), lambda kept, t: F.when((F.size(kept) == 0) | (t - F.element_at(kept, -1) >= least), F.concat(kept, F.array(t))).otherwise(kept))


def overlap_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Overlap of [a, b] and [c, d] over the shorter one."""
    shorter = F.least(b - a, d - c)
    return F.when(shorter > 0, F.greatest(F.least(b, d) - F.greatest(a, c), F.lit(0.0)) / shorter).otherwise(0.0)


def true_runs(df: DataFrame, keys: list[str], time: str, flag: str, hop: float, least: float) -> DataFrame:
    """Runs of true flags at least so long; a run ends a hop after its last row."""
    w = Window.partitionBy(*keys).orderBy(time)
    rows = df.withColumn("_new", F.when(F.lag(flag).over(w).eqNullSafe(F.col(flag)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    runs = rows.filter(F.col(flag)).groupBy(*keys, "_run").agg(F.min(time).alias("s"), (F.max(time) + hop).alias("e"), F.count("*").alias("n")).drop("_run")
    return runs.filter(F.col("e") - F.col("s") >= least)


def replay(ops: DataFrame, keys: list[str]) -> DataFrame:
    """Deleted spans after an ordered list of operations (seq, op, s, e): delete adds, restore takes away, undo takes the last
    one back, redo returns it. A delete or restore of an empty or reversed span is no operation: it neither enters the history
    nor ends what redo may return. A session's operations depend on each other, so a session is one group; sessions run in parallel.
    """
    import pandas as pd

    schema = ", ".join([f"{k} bigint" for k in keys] + ["s double", "e double"])

    def merged(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for s, e in sorted(spans):
            if out and s - out[-1][1] <= GAP:
                out[-1] = (out[-1][0], max(out[-1][1], e))
            else:
                out.append((s, e))
        return out

    def without(spans: list[tuple[float, float]], s: float, e: float) -> list[tuple[float, float]]:
        parts = [p for a, b in spans for p in ((a, min(b, s)), (max(a, e), b))]
        return [(a, b) for a, b in parts if b - a > GAP]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        done: list[tuple] = []
        undone: list[tuple] = []
        for op, s, e in pdf.sort_values("seq")[["op", "s", "e"]].itertuples(index=False, name=None):
            if op == "undo":
                undone += [done.pop()] if done else []
            elif op == "redo":
                done += [undone.pop()] if undone else []
            elif e > s:
                done.append((op, s, e))
                undone = []
        spans = reduce(lambda held, o: merged([*held, o[1:]]) if o[0] == "delete" else without(held, o[1], o[2]), done, [])
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "s": s, "e": e} for s, e in spans], columns=[*keys, "s", "e"])

    return ops.groupBy(*keys).applyInPandas(fold, schema)
