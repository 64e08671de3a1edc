"""Review libraries: what a user's decisions say, audits of labels, tokens and links, sort orders and filters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.operators.similarity import in_blocks, matrix

#: Expected share of kept photos, how far a user's share may shift the threshold, and the base thresholds.
KEEP_RATE, SHIFT, KEEP, MAYBE = 0.65, 0.08, 0.62, 0.45
#: Most vectors of a label in a library, and from how many clusters a label is fragmented.
LABEL_VECTORS, FRAGMENTED = 16, 14
#: Shares of the first, the first two and unknown scenes that are odd, and the fewest photos that tell.
ONE_SCENE, TWO_SCENES, UNKNOWN, FEWEST = 0.60, 0.95, 0.30, 10
#: A judge must lead the rules by this much.
LEAD = 0.02


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def preferences(examples: DataFrame, decision: str, axes: list[str]) -> DataFrame:
    """One row per decision: the number of photos and the mean stars of each axis, missing stars as 0."""
    known = examples.filter(F.col(decision).isin("keep", "maybe", "cull"))
    return known.groupBy(decision).agg(F.count("*").alias("n"), *[F.avg(F.coalesce(a, F.lit(0.0))).alias(a) for a in axes])


def profile(preferred: DataFrame, decision: str, axes: list[str]) -> DataFrame:
    """One row: share of kept and culled photos, the shift of the threshold, and the axis that kept photos lead in most."""
    of = lambda c, d: F.max(F.when(F.col(decision) == d, F.col(c)))
    gaps = [F.struct((of(a, "keep") - of(a, "cull")).alias("gap"), F.lit(-i).alias("i"), F.lit(a).alias("axis")) for i, a in enumerate(axes)]
    total, keep, cull = F.sum("n"), F.coalesce(of("n", "keep"), F.lit(0)), F.coalesce(of("n", "cull"), F.lit(0))
    one = preferred.agg(total.alias("n"), (keep / total).alias("keep_rate"), (cull / total).alias("cull_rate"), F.array(*gaps).alias("gaps"))
    best = F.array_max(F.filter("gaps", lambda g: g["gap"].isNotNull()))
    return one.select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("keep_rate", F.lit(KEEP_RATE)).alias("keep_rate"), F.coalesce("cull_rate", F.lit(0.0)).alias("cull_rate"), clamp(-(F.coalesce("keep_rate", F.lit(KEEP_RATE)) - KEEP_RATE) / 2, -SHIFT, SHIFT).alias("shift"), best["axis"].alias("axis"))


def personal_decision(axes: list[str], weights: list[Column], shift: Column) -> Column:
    """keep, maybe or cull by the weighted mean of the axes' stars against the shifted thresholds."""
    score = reduce(lambda a, b: a + b, [w * F.coalesce(a, F.lit(0.0)) for a, w in zip(axes, weights, strict=True)]) / 5
    return F.when(score >= KEEP + shift, "keep").when(score >= MAYBE + shift / 2, "maybe").otherwise("cull")


def score_parts(final: Column, stars: Column, p_keep: Column) -> tuple[Column, Column, Column]:
    """What the axes, the learned score and the rules (what is left) give to a final score."""
    known = F.filter(stars, lambda x: x.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known) / 5).otherwise(0.0)
    learned = (F.coalesce(p_keep, F.lit(0.5)) - 0.5) * 0.3
    return mean, learned, F.coalesce(final, F.lit(0.0)) - mean - learned


def reweighted(stars: Column, muted: Column, boosts: Column) -> Column:
    """A map of axes without the muted ones, times their boosts (1 where there is none)."""
    left = F.map_filter(stars, lambda k, v: ~F.array_contains(muted, k) & v.isNotNull())
    return F.transform_values(left, lambda k, v: v * F.coalesce(F.try_element_at(boosts, k), F.lit(1.0)))


def latest_joined(decisions: DataFrame, stars: DataFrame, keys: list[str]) -> DataFrame:
    """Decisions with the stars of the same photo, found by the first key that both have; photos without stars go."""
    key = lambda d: F.coalesce(*[F.nullif(F.col(k).cast("string"), F.lit("")) for k in keys])
    right = stars.withColumn("_key", key(stars)).drop(*keys)
    return decisions.withColumn("_key", key(decisions)).join(right, "_key").drop("_key")


def provenance(human: DataFrame, auto: DataFrame, key: str, axes: list[str]) -> DataFrame:
    """auto with each axis taken from the human stars where there are any, and where it came from."""
    renamed = human.select(key, *[F.col(a).alias(f"_{a}") for a in axes])
    rows = auto.join(renamed, key, "left")
    return rows.select(key, *[F.coalesce(f"_{a}", a).alias(a) for a in axes], *[F.when(F.col(f"_{a}").isNotNull(), "human").when(F.col(a).isNotNull(), "auto").alias(f"{a}_source") for a in axes])


def fragmentation(clusters: DataFrame, label: str, floor: int = FRAGMENTED) -> DataFrame:
    """Clusters by label, most first, and whether there are too many."""
    return clusters.groupBy(label).agg(F.count("*").alias("n")).withColumn("fragmented", F.col("n") >= floor).orderBy(F.desc("n"), label)


def kept_vectors(library: DataFrame, label: str, order: list[Column], most: int = LABEL_VECTORS) -> DataFrame:
    """The newest vectors of each label, at most so many: older ones make room."""
    return library.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(*order))).filter(F.col("_r") <= most).drop("_r")


def continuity(current: DataFrame, library: DataFrame, vector: str, least: float = 0.5) -> DataFrame:
    """How many centres of a run match some centre of the library, and their share. The library comes in blocks of a bounded size."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                held = batch.column("held").slice(0, 1).flatten()
                hit = np.flatnonzero((matrix(batch.column("_v")) @ matrix(held.field("qv")).T >= least).any(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column("_row").take(pa.array(hit))], ["_row"])

    rows = current.select(F.monotonically_increasing_id().alias("_row"), F.col(vector).alias("_v"))
    blocks = in_blocks(library.select(F.monotonically_increasing_id().alias("_q"), vector), "_q", vector)
    found = reduce(DataFrame.union, [rows.crossJoin(F.broadcast(block)).mapInArrow(met, "_row bigint") for block in blocks])
    matched = found.agg(F.count_distinct("_row").alias("matched"))  # one row
    return current.agg(F.count("*").alias("n")).crossJoin(matched).withColumn("share", F.try_divide(F.col("matched"), F.col("n")))


def cluster_summary(rows: DataFrame, photo: str, clusters: str) -> DataFrame:
    """Of each cluster (noise too): faces, photos, and the first five photos by name."""
    each = rows.select(photo, F.explode(clusters).alias("cluster_id"))
    first = each.distinct().withColumn("_r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(photo))).filter("_r <= 5")
    names = first.groupBy("cluster_id").agg(F.sort_array(F.collect_list(photo)).alias("first"))
    return each.groupBy("cluster_id").agg(F.count("*").alias("n_faces"), F.count_distinct(photo).alias("n_photos")).join(names, "cluster_id")


def scene_anomaly(rows: DataFrame, keys: list[str], scene: str) -> DataFrame:
    """Shares of the commonest scene, the commonest two and unknown ones by key, and what is odd about them."""
    counts = rows.groupBy(*keys, F.coalesce(scene, F.lit("unknown")).alias("_s")).agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), "_s"))
    c = counts.withColumn("_r", place).groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_r") == 1, F.col("_n"))).alias("a"), F.sum(F.when(F.col("_r") <= 2, F.col("_n"))).alias("b"), F.coalesce(F.sum(F.when(F.col("_s") == "unknown", F.col("_n"))), F.lit(0)).alias("u"))
    top, two, unknown = F.col("a") / F.col("n"), F.col("b") / F.col("n"), F.col("u") / F.col("n")
    why = F.when(F.col("n") < FEWEST, None).when(unknown >= UNKNOWN, "unknown").when(top >= ONE_SCENE, "one scene").when(two >= TWO_SCENES, "two scenes")
    return c.select(*keys, "n", top.alias("top1"), two.alias("top2"), unknown.alias("unknown"), why.alias("anomaly"))


ORDERS = {
    "score_desc": [F.desc, "score", -1.0], "score_asc": [F.asc, "score", 999.0], "datetime_asc": [F.asc, "time", ""], "datetime_desc": [F.desc, "time", ""],
    "style_distance_asc": [F.asc, "style_distance", 99.0],
}


def sort_key(mode: str) -> list[Column]:
    """The order of a mode over score, time, style_distance, cluster_id, p_keep and decision; missing values go where the mode puts them."""
    c = F.coalesce
    if mode in ORDERS:
        way, column, missing = ORDERS[mode]
        return [way(c(F.col(column), F.lit(missing)))]
    if mode == "cluster":
        return [F.asc(c(F.col("cluster_id"), F.lit(10**9))), F.desc(c(F.col("score"), F.lit(0.0)))]
    if mode == "uncertain":
        return [F.asc(c(F.abs(c(F.col("p_keep"), F.col("score")) - 0.5), F.lit(99.0)))]
    if mode == "disagree":
        return [F.desc(c(F.abs(F.col("p_keep") - 0.5), F.lit(-1.0)))]
    rank = F.when(F.col("decision") == "keep", 0).when(F.col("decision") == "maybe", 1).when(F.col("decision") == "cull", 2).when(F.col("decision") == "", 3).otherwise(4)
    return [F.asc(rank), F.desc(c(F.col("score"), F.lit(0.0)))]


def matching(spec: dict) -> Column:
    """A saved filter as one predicate: {column: {"in": [...]} | {"any": [...]} | {"least": x} | {"most": x} | {"null": True}}, all of them."""
    tests = []
    for name, rule in spec.items():
        c = F.col(name)
        for op, value in rule.items():
            tests.append({"in": lambda c, v: c.isin(*v), "any": lambda c, v: F.arrays_overlap(c, F.array(*map(F.lit, v))), "least": lambda c, v: c >= v, "most": lambda c, v: c <= v, "null": lambda c, v: c.isNull() == v}[op](c, value))
    return reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(True))


def inconsistencies(rows: DataFrame, n: int) -> DataFrame:
    """The n photos to look at again: first those a human contradicts, then those nearest to the threshold."""
    s = F.col("score")
    human = F.col("labelled") & (((F.col("decision") == "keep") & (s < 0.55)) | ((F.col("decision") == "cull") & (s > 0.55)))
    near = F.abs(s - KEEP_RATE)
    tier = F.when(human, 0.0).when(near < 0.06, 1 + near)
    return rows.withColumn("tier", tier).filter("tier is not null").orderBy("tier", "photo_id").limit(n)


def issued(log: DataFrame, url: str, code: str, at: str, ttl: str) -> DataFrame:
    """The links of a log of requests: one for a url while it has not expired, then a new one. A request at the very end of a link's time makes a new one."""
    step = lambda acc, x: F.when(acc["end"].isNull() | (x["at"] >= acc["end"]), F.struct((x["at"] + x["ttl"]).alias("end"), F.concat(acc["out"], F.array(x)).alias("out"))).otherwise(acc)
    rows = log.groupBy(url).agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), F.col(code).alias("code"), F.col(ttl).alias("ttl")))).alias("_r"))
    none = F.struct(F.lit(None).cast("bigint").alias("end"), F.array().cast("array<struct<at: bigint, code: bigint, ttl: bigint>>").alias("out"))
    links = rows.select(url, F.explode(F.aggregate("_r", none, step, lambda a: a["out"])).alias("l"))
    return links.select(url, F.col("l.code").alias(code), F.col("l.at").alias("issued"), (F.col("l.at") + F.col("l.ttl")).alias("expires"))


def active(expires: Column, revoked: Column, now: Column) -> Column:
    """Whether a session or link still holds."""
    return ~F.coalesce(revoked, F.lit(False)) & (expires.isNull() | (now < expires))


def best_mode(scores: dict[str, Column], base: str = "off") -> Column:
    """The mode of the highest score, the first of equals; the base one unless it is led clearly."""
    rows = F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("i"), F.lit(n).alias("mode")) for i, (n, s) in enumerate(scores.items())])
    best = F.array_max(rows)
    return F.when(best["s"] - scores[base] < LEAD, base).otherwise(best["mode"])


def unmeasurable(rows: DataFrame, truth: str, labels: list[str]) -> DataFrame:
    """Labels that the sample has no example of."""
    wanted = rows.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    return wanted.join(rows.select(F.col(truth).alias("label")).distinct(), "label", "left_anti")


def record_times(clips: DataFrame, order: list[str], length: str, keys: list[str] | None = None) -> DataFrame:
    """clips with when each begins and ends on the recording, one after the other within the keys."""
    w = Window.partitionBy(*(keys or [])).orderBy(*order)
    return clips.withColumn("rec_out", F.sum(length).over(w)).withColumn("rec_in", F.col("rec_out") - F.col(length)).withColumn("event", F.row_number().over(w))


def budgeted(clips: DataFrame, run: str, order: list[Column], length: str, target: float) -> DataFrame:
    """The first clips of each run until its share of the target, at least 2, is reached (the clip that crosses it included)."""
    runs = clips.agg(F.count_distinct(run).alias("_runs"))
    w = Window.partitionBy(run).orderBy(*order)
    before = F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = clips.withColumn("_b", before).crossJoin(runs)
    return rows.filter(F.col("_b") < F.greatest(F.lit(2.0), target / F.greatest(F.col("_runs"), F.lit(1)))).drop("_b", "_runs")


def surviving_text(words: DataFrame, holes: DataFrame, keys: list[str], time: str, end: str, order: list[str], text: str) -> DataFrame:
    """The words that no cut touches, joined in order. Cuts are few per clip: each word looks them up in one array."""
    cut = holes.groupBy(*keys).agg(F.collect_list(F.struct(F.col("s"), F.col("e"))).alias("_cuts"))
    rows = words.join(cut, keys, "left")
    hit = F.coalesce(F.exists("_cuts", lambda c: (c["s"] < F.col(end)) & (c["e"] > F.col(time))), F.lit(False))
    kept = rows.filter(~hit).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, text))).alias("_w"))
    return kept.select(*keys, F.array_join(F.transform("_w", lambda x: x[text]), " ").alias("kept"))


def flag_lift(rows: DataFrame, flags: str, group: list[str], before: Column, after: Column, fewest: int = 8) -> DataFrame:
    """For each flag (and group) of at least so many rows: how often the decision was right before and after, and the gain."""
    each = rows.withColumns({"_b": before.cast("int"), "_a": after.cast("int")}).withColumn("flag", F.explode(flags))
    out = each.groupBy("flag", *group).agg(F.count("*").alias("n"), F.avg("_b").alias("before"), F.avg("_a").alias("after")).filter(F.col("n") >= fewest)
    return out.withColumn("lift", F.col("after") - F.col("before"))


def first_templates(rows: DataFrame, templates: DataFrame, key: str, axis: str, most: int) -> DataFrame:
    """For each row and axis the first template that passes; at most so many per row, in the order of the axes.

    rows: key, axis, axis_pos, stars, vertical and value by metric; templates: axis, vertical (null: any), pos, metric,
    threshold and low, high stars. Templates of a vertical come before general ones. Templates are a small table of rules.
    """
    t = templates.withColumnRenamed("vertical", "_v")
    met = rows.join(F.broadcast(t), axis).filter((F.col("_v").isNull() | (F.col("_v") == F.col("vertical"))) & F.col("stars").between(F.col("low"), F.col("high")))
    met = met.withColumn("_value", F.try_element_at("metrics", F.col("metric"))).filter(F.col("_value") >= F.col("threshold"))
    first = met.groupBy(key, axis, "axis_pos").agg(F.min(F.struct(F.col("_v").isNull().alias("g"), "pos", "phrase")).alias("t"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("axis_pos"))
    return first.withColumn("place", place).filter(F.col("place") <= most).select(key, axis, "place", "t.phrase")
