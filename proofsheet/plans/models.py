"""Learned scores: features, rule baselines, gates, and models held to their accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofsheet.operators import models as O
from proofsheet.plans.catalog import query
from proofsheet.plans.library import _STAR, starred

NUMBERS = ["lap", "sharp", "luma", "moment"]


@query(f"WITH {_STAR} SELECT m.photo_id, lap * 1.0::DOUBLE AS lap, m.sharp, luma, moment, CAST(lap IS NULL AS INT) AS lap__missing, 0 AS sharp__missing, 0 AS luma__missing, CAST(moment IS NULL AS INT) AS moment__missing FROM v_metrics m")
def feature_table(spark, sf):
    rows = O.feature_table(starred(spark, sf), NUMBERS)
    return rows.select("photo_id", *NUMBERS, *[f"{c}__missing" for c in NUMBERS])


@query(f"""WITH {_STAR}, t AS (SELECT scene, k % 3 <> 0 AS t, decision = 'keep' AS p FROM st WHERE decision <> 'cull') SELECT scene, count(*) AS n, avg(CAST(t = p AS INT)) AS accuracy, coalesce(avg(CAST(p AS INT)) FILTER (t), 0.0) AS keep_recall, coalesce(avg(CAST(NOT p AS INT)) FILTER (NOT t), 0.0) AS maybe_recall FROM t GROUP BY scene""")
def rule_baseline(spark, sf):
    rows = starred(spark, sf).filter("decision != 'cull'")
    return O.binary_report(rows, ["scene"], F.col("k") % 3 != 0, F.col("decision") == "keep")


_AUC = f"{_STAR}, r AS (SELECT scene, CAST(k % 3 <> 0 AS INT) AS y, floor(score_final * 100) AS s FROM st), a AS (SELECT r.scene, sum(CASE WHEN r.s > q.s THEN c WHEN r.s = q.s THEN c / 2.0 ELSE 0 END) / (any_value(pn.p) * any_value(pn.n)) AS auc FROM r JOIN (SELECT scene, s, count(*) AS c FROM r WHERE y = 0 GROUP BY ALL) q ON q.scene = r.scene JOIN (SELECT scene, sum(y) AS p, sum(1 - y) AS n FROM r GROUP BY scene) pn ON pn.scene = r.scene WHERE r.y = 1 GROUP BY r.scene)"


def _auc(spark, sf):
    rows = starred(spark, sf).select("scene", (F.col("k") % 3 != 0).cast("int").alias("y"), F.floor(F.col("score_final") * 100).alias("s"))
    return O.auc(rows, ["scene"], "y", "s")


@query(f"WITH {_AUC} SELECT scene, auc FROM a")
def scene_auc(spark, sf):
    return _auc(spark, sf)


@query(f"WITH {_AUC} SELECT scene, auc, CASE WHEN scene <> 'event' THEN 0.5::DOUBLE END AS base, CASE WHEN scene = 'event' THEN true ELSE auc >= 0.5 - 0.005 END AS passes FROM a")
def metric_gate(spark, sf):
    base = _auc(spark, sf).filter("scene != 'event'").select("scene", F.lit(0.5).alias("auc"))
    return O.gate(_auc(spark, sf), base, ["scene"], "auc", 0.005)


def examples(spark, sf):
    """Photos with a label that their features tell, but for a tenth."""
    rows = O.feature_table(starred(spark, sf), NUMBERS)
    told = (F.col("sharp") > 0.5) | (F.col("lap").isNull() & (F.col("luma") > 128))
    return rows.withColumn("y", F.when(F.col("photo_id") % 10 == 3, ~told).otherwise(told).cast("int"))


@query()
def cross_validation(spark, sf):
    """Out-of-fold accuracy, recall and AUC by scene; a test holds them to the rule that made the labels."""
    found = O.out_of_fold(examples(spark, sf), "photo_id", "y", NUMBERS, ["scene"], 3)
    report = O.binary_report(found, ["scene"], F.col("y") == 1, F.col("pred") == "keep")
    return report.join(O.auc(found, ["scene"], "y", "prob_keep"), "scene")


@query()
def learned_stars(spark, sf):
    """Stars of each axis by a regressor; an axis with too few stars gets none."""
    rows = O.feature_table(starred(spark, sf), NUMBERS).withColumns({"clear": 1 + 4 * F.col("sharp"), "rare": F.when(F.col("photo_id") % 5000 == 0, F.lit(3.0))})
    return O.axis_stars(O.train_axes(rows, ["clear", "rare"], NUMBERS), rows).drop("_x").select("photo_id", "clear", "clear_stars")
