"""Queries of the review's filter: each facet, and chains of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsheet.operators import facets as O
from proofsheet.plans.catalog import query
from proofsheet.plans.views import table

_ROWS = """fx AS (SELECT event_id, 'f' || event_id AS filename, CASE event_id % 4 WHEN 0 THEN 'keep' WHEN 1 THEN 'maybe' WHEN 2 THEN 'cull' END AS decision, CASE (event_id // 3) % 4 WHEN 0 THEN 'keep' WHEN 1 THEN 'maybe' WHEN 2 THEN '' END AS rescorer_pred,
 event_type AS scene, CASE WHEN event_id % 6 > 0 THEN [['calm', 'bold', 'film'][event_id % 3 + 1], ['bold', 'soft'][event_id % 2 + 1]] END AS style_modes, CASE WHEN event_id % 5 > 1 THEN ['', 'vows', 'cake'][event_id % 3 + 1] END AS wedding_moment,
 CASE WHEN event_id % 4 = 2 THEN ['blur', 'eyes'][(event_id // 4) % 2 + 1] END AS cull_reason, CASE WHEN event_id % 7 > 0 THEN [event_id % 13, event_id % 17] END AS face_clusters, CASE WHEN event_id % 9 > 0 THEN user_id % 25 END AS gps_cluster_id,
 CASE WHEN event_id % 10 > 0 THEN event_id // 4 END AS cluster_id, event_id % 4 = 1 AS is_burst_peak, value AS score_final FROM events),
 bp AS (SELECT gps_cluster_id AS g, arg_max(filename, (score_final, event_id)) AS best FROM fx WHERE gps_cluster_id IS NOT NULL GROUP BY 1), bs AS (SELECT cluster_id AS c, count(*) AS n FROM fx WHERE cluster_id IS NOT NULL GROUP BY 1)"""


def rows(spark, sf) -> DataFrame:
    e, i = table(spark, sf, "events"), F.col("event_id")
    pick = lambda k, *v: F.get(F.array(*map(F.lit, v)), k.cast("int"))
    return e.select(
        F.concat(F.lit("f"), i).alias("filename"), pick(i % 4, "keep", "maybe", "cull", None).alias("decision"), pick(F.floor(i / 3) % 4, "keep", "maybe", "", None).alias("rescorer_pred"), F.col("event_type").alias("scene"),
        F.when(i % 6 > 0, F.array(pick(i % 3, "calm", "bold", "film"), pick(i % 2, "bold", "soft"))).alias("style_modes"), F.when(i % 5 > 1, pick(i % 3, "", "vows", "cake")).alias("wedding_moment"),
        F.when(i % 4 == 2, pick(F.floor(i / 4) % 2, "blur", "eyes")).alias("cull_reason"), F.when(i % 7 > 0, F.array(i % 13, i % 17)).alias("face_clusters"), F.when(i % 9 > 0, F.col("user_id") % 25).alias("gps_cluster_id"),
        F.when(i % 10 > 0, F.floor(i / 4)).alias("cluster_id"), (i % 4 == 1).alias("is_burst_peak"), F.col("value").alias("score_final"),
    )


def _names(spark, sf, k: int, less: int) -> DataFrame:
    return table(spark, sf, "events").filter(F.col("event_id") % k < less).select(F.concat(F.lit("f"), F.col("event_id")).alias("filename"), (F.col("event_id") * 7 % 1000).alias("rank"))


def _chains(spark, sf) -> dict[str, O.Facets]:
    n = lambda k, less: _names(spark, sf, k, less)
    return {
        "selects": O.Facets("selects"), "disagree": O.Facets("disagree"), "cull_blur": O.Facets("cull", cull_reason="blur"), "scenes_styles": O.Facets(scenes=["view", "click"], styles=["film", "soft"]), "moments": O.Facets(moments=["vows", ""]),
        "faces_places": O.Facets(faces=[3, 5], places=[1, 2, 3, O.UNKNOWN]), "best": O.Facets(best_of_place=True), "peaks": O.Facets(burst_peaks=True), "search": O.Facets("keep", found=n(5, 2), hidden=n(7, 1)),
        "all": O.Facets("selects", scenes=["view", "purchase"], styles=["bold", "calm"], faces=[*range(9)], places=[*range(12), O.UNKNOWN], burst_peaks=True, found=n(3, 2), scene_frames=n(4, 3), hidden=n(11, 2)),
    }


_PEAK = "coalesce(n, 0) < 2 OR is_burst_peak"
_WHERE = {
    "selects": "decision IN ('keep', 'maybe')", "disagree": "coalesce(rescorer_pred, '') <> '' AND rescorer_pred IS DISTINCT FROM decision", "cull_blur": "decision = 'cull' AND cull_reason = 'blur'", "scenes_styles": "scene IN ('view', 'click') AND list_has_any(style_modes, ['film', 'soft'])",
    "moments": "wedding_moment = 'vows'", "faces_places": "list_has_any(face_clusters, [3, 5]) AND (gps_cluster_id IN (1, 2, 3) OR gps_cluster_id IS NULL)", "best": "best = filename", "peaks": _PEAK,
    "search": "decision = 'keep' AND event_id % 5 < 2 AND event_id % 7 >= 1",
    "all": f"decision IN ('keep', 'maybe') AND scene IN ('view', 'purchase') AND list_has_any(style_modes, ['bold', 'calm']) AND list_has_any(face_clusters, range(9)) AND (gps_cluster_id < 12 OR gps_cluster_id IS NULL) AND ({_PEAK}) AND event_id % 3 < 2 AND event_id % 4 < 3 AND event_id % 11 >= 2",
}


@query(f"WITH {_ROWS} " + " UNION ALL ".join(f"SELECT '{k}' AS facets, filename FROM fx LEFT JOIN bp ON g = gps_cluster_id LEFT JOIN bs ON c = cluster_id WHERE {w}" for k, w in _WHERE.items()))
def facet_chains(spark, sf):
    all_rows = rows(spark, sf)
    found = [O.filtered(all_rows, f).select(F.lit(k).alias("facets"), "filename") for k, f in _chains(spark, sf).items()]
    return reduce(DataFrame.unionByName, found)


@query(f"WITH {_ROWS} SELECT filename, CAST(event_id * 7 % 1000 AS BIGINT) AS queue_rank FROM fx WHERE decision = 'maybe' AND event_id % 3 < 1")
def review_queue(spark, sf):
    """An active-learning queue within the rows of one decision, with its ranks."""
    return O.filtered(rows(spark, sf), O.Facets("maybe", queue=_names(spark, sf, 3, 1))).select("filename", "queue_rank")
